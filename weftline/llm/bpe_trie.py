"""Byte-pair encoding of many words at once, sharing the work on common prefixes.

For each prefix of a word, byte-pair encoding ends in one certain token, and the tokens before it are
the encoding of the prefix without that token. So the last token of a prefix is the
one vocabulary entry that ends the prefix and may follow the last token of what stands before it; two
tokens may follow each other exactly when byte-pair encoding of the two put together gives them
back. Distinct words are put into a trie; going through it depth first, every prefix
gets its last token once, and a word's encoding is read backwards along these tokens.

Long words would make a trie node for each of many letters that no other word shares. They are
taken in sorted order, which is the order of the traversal, with the path alone as state: what a word
shares with the one before it stands there already. The tokens that end at a letter
come from one automaton of the vocabulary.
"""

from __future__ import annotations

import codecs
import gc
import os
import unicodedata
from array import array
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The pre-token pattern and end mark of the tokenizer file (white space is taken out before)
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
WORD_END = "</w>"
# Fixed value: white space of the tokenizer's patterns; str.split() also splits at U+001C to U+001F
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPLITS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class TrieEncoder:
    """Encodes words by a vocabulary and ranked merges; results of words and of token pairs are kept, in bounded tables."""

    MOST_PAIRS = 400_000
    LONG = 8  # characters of a word from which on it is kept out of the trie

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.ids))
        # each merged token with the two it was made of, and when; single symbols come before all merges
        self.halves = {a + b: (a, b) for (a, b) in reversed(self.ranks)}
        self.made = {t: self.ranks[h] for t, h in self.halves.items()}
        self.letters = [byte_letters()[b] for b in range(256)]
        self.spelling = "".join(self.letters)
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.paths: LongWords | None = None

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            core = token[: -len(WORD_END)]
            return [*core[:-1], core[-1] + WORD_END]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair encoding by its definition; only ever used on one or two tokens."""
        while len(symbols) > 1:
            best = min((self.ranks.get(p, len(self.ranks)), k) for k, p in enumerate(zip(symbols, symbols[1:])))
            if best[0] == len(self.ranks):
                break
            k = best[1]
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]
        return symbols

    def _may_start(self, token: str) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self._symbols(token)) == [token]
        return known

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether byte-pair encoding of two tokens put together gives the two back.

        Their merges are undone, the later one first: at each time before it, the symbols that met at the
        seam must not have been merged earlier (at equal ranks the left one is merged first).
        """
        made, halves, ranks = self.made, self.halves, self.ranks
        until = len(ranks)
        a, b = left, right
        while True:
            if ranks.get((a, b), until) < until:
                return False
            at_a, at_b = made.get(a, -1), made.get(b, -1)
            if at_a < 0 and at_b < 0:
                return True
            if at_a > at_b:
                until, a = at_a, halves[a][1]
            else:
                until, b = at_b + 1, halves[b][0]

    def _may_follow(self, left: str, right: str) -> bool:
        if (known := self.follows.get((left, right))) is None:
            if len(self.follows) >= self.MOST_PAIRS:
                self.follows.clear()
            known = self.follows[left, right] = self._stay_apart(left, right)
        return known

    def _last_token(self, tail: str, end: str, depth: int, last: list[str], starts: list[int]) -> None:
        """Set the last token of the prefix of ``depth`` symbols that ends in ``tail`` (and in ``end``, a word's mark or nothing)."""
        ids, follows = self.ids, self.follows
        most = len(tail)
        for cut in range(most - depth if depth < most else 0, most):  # longest first
            token = tail[cut:] + end
            if token in ids:
                at = depth - most + cut
                if at:
                    before = last[at]
                    fits = follows.get((before, token))
                    if fits is None:
                        fits = self._may_follow(before, token)
                else:
                    fits = self._may_start(token)
                if fits:
                    last[depth] = token
                    starts[depth] = at
                    return
        raise ValueError(f"the vocabulary can't encode {tail[-1:]!r}")

    def encode(self, words) -> dict[str, list[str]]:
        """Tokens of each distinct word."""
        collects = gc.isenabled()
        gc.disable()  # a trie holds no cycles, and its many nodes would make the collector look at all tables again and again
        try:
            return self._encode(words)
        finally:
            if collects:
                gc.enable()

    def _encode(self, words) -> dict[str, list[str]]:
        letters = self.letters
        root: dict = {}
        deepest = 0
        found = {}
        long_words = [w for w in words if len(w) >= self.LONG]
        if long_words:
            if self.paths is None:
                self.paths = LongWords(self)
            found.update(self.paths.encode(long_words))
        for word in words:
            if word in found:
                continue
            spelt = word if word.isascii() and word.isalnum() else "".join([letters[b] for b in word.encode()])
            node = root
            for c in spelt[:-1]:
                child = node.get(c)
                if child is None:
                    child = node[c] = {}
                node = child
            if "" in node:  # words that end here, by their last letter
                node[""].append((spelt[-1], word))
            else:
                node[""] = [(spelt[-1], word)]
            if len(spelt) > deepest:
                deepest = len(spelt)
        last, starts = [""] * (deepest + 1), [0] * (deepest + 1)
        stack = [(0, "", root)]
        longest, last_token = self.longest, self._last_token
        while stack:
            depth, tail, node = stack.pop()
            if depth:
                last_token(tail, "", depth, last, starts)
            for c, child in node.items():
                if c:
                    stack.append((depth + 1, (tail + c)[-longest:], child))
                    continue
                for letter, word in child:
                    # this place of the tables is the next depth's: it is free until a child of the node is taken up
                    last_token((tail + letter)[-longest:], WORD_END, depth + 1, last, starts)
                    at, tokens = depth + 1, []
                    while at:
                        tokens.append(last[at])
                        at = starts[at]
                    tokens.reverse()
                    found[word] = tokens
        return found


class LongWords:
    """The same last-token states for long words, by token numbers; nothing but the path to the last word is kept."""

    END = "\0"  # stands for the end mark; no letter of the vocabulary's alphabet

    def __init__(self, trie: TrieEncoder):
        self.trie = trie
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.tokens = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in trie.ids:
            spelt = token[: -len(WORD_END)] + self.END if token.endswith(WORD_END) else token
            if spelt != self.END:
                self.tokens.add_word(spelt, len(self.names))
                self.names.append(token)
                self.sizes.append(len(spelt))
        self.tokens.make_automaton()
        self.pairs: dict[int, bool] = {}

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: stand at the start); the answer is kept."""
        names, pairs = self.names, self.pairs
        if len(pairs) >= self.trie.MOST_PAIRS:
            pairs.clear()
        fits = self.trie._stay_apart(names[before], names[token]) if before >= 0 else self.trie._may_start(names[token])
        pairs[before * len(names) + token] = fits
        return fits

    def encode(self, words):
        """(word, tokens) of each word; the path grows at four bytes a letter."""
        spelt = sorted((codecs.charmap_decode(w.encode(), "strict", self.trie.spelling)[0] + self.END, w) for w in words)
        names, sizes, pairs, many = self.names, self.sizes, self.pairs, len(self.names)
        path, before_it = array("i", [-1]), ""
        for letters, word in spelt:
            done = len(os.path.commonprefix((before_it, letters)))
            before_it = letters
            del path[done + 1 :]
            # a token that ends behind the shared prefix starts at most its length before; tokens come longest first
            for end, token in self.tokens.iter(letters, max(0, done + 1 - self.trie.longest)):
                if end < done:
                    continue
                before = path[end + 1 - sizes[token]]
                fits = pairs.get(before * many + token)
                if fits is None:
                    fits = self._fits(before, token)
                if fits:
                    if end > done:
                        break
                    path.append(token)
                    done = end + 1
            if done < len(letters):
                raise ValueError(f"the vocabulary can't encode {letters[done]!r}")
            at, tokens = done, array("i")
            while at:
                tokens.append(path[at])
                at -= sizes[path[at]]
            tokens.reverse()
            yield word, [names[t] for t in tokens]


class Encoded:
    """Token numbers of chunks, one chunk behind the other: an entry costs its text, a number and four bytes a token."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts = array("i", [0])
        self.tokens = array("i")

    def __getitem__(self, chunk: str) -> array:
        row = self.rows[chunk]
        return self.tokens[self.starts[row] : self.starts[row + 1]]

    def add(self, chunk: str, tokens: array) -> None:
        self.rows[chunk] = len(self.rows)
        self.tokens.extend(tokens)
        self.starts.append(len(self.tokens))

    def drop_last(self, chunks) -> None:
        """Drop the chunks, which were added last."""
        for chunk in chunks:
            del self.rows[chunk]
        del self.starts[len(self.rows) + 1 :]
        del self.tokens[self.starts[-1] :]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of these rows, and where each row ends in them."""
        starts = np.asarray(self.starts)
        begin = starts[rows]
        sizes = starts[rows + 1] - begin
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat((begin - ends + sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return np.asarray(self.tokens)[at], ends


class TextEncoder:
    """Whole texts to ids and back, as strings: ids joined by spaces, and the decoded text."""

    MOST_WORDS = 250_000  # chunks and words in the young table, and in the old one
    MOST_HELD = 24_000_000  # characters of them, their ids and decoded texts, likewise; one group of texts may come on top
    LONGEST_KEPT = 256  # characters of a chunk or word that is kept; longer ones go with the texts they stand in

    def __init__(self, spec: dict):
        self.words = TrieEncoder(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.marks = tuple(self.special)
        names = {n: t for t, n in [*self.words.ids.items(), *self.special.items()]}
        self.names = pa.array([names.get(n, "") for n in range(max(names) + 1)], pa.string())
        self.numbers = pa.array(map(str, range(len(self.names))), pa.string())
        # characters of a token's number and name
        self.chars = np.array([len(str(n)) + len(names.get(n, "")) for n in range(len(self.names))])
        # a chunk that is one word reads as that word, so both stand in one table; what is used while the young one fills up outlives the old one
        self.young = Encoded()
        self.passing: dict[str, array] = {}
        self._age()

    def _age(self) -> None:
        self.old, self.young = self.young, Encoded()
        # chunks hold no blank, so a special token behind a blank can't be mistaken for text
        for text, number in self.special.items():
            self.young.add(f" {text}", array("i", [number]))
        self.held = 0

    def _strings(self, texts: pa.Array) -> dict[str, str]:
        tokens = ((c, self.young[c]) for c in self.young.rows)
        return {c: " ".join(texts.take(pa.array(ts, pa.int32())).to_pylist()) for c, ts in tokens}

    @property
    def ids(self) -> dict[str, str]:
        """Ids of what the young table holds, written out."""
        return self._strings(self.numbers)

    @property
    def decoded(self) -> dict[str, str]:
        """Decoded texts of what the young table holds, written out."""
        return self._strings(self.names)

    @property
    def known(self) -> dict[str, tuple[str, str]]:
        """Words that are held apart from the chunks: none."""
        return {}

    def chunks(self, text: str) -> list[str]:
        """The text in normal form (composed, lower case letter by letter), cut at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if _ODD_SPLITS.search(text):
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        """Bring all chunks into the young table; encode those that neither table holds."""
        young, old = self.young, self.old
        rows, place = len(young.rows), len(young.tokens)
        new = chunks.difference(young.rows)
        kept = new.intersection(old.rows)
        parts = {}
        plain = []
        for c in new.difference(kept):
            if c.isascii() and c.isalpha():
                plain.append(c)
            else:
                parts[c] = PRE_TOKENS.findall(c)
        words = set(plain).union(*parts.values()).difference(young.rows)
        kept |= words.intersection(old.rows)
        for c in kept:
            young.add(c, old[c])
        number = self.words.ids.__getitem__
        passing = {}
        for word, tokens in self.words.encode(words.difference(kept)).items():
            if len(word) > self.LONGEST_KEPT:
                passing[word] = array("i", map(number, tokens))
            else:
                young.add(word, map(number, tokens))
        for chunk, ps in parts.items():
            if chunk in young.rows or chunk in passing:
                continue
            found = array("i")
            for p in ps:
                found.extend(passing[p] if p in passing else young[p])
            if len(chunk) > self.LONGEST_KEPT:
                passing[chunk] = found
            else:
                young.add(chunk, found)
        added = np.asarray(young.tokens[place:])
        blanks = len(added) - (len(young.rows) - rows)
        self.held += sum(map(len, islice(reversed(young.rows), len(young.rows) - rows))) + int(self.chars[added].sum()) + 2 * blanks
        for chunk, found in passing.items():
            young.add(chunk, found)
        self.passing = passing

    def arrays(self, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Number of tokens, ids and decoded text of each text."""
        if len(self.young.rows) > self.MOST_WORDS or self.held > self.MOST_HELD:
            self._age()
        cut = [self._with_special(t) if any(m in t for m in self.marks) else self.chunks(t) for t in texts]
        self.learn(set().union(*cut))
        borders = np.cumsum([0, *map(len, cut)])
        rows = np.fromiter(map(self.young.rows.__getitem__, chain.from_iterable(cut)), np.int32, borders[-1])
        del cut
        tokens, ends = self.young.gather(rows)
        if self.passing:
            self.young.drop_last(self.passing)
            self.passing = {}
        offsets = np.concatenate([[0], ends])[borders]
        starts, tokens = pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32())
        ids, decoded = (pc.binary_join(pa.ListArray.from_arrays(starts, s.take(tokens)), " ") for s in (self.numbers, self.names))
        return pa.array(np.diff(offsets), pa.int64()), ids, decoded

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids, decoded text) of each text."""
        _, ids, decoded = self.arrays(texts)
        return list(zip(ids.to_pylist(), decoded.to_pylist(), strict=True))

    def _with_special(self, text: str) -> list[str]:
        out = []
        for part in self.split_special.split(text):
            out += [f" {part}"] if part in self.special else self.chunks(part)
        return out
