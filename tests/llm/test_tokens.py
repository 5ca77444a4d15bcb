"""Encoding, counting and packing against the libraries and exact round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weftline.llm import bpe_text, packing, token_counts
from weftline.llm.bpe_trie import TrieEncoder
from weftline.llm.entries import _counted, _encoded, _packed

SCHEMA = "doc_id long, text string, ids string, n_tokens string"
ODD = [
    None, "", " ", "  ", "\n", " \n ", "a  b\n\nc \n d", "▁ ▁a", "<s>a</s> <unk>", "\x00 a\x00b", "\t\ta\r\n", "日本 語\n😀", "  lead", "trail  ",
    "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ ﬁ é don't 'S we'll", "x\x1cy\x1d z\x85q ​　u",
    "aaaa" * 500, "текст 12345 ½ ٣", "'" * 50 + "ss't", "!!'s", "😀😃🏽‍♂️ ǅ ẞ", "zq" * 40_000, "word " * 30_000,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("abcdeeettth'AÉß1!? \n▁日.") for _ in range(rng.randint(1, 150))) for _ in range(300)]
    return ODD + made


@pytest.fixture(scope="module")
def words():
    tokenizer = Tokenizer.from_file(bpe_text.DEFAULT_TOKENIZER)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def frame(spark, texts):
    rows = [(k if k % 7 else None, t, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(3), rows + rows[:3]


def order(rows):
    return sorted(rows, key=repr)


def test_encoding_and_decoding(spark, texts, words):
    docs, rows = frame(spark, texts)
    want = []
    for doc, text, *_ in rows:
        ids = words.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), ids, words.decode(ids, skip_special_tokens=False)))
    got = bpe_text.encode_documents(docs).withColumn("ids", bpe_text.id_array())
    assert order((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got.collect()) == order(want)
    assert bpe_text.encode_documents(docs.limit(0)).count() == 0


def test_small_tables_of_the_encoder(monkeypatch, texts, words):
    import json

    from weftline.llm.bpe_trie import TextEncoder

    monkeypatch.setattr(TextEncoder, "MOST_WORDS", 20)
    monkeypatch.setattr(TrieEncoder, "MOST_PAIRS", 10)
    encoder = TextEncoder(json.load(open(bpe_text.DEFAULT_TOKENIZER, encoding="utf-8")))
    for text in texts[:80]:
        ids = words.encode(text or "", add_special_tokens=False).ids
        assert encoder.encode([text or ""])[0][0] == " ".join(map(str, ids))


def test_unbroken_texts(monkeypatch, words):
    """Text without blanks: ids as the library's, tables bounded by characters, long words not kept."""
    import json

    from weftline.llm.bpe_trie import TextEncoder

    spec = json.load(open(bpe_text.DEFAULT_TOKENIZER, encoding="utf-8"))
    monkeypatch.setattr(TextEncoder, "MOST_HELD", 3000)
    encoder, rng = TextEncoder(spec), random.Random(6)
    parts = ["the", "ation", "日本", "xq", "é", "aaa", "ßtr", "😀"]
    start = "".join(rng.choice(parts) for _ in range(60))
    texts = [start[: rng.randint(1, 100)] + "".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += [start, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "ab" * 50_000]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        for text, (ids, decoded) in zip(part, encoder.encode(part), strict=True):
            want = words.encode(text, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want)) and decoded == words.decode(want, skip_special_tokens=False)
        assert max(map(len, [*encoder.ids, *encoder.known])) <= TextEncoder.LONGEST_KEPT
        assert encoder.held == sum(len(c) + len(encoder.ids[c]) + len(encoder.decoded[c]) for c in encoder.ids if c[0] != " ") + sum(
            len(w) + len(x) + len(y) for w, (x, y) in encoder.known.items()
        )


def test_long_words_equal_the_trie(monkeypatch, texts):
    import json

    spec = json.load(open(bpe_text.DEFAULT_TOKENIZER, encoding="utf-8"))
    pieces = {w for t in texts for w in (t or "").split()[:50] if len(w) < 3000}
    apart = TrieEncoder(spec).encode(pieces)
    monkeypatch.setattr(TrieEncoder, "LONG", 1)
    assert TrieEncoder(spec).encode(pieces) == apart
    monkeypatch.setattr(TrieEncoder, "LONG", 10**9)
    assert TrieEncoder(spec).encode(pieces) == apart


def test_prefix_states_equal_merging_by_rank():
    merges = ["a b", "ab a", "b a", "a b</w>", "ba b</w>"]
    vocab = {t: k for k, t in enumerate(["a", "b", "a</w>", "b</w>", "ab", "aba", "ba", "ab</w>", "bab</w>"])}
    encoder = TrieEncoder({"model": {"vocab": vocab, "merges": merges}})
    rng = random.Random(0)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(300)}
    got = encoder.encode(words)
    assert got == {w: encoder.merged([*w[:-1], w[-1] + "</w>"]) for w in words}


def test_counts(spark, texts, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.DEFAULT_MODEL)
    docs, rows = frame(spark, texts)
    want = [(d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 50) for d, t, *_ in rows]
    assert order(tuple(r) for r in token_counts.count_tokens(docs, limit=50).collect()) == order(want)
    monkeypatch.setattr(token_counts, "MOST_CACHED", 10)
    lengths = token_counts.Lengths(library)
    assert [lengths.count([t or ""])[0] for t in texts] == [len(library.encode(t or "")) for t in texts]
    monkeypatch.setattr(token_counts, "MOST_HELD", 100)
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 50)
    lengths = token_counts.Lengths(library)
    assert lengths.count([t or "" for t in texts]) == [len(library.encode(t or "")) for t in texts]
    assert max(map(len, lengths)) <= token_counts.LONGEST_KEPT
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_room_tree_and_best_fit():
    rng = random.Random(9)
    tree, rooms = packing.RoomTree(50), []
    for k in range(2000):
        if rng.random() < 0.6 or not rooms:
            rooms.append(room := rng.randint(1, 50))
            tree.put(room, k)
        else:
            least = rng.randint(1, 50)
            found = tree.take(least)
            fits = [r for r in rooms if r >= least]
            assert (found[0] if found else None) == (min(fits) if fits else None)
            if found:
                rooms.remove(found[0])
    lengths = [rng.randint(1, 50) for _ in range(500)]
    rows, left = [], []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(50 - n)
    rows = packing.place(lengths, 50)
    assert len(rows) == len(left) and sorted(k for r in rows for k in r) == list(range(500))
    assert all(sum(lengths[k] for k in r) <= 50 for r in rows)


def test_packing_is_lossless(spark, texts):
    docs, rows = frame(spark, texts)
    codec = packing.encoding(open(packing.DEFAULT_RANKS, "rb").read())
    packed = packing.write_packed(docs, row_tokens=64, block_tokens=5_000).collect()
    assert {(r.block, r.row) for r in packed} and len({(r.block, r.row) for r in packed}) == len(packed)
    pieces = {}
    for r in packed:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 64 and r.n_tokens + r.n_pad == 64 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == packing.END_ID).all()
        for s, at, end in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert (s.start, s.length) == (at, end - at) and positions[at:end].tolist() == list(range(end - at))
            pieces.setdefault(s.doc_id, {}).setdefault(s.piece, []).append(ids[at:end].tolist())
    for doc, text, *_ in rows:
        want = [*codec.encode_ordinary(text or ""), packing.END_ID]
        own = pieces[doc]
        if doc is not None:
            assert sum((own[k][0] for k in sorted(own)), []) == want
    assert sum(r.n_tokens for r in packed) == sum(len(codec.encode_ordinary(t or "")) + 1 for _, t, *_ in rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_queries(spark, sf_dir, words):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    encoded, counted = _encoded(spark, sf_dir).collect(), _counted(spark, sf_dir).collect()
    assert len(encoded) == len(counted) == len(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.DEFAULT_MODEL)
    for r in encoded:
        ids = words.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = words.decode(ids, skip_special_tokens=False)
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *want]
    for r in counted:
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
    packed = _packed(spark, sf_dir).collect()
    assert {d for r in packed for d in r.doc_ids} == set(docs)


def test_texts_are_grouped_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe_text, "GROUP_BYTES", 10)
    texts = pa.array(["abc", None, "defg", "ää", "", "x" * 30, "y", None])
    groups = bpe_text._groups(texts)
    assert groups == [(0, 3), (3, 2), (5, 1), (6, 2)] and bpe_text._groups(texts[:0]) == []
