"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and a calibrated rejection.

The subwords of a text are the character n-grams of its words (runs of letters, in lower case, with marks at their
ends) and the words themselves, hashed into buckets. A text is the mean of its subwords' vectors;
a linear layer and a softmax give the languages. Vectors and layer are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents. As all of it is linear up to the
softmax, prediction adds up one row of class sums per word, which workers keep for words they have met.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm.common import bound_batches, byte_groups, free_worker, give_back, list_arrays
from weftline.plans.lineage import materialize

BUCKETS, SIZE = 1 << 15, 16
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 400  # labelled documents of a language that are learned from, at most
SAMPLE = 200_000  # those of all languages together (the sample bound); every language keeps one at least
EPOCHS, RATE = 6, 2.0
CHECK_SHARE = 5  # one in so many of the sample sets temperature and rejection
LOSS_SHARE = 0.002  # share of rightly predicted documents that the rejection may cost
MOST_REJECTED_SCORE = 0.6  # scores from here on are never rejected
TABLE_BYTES = 128 << 20  # of the class sums and chunks that a worker keeps
ENTRY_BYTES = 160  # of a chunk in the table besides its characters and sums
LONGEST_KEPT = 256  # characters of a chunk that is kept; longer ones go with the texts they stand in
GROUP_BYTES = 4_000_000  # of texts whose chunks are learned together
PIECE = 1 << 16  # characters of a long chunk whose subwords are at hand at a time
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")


def subwords(word: str) -> list[int]:
    """Buckets of a word of letters."""
    marked = f"<{word}>"
    grams = [marked] + [marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


def bucket_counts(word: str) -> np.ndarray:
    """How often each bucket is met by the subwords of a word; the subwords of a very long one come piece by piece."""
    marked = f"<{word}>"
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[zlib.crc32(marked.encode()) % BUCKETS] += 1
    for at in range(0, len(marked), PIECE):
        part = marked[at : at + PIECE + max(GRAMS) - 1]
        for n in GRAMS:
            found = [zlib.crc32(part[k : k + n].encode()) for k in range(min(PIECE, len(part) - n + 1))]
            counts += np.bincount(np.array(found, dtype=np.int64) % BUCKETS, minlength=BUCKETS)
    return counts


def text_counts(text: str) -> Counter:
    counts: Counter = Counter()
    for word, n in Counter(_LETTERS.findall(text.lower())).items():
        if len(word) > PIECE:
            met = bucket_counts(word)
            counts.update({b: n * int(met[b]) for b in np.flatnonzero(met).tolist()})
            continue
        for bucket in subwords(word):
            counts[bucket] += n
    return counts


@dataclass
class Model:
    """Class sums of each bucket, bias, temperature and rejection limit."""

    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> Model | None:
    """A model from (language, buckets, counts); None without samples. Every fifth sample only sets temperature and rejection."""
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    place = {name: k for k, name in enumerate(languages)}
    data = [(place[name], ids, (counts / counts.sum()).astype(np.float32)) for name, ids, counts in samples if len(ids)]
    checks = data[::CHECK_SHARE] if len(data) >= 10 * CHECK_SHARE else []
    learned = [d for k, d in enumerate(data) if k % CHECK_SHARE] if checks else data
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    layer = np.zeros((len(languages), SIZE), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps, done = EPOCHS * max(1, len(learned)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(learned)):
            name, ids, share = learned[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids]
            logits = layer @ mean + bias
            odds = np.exp(logits - logits.max())
            slope = odds / odds.sum()
            slope[name] -= 1
            back = slope @ layer
            layer -= rate * np.outer(slope, mean)
            bias -= 0.1 * rate * slope
            # step sizes of rare subwords would vanish in the mean of a long text, so shares are raised to their root
            vectors[ids] -= rate * np.sqrt(share)[:, None] * back[None, :]
    model = Model(languages, vectors @ layer.T, bias)
    if checks:
        sums = np.stack([share @ model.table[ids] for _, ids, share in checks])
        ones, truth = np.ones(len(checks)), np.array([name for name, *_ in checks])
        grid = np.geomspace(0.25, 8, 41)

        def loss(t):
            model.temperature = float(t)
            return -np.log(model.scores(sums, ones)[np.arange(len(truth)), truth] + 1e-12).mean()

        model.temperature = float(min(grid, key=loss))
        odds = model.scores(sums, ones)
        right = odds.argmax(axis=1) == truth
        if right.any():
            model.reject_below = float(min(MOST_REJECTED_SCORE, np.quantile(odds.max(axis=1)[right], LOSS_SHARE)))
    return model


class Predictor:
    """Predictions of whole texts; class sums of chunks are kept in a table of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.entry = ENTRY_BYTES + 4 * (len(model.languages) + 1)
        self.rows = np.zeros((1024, len(model.languages) + 1), dtype=np.float32)
        self.places: dict[str, int] = {}
        self.held = 0  # bytes of the table

    def _learn(self, chunks: set[str]) -> None:
        if self.held > TABLE_BYTES:
            self.places.clear()
            self.held = 0
        new = [c for c in chunks if len(c) <= LONGEST_KEPT and c not in self.places]
        need = len(self.places) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((need, self.rows.shape[1]), dtype=np.float32)])
        for chunk in new:
            found = [b for word in _LETTERS.findall(chunk) for b in subwords(word)]
            at = self.places[chunk] = len(self.places)
            self.rows[at, :-1] = self.model.table[found].sum(axis=0) if found else 0
            self.rows[at, -1] = len(found)
            self.held += self.entry + len(chunk)

    def _long(self, chunk: str) -> np.ndarray:
        """The row of a chunk that isn't kept."""
        row = np.zeros(self.rows.shape[1])
        for word in _LETTERS.findall(chunk):
            met = bucket_counts(word) if len(word) > LONGEST_KEPT else np.bincount(subwords(word), minlength=BUCKETS)
            used = np.flatnonzero(met)
            row[:-1] += met[used] @ self.model.table[used].astype(np.float64)
            row[-1] += met.sum()
        return row

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        sums = np.zeros((len(texts), self.rows.shape[1]))
        for start, n in byte_groups([len(t or "") for t in texts], GROUP_BYTES):
            chunks = [(t or "").lower().split() for t in texts[start : start + n]]
            distinct = set().union(*chunks)
            self._learn(distinct)
            passing = {c: self._long(c) for c in distinct if len(c) > LONGEST_KEPT}
            for k, cs in enumerate(chunks, start):
                if passing:
                    for chunk in passing.keys() & cs:
                        sums[k] += cs.count(chunk) * passing[chunk]
                    cs = [c for c in cs if c not in passing]
                if cs:
                    at = np.fromiter(map(self.places.__getitem__, cs), dtype=np.int64, count=len(cs))
                    sums[k] += self.rows[at].sum(axis=0, dtype=np.float64)
        odds = self.model.scores(sums[:, :-1], sums[:, -1])
        letters = sums[:, -1] > 0
        best = odds.argmax(axis=1)
        names = [self.model.languages[b] if has else UNKNOWN for b, has in zip(best, letters, strict=True)]
        score = np.where(letters, odds.max(axis=1), 0.0)
        return names, score.tolist(), (~letters | (score < self.model.reject_below)).tolist()


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches):
    free_worker()
    for batch in batches:
        ids, counts = [], []
        for text in batch.column(1).to_pylist():
            found = text_counts(text)
            order = sorted(found)
            ids.append(np.array(order, dtype=np.int32))
            counts.append(np.array([found[b] for b in order], dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            ["lang", "place", "ids", "counts"],
        )


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the labelled documents that are not held out: PER_LANGUAGE of each language (fewer where SAMPLE wouldn't hold them), chosen by hash, as whole texts."""
    usable = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    place = F.xxhash64("doc_id", F.lit(17))
    ids = usable.select("doc_id", "lang", place.alias("place"))
    languages = ids.select("lang").distinct().count()
    share = max(1, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    picked = ids.withColumn("rank", rank).where(F.col("rank") <= share)
    picked = materialize(picked.select("doc_id", "lang", "place").distinct(), "language-sample")
    rows = usable.join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text", "place")
    found = materialize(
        rows.mapInArrow(_features, "lang string, place long, ids array<int>, counts array<int>"), "language-features"
    )
    order = found.orderBy("place", "lang", F.xxhash64("ids", "counts")).limit(max(SAMPLE, languages)).toArrow()
    names = order.column("lang").to_pylist()
    ids, counts = (list_arrays(order.column(c).combine_chunks()) for c in ("ids", "counts"))
    model = train(list(zip(names, ids, counts, strict=True)))
    del order, names, ids, counts
    give_back()  # the sample was the driver's
    return model


def predicted(docs: DataFrame, model: Model | None, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column; without a model everything is unknown and nothing is rejected but texts without letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = "lang_pred string, score double, rejected boolean"

    @F.pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        free_worker()
        own = Predictor(sent.value) if sent.value is not None else None
        for texts in batches:
            values = [t if isinstance(t, str) else None for t in texts]
            if own is not None:
                names, scores, rejected = own.predict(values)
            else:
                names, scores = [UNKNOWN] * len(values), [0.0] * len(values)
                rejected = [not _LETTERS.search(t or "") for t in values]
            yield pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejected})
        del own  # the table is gone before the next stage takes the worker
        free_worker()

    return predict(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Languages of every whole text: (doc_id, held_out, lang_pred, score, rejected), a row per row.

    Learns from text and language of the documents that are not held out; a prediction reads the text alone.
    ``score`` is the calibrated probability of the prediction. ``rejected``: no letter in the text, or a score under the
    limit at which LOSS_SHARE of the rightly predicted calibration documents would be lost.

    * Null text, or one without a letter: ``und``, score 0, rejected. Null language: not learned from.
    * Null id: not held out, not learned from, predicted. Repeated rows are learned from and predicted each.
    * No labelled text at all: everything is ``und``. Other columns are not read. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    model = train_on(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = rows.withColumn("found", predicted(docs, model, F.col("text")))
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "found.lang_pred", "found.score", "found.rejected")


def without_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents that are rejected; all columns stay as they are."""
    bound_batches(docs.sparkSession)
    model = train_on(docs, id_col, text_col, lang_col)
    found = predicted(docs, model, F.col(text_col).cast("string"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), found.alias("found"))
    return packed.where("not found.rejected").select(*[F.col("row")[c].alias(c) for c in docs.columns])
