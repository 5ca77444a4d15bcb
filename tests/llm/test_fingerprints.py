"""Fingerprints against sets of whole shingles."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from weftline.llm import fingerprints as FP, sql
from weftline.llm.entries import _fingerprinted
from tests.compare import compare, connect

SCHEMA = "doc_id long, text string, sketch string, block string, at string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {hashlib.md5(" ".join(words[i : i + width]).encode()).hexdigest() for i in range(max(len(words) - width + 1, min(len(words), 1)))}


def smallest(hashes, k):
    return [h[: FP.DIGITS] for h in sorted(hashes)[:k]]


def likeness(a, b, k):
    both = sorted(set(a) | set(b))[:k]
    return 1.0 if not both else len(set(both) & set(a) & set(b)) / len(both)


def wanted(rows, k):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0], hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for n, (doc, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc, len(text), text, smallest(shingles(text), k), edited, smallest(shingles(edited), k), smallest(shingles(after), k)))
    return sorted(out, key=repr)


def rows_with_trouble():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["é𝄞", "Ab", "ab"]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(40)]
    rows += [(7, "one two\tthree\x0bfour"), (8, "one two three four five"), (9, "  a b c d e f"), (10, "   \n"), (11, ""), (12, None), (13, None)]
    rows += [(14, "same text here for all of them"), (15, "same text here for all of them"), (15, "same text here for all of them"), (15, "other"), (None, "no id"), (None, None)]
    return rows + [(500, " ".join(rng.choices(words, k=3000))), (501, "x" * 50_000), (502, "𝄞 " * 999)]


def test_sketches_and_edits(spark, monkeypatch):
    monkeypatch.setattr(FP, "BLOCK_ROWS", 4)
    monkeypatch.setattr(FP, "PART_WORDS", 16)
    rows = rows_with_trouble()
    got = FP.fingerprints(docs(spark, rows), k=20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted(rows, 20)
    own = [(r[0], r[1], r[3]) for r in wanted(rows, 20)]
    assert sorted((tuple(r) for r in FP.document_sketches(docs(spark, rows), k=20).collect()), key=repr) == sorted(own, key=repr)


def test_few_rows(spark):
    for rows in ([(4, "a b c d e f g h")], [(4, None)], [(1, ""), (2, "b c d e f g")]):
        assert sorted((tuple(r) for r in FP.fingerprints(docs(spark, rows)).collect()), key=repr) == wanted(rows, FP.K)
    assert FP.fingerprints(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_estimates(spark):
    """Exact while sketches hold all shingles, near the truth beyond."""
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(4000)]
    pairs = [(base[:n], base[s : s + m]) for n, s, m in ((40, 10, 40), (4000, 0, 2000), (2000, 1000, 2000), (3000, 3000, 900), (30, 0, 30), (0, 0, 8), (0, 0, 0))]
    rows = [(" ".join(a), " ".join(b)) for a, b in pairs]
    table = spark.createDataFrame(rows, "l string, r string").repartition(2)
    table = table.select(FP.words(F.col("l")).alias("l"), FP.words(F.col("r")).alias("r"), F.col("l").alias("text"))
    table = table.select("text", FP.sketch(F.col("l")).alias("l"), FP.sketch(F.col("r")).alias("r"))
    got = table.select(
        "text", FP.resemblance(F.col("l"), F.col("r")).alias("j"), FP.containment(F.col("r"), F.col("l")).alias("c"), FP.shingle_count(F.col("l")).alias("n"),
        FP.union_sketch(F.col("l"), F.col("r")).alias("u"), (FP.sketch_of(FP.fingerprint(F.col("l"))) == F.col("l")).alias("back"),
    ).collect()
    assert sorted(r.text for r in got) == sorted(a for a, _ in rows) and all(r.back for r in got)
    for r in got:
        seen = False
        for a, b in rows:
            if a != r.text:
                continue
            x, y = shingles(a), shingles(b)
            jaccard = len(x & y) / len(x | y) if x | y else 1.0
            inside = len(x & y) / len(y) if y else 1.0
            small = len(x | y) <= FP.K
            near = (lambda g, w, room: abs(g - w) <= (1e-9 if small else room))
            seen |= near(r.j, jaccard, 0.15) and near(r.c, inside, 0.3) and near(r.n, len(x), 0.35 * len(x)) and list(r.u) == smallest(x | y, FP.K)
        assert seen, r.text[:40]


def test_parts_merge(spark):
    """Sketches of parts, however many, give the sketch of the whole; a key may hold most of the parts."""
    rng = random.Random(8)
    parts = [(k, [f"{rng.randrange(1 << 60):016x}" for _ in range(rng.randint(0, 30))]) for k in [1] * 200 + [2, 2, None, None, 3]] + [(4, [])]
    parts = [(k, sorted(s)[:10]) for k, s in parts]
    table = spark.createDataFrame(parts, "_hash long, sketch array<string>").repartition(5)
    got = {r[0]: list(r[1]) for r in FP.merge_sketches(table, ["_hash"], k=10).collect()}
    assert got == {k: sorted({h for x, s in parts if x == k for h in s})[:10] for k in {k for k, _ in parts}}


def test_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op13_document_fingerprints", _fingerprinted, sql.FINGERPRINTS) is None
