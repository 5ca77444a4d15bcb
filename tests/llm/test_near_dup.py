"""Near-duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from weftline.llm import near_dup
from weftline.llm.common import shingle_set, word_hashes
from weftline.llm.components import components
from weftline.llm.entries import _near

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, component_id string, digest string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def full_set(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(docs, width, percent=80):
    sets = [full_set(t, width) for _, t in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = {}
    for k, s in enumerate(sets):
        for g in s:
            owners.setdefault(g, []).append(k)
    near = {(i, j) for ks in owners.values() for i in ks for j in ks if i < j}
    for i, j in near:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(docs[i][0]), root(docs[j][0])
            parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), root(d), root(d) == d) for (d, _), s in zip(docs, sets, strict=True))


def run(spark, docs, width, **options):
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    return sorted(tuple(r) for r in near_dup.near_duplicates(frame, width=width, **options).collect())


def test_word_hashes_follow_words():
    random.seed(1)
    for text in ("", " \t\n", "Ab  aB c\x0bÄ ä", "x" * 200_000 + " y", " ".join(random.choice("abc") * 3 for _ in range(90_000))):
        w, h = words(text), word_hashes(text.encode())
        assert len(w) == len(h) and len(set(w)) == len(set(h.tolist()))
        assert all(len({b for a, b in zip(w, h.tolist(), strict=True) if a == x}) == 1 for x in list(set(w))[:20])


def test_odd_sketches_estimate_similarity():
    base = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    other = np.concatenate([base[:900], base[:100] ^ np.uint64(0xABCDEF1234567)])
    x, y = (near_dup.odd_sketch(near_dup.min_samples(s)).view(np.uint64) for s in (base, other))
    apart = int(np.bitwise_count(x ^ y).sum())
    assert near_dup.differing_bits(0.93) <= apart <= near_dup.differing_bits(0.70)


def test_sets_components_and_survivors(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    docs, n = [], 0
    for _ in range(40):  # groups around a base: exact copies, near copies on both sides of the limit
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(1, 6)):
            copy = [w if rng.random() > 0.03 else rng.choice(vocab) for w in base]
            docs.append((n, " ".join(copy).upper() if n % 3 else "\n".join(copy)))
            n += 1
    docs += [(1000, None), (1001, ""), (1002, " \t "), (1003, "one two"), (1004, "ONE two"), (1005, "one  two three")]
    for width in (4, 5):
        assert run(spark, docs, width) == brute(docs, width)


def test_chain_of_near_copies_in_small_tiles(spark, monkeypatch):
    """A long chain, where each copy is near its neighbours only, whatever the leaders and tiles."""
    monkeypatch.setattr(near_dup, "TILE", 8)
    vocab = ["v%d" % i for i in range(400)]
    order = list(range(60))
    random.Random(3).shuffle(order)
    docs = [(d, " ".join(vocab[4 * k : 4 * k + 70])) for d, k in enumerate(order)]
    assert run(spark, docs, 4) == brute(docs, 4)


def test_null_and_repeated_ids(spark):
    text = " ".join("w%d" % i for i in range(30))
    got = run_rows(spark, [(None, text), (7, text), (7, text), (7, "other words here now"), (9, text + " end")])
    assert got == [(None, 27, None, True), (7, 1, 7, True), (7, 27, 7, True), (7, 27, 7, True), (9, 28, 7, False)]
    assert run(spark, [], 4) == []


def run_rows(spark, docs):
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    rows = [tuple(r) for r in near_dup.near_duplicates(frame, width=4).collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_components_of_a_path(spark):
    nodes = list(range(50))
    random.Random(2).shuffle(nodes)
    links = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)) + [(100, 101), (101, 102)], "a long, b long")
    got = dict((r["node"], r["component"]) for r in components(links).collect())
    assert got == {n: 0 for n in nodes} | {100: 100, 101: 100, 102: 100}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in _near(spark, sf_dir).collect()) == brute(docs, 4)


@pytest.mark.parametrize("text", ["a" * 300_000, "a b c d e f " * 40_000])
def test_very_long_texts(text):
    assert len(shingle_set(text.encode(), 4)) == len(full_set(text, 4))


def test_columns_with_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (2, text), (3, "other words"), (None, text)]
    names = ["_dropped_id", "row", "kept", "component_id"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    kept = near_dup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, *r[2:]) for r in kept.collect()) == [(n, *names) for n in (0, 1, 3)]
