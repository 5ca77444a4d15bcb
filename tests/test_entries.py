"""Postings stored as lists: a row per word and part of the documents."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import index as I, inversion as V
from weftline.plans import shaping

SCHEMA = "dataset string, doc bigint, url string, title string, text string"


def texts(n=150, seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(15)] + ["ähre", "Wort"]
    return [(rng.choice("de"), i, f"u{i}", "t", " ".join(rng.choices(words, k=rng.randint(0, 25)) + [f"r{i // 9}"])) for i in range(n)]


def rows(df, *columns):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("most", [5, 1000])
def test_an_index_that_is_only_stored_is_written_once(spark, monkeypatch, tmp_path, most):
    """the stored index comes from the word lists by one write, a row per word and task and not per posting."""
    labels, kept = [], I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, label, *a, **k: labels.append(label) or kept(df, label, *a, **k))
    monkeypatch.setattr(I, "COMMON_TERMS", most)
    monkeypatch.setattr(I, "SLICE_DOCS", 8)
    docs = spark.createDataFrame([*texts(), (None, 900, "u", "t", "no dataset")], SCHEMA)
    index = I.build_index(docs, shards=4, written=False)
    assert "entries" not in labels and "lists" in labels
    I.write_index(index, str(tmp_path / "index"))
    back = I.read_index(spark, str(tmp_path / "index"))
    want = I.build_index(docs, shards=4)
    assert "entries" in labels
    for name, columns in (("postings", ["dataset", "term", "doc", "count", "total_words", "weight", "mag"]), ("blocks", ["dataset", "term", "slice", "postings", "best"])):
        found = rows(getattr(back, name), *columns)
        assert found == rows(getattr(want, name), *columns) and found
    postings, entries = back.postings.count(), spark.read.parquet(str(tmp_path / "index" / "entries")).count()
    assert postings == sum(len(set(t[4].lower().split())) for t in texts()) and entries < postings / 2


class Known(V.Words):
    def __init__(self, of):
        self.of = {d: (pa.array(list(w)), np.array(list(w.values()))) for d, w in of.items()}


def test_groups_keep_slices_whole_and_long_lists_are_cut(monkeypatch):
    """whatever is worked on together, a block is in one entry, and each posting in one list."""
    monkeypatch.setattr(V, "RUN_SLICES", 3)
    lists = [("d" if i % 3 else "e", i, 4, ["a", "b"] if i % 2 else ["a", "c"], [3, 1], i // 4, 2.0 + i) for i in range(60)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in lists]), pa.array([r[1] for r in lists]), pa.array([r[2] for r in lists]), pa.array([" ".join(r[3]) for r in lists]),
         pa.array([r[4] for r in lists], pa.list_(pa.int32())), pa.array([r[5] for r in lists]), pa.array([r[6] for r in lists])],
        names=["dataset", "doc", "total_words", "terms", "counts", "slice", "mag"],
    )
    words = Known({"d": {"a": 1.5, "b": 2.0}, "e": {"a": 0.5}})
    want = {(d, t, i): (n, 4, mag) for d, i, _, names, counts, _, mag in lists for t, n in zip(names, counts) if t in words.of[d][0].to_pylist()}
    for size in (1, 7, 1000):
        monkeypatch.setattr(V, "GROUP_POSTINGS", size)
        found, blocks = {}, {}
        for part in V.inverted(words)(iter([batch.slice(0, 25), batch.slice(25)])):
            for r in part.to_pylist():
                assert len(r["first"]) <= 3 and len(r["doc"]) == len(r["count"]) == len(r["mag"]) and r["doc"] == sorted(r["doc"])
                found.update({(r["dataset"], r["term"], d): x for d, *x in zip(r["doc"], r["count"], r["total_words"], r["mag"])})
                for k, (start, end) in enumerate(zip(r["first"], [*r["first"][1:], len(r["doc"])])):
                    key = r["dataset"], r["term"], r["doc"][start] // 4
                    assert key not in blocks and {d // 4 for d in r["doc"][start:end]} == {key[2]}
                    share = [math.log2(1 + r["count"][i] / 4) / r["mag"][i] for i in range(start, end)]
                    blocks[key] = end - start
                    assert end - start == 1 or r["share"][k] == pytest.approx(max(share))
        assert {k: tuple(x) for k, x in found.items()} == want and sum(blocks.values()) == len(want)
        others = [r for part in V.other_words(words)(iter([batch])) for r in part.to_pylist()]
        assert sorted((r["dataset"], r["doc"], r["term"], r["count"]) for r in others) == sorted(
            (d, i, t, n) for d, i, _, names, counts, *_ in lists for t, n in zip(names, counts) if (d, t, i) not in want)


def test_nest_takes_lists_and_known_sizes(spark):
    """rows that stand for several items give the blocks of a row for each, and sizes that are known aren't counted again."""
    rng = random.Random(5)
    items = [("hot", i) for i in range(220)] + [("cold", i) for i in range(5)] + [("cold", 3), (None, 1)]
    rng.shuffle(items)
    single = spark.createDataFrame(items, "k string, v int").repartition(5)
    lists = single.withColumn("part", F.col("v") % 7).groupBy("k", "part").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    sizes = single.groupBy("k").agg(F.count("*").alias("_size"))
    want = rows(shaping.nest(single, ["k"], F.col("v"), "all", block_rows=50), "k", "block", "all")
    assert len(want) == 7
    for known in (None, sizes):
        assert rows(shaping.nest(lists, ["k"], F.col("vs"), "all", block_rows=50, lists=True, sizes=known), "k", "block", "all") == want
    few = rows(shaping.nest(lists, ["k"], F.col("vs"), "all", lists=True, sizes=sizes), "k", "all")
    assert few == rows(shaping.nest(single, ["k"], F.col("v"), "all"), "k", "all")
    # what isn't among the known sizes is taken to be small: no other count is made
    assert rows(shaping.nest(lists, ["k"], F.col("vs"), "all", block_rows=50, lists=True, sizes=sizes.limit(0)), "k", "all") == few
