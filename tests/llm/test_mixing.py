"""The mix against targets worked out one by one, and its schedule against the shares."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing, sql
from weftline.llm.entries import _mixed
from tests.compare import compare, connect

SCHEMA = "doc_id long, text string, source string, size string, slot string"


def targets(sizes):
    """Water level by bisection over real numbers."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, mid)
    return {s: min(2 * sizes[s], high * weight[s]) for s in names}


def documents(rng, shares):
    docs = []
    for source, words in shares.items():
        while words > 0:
            n = min(words, rng.choice([1, 3, 20, 150]))
            docs.append((len(docs), "w " * n, source, "x", "y"))
            words -= n
        docs.append((len(docs), rng.choice([None, "", " \n"]), source, "x", "y"))
    return docs


@pytest.mark.parametrize("shares", [{"b": 900, "a": 50, "é": 300, None: 77, "": 5, "z": 0}, {"a": 10}, {"a": 3000, "b": 3000, "c": 3000}, {"a": 1, "b": 4000, "c": 4000}])
def test_targets_are_met(spark, shares, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 7)
    monkeypatch.setattr(mixing, "SLOT_SPAN", 16)
    docs = documents(random.Random(2), shares)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = mixing.mix_sources(frame, block_words=16).collect()
    want = targets(shares)
    assert sorted(r.doc_id for r in got) == [d[0] for d in docs]
    for source, size in shares.items():
        own = [r for r in got if r.source == source]
        assert all(r.source_size == size and abs(r.target - want[source]) < 1e-6 for r in own)
        assert sum(r.taken for r in own) == int(own[0].target)
    assert all(0 <= r.taken <= 2 * r.size and r.size == len((docs[r.doc_id][1] or "").split()) for r in got)
    again = mixing.mix_sources(spark.createDataFrame(docs[::-1], SCHEMA), block_words=16).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_every_stretch_holds_the_shares(spark):
    rows = [(0, "a", 90_000, 120_000.0), (1, "b", 40_000, 30_000.0), (2, "c", 20_000, 10_000.0), (3, "d", 0, 0.0)]
    sources = spark.createDataFrame(rows, "source_no long, source string, source_size long, target double")
    plan = mixing.slots(sources, 16).orderBy("slot").collect()
    assert sum(r.words for r in plan) == 160_000 and len({r.slot for r in plan}) == len(plan)
    for n in (200, 1000, 5000):
        share = sum(r.source_no == 0 for r in plan[:n]) / n
        assert abs(share - 0.75) < 0.02
    blocks = [(r.epoch, r.block) for r in plan if r.source_no == 0]
    assert blocks == sorted(blocks) and len(set(blocks)) == len(blocks)


def test_schedule_covers_documents(spark):
    docs = documents(random.Random(5), {"a": 500, "b": 900, "c": 30})
    pieces = mixing.schedule(spark.createDataFrame(docs, SCHEMA), block_words=16).where("words > 0")
    # within one epoch a word is taken once at most
    per = pieces.groupBy("doc_id", "size", "epoch").agg(F.sum("words").alias("n"), F.sum(F.col("first") + F.col("words")).alias("m"))
    assert per.where("n > size").count() == 0


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c", "s", "x", "y")] * 3 + [(None, "d e", "s", "x", "y"), (None, None, None, "x", "y"), (2, "", "s", "x", "y"), (2, "", "s", "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(frame).collect()
    assert len(got) == 7 and sum(r.taken for r in got) == 16
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns and 5 <= mixed.count() <= 8
    assert mixing.mix_sources(frame.limit(0)).count() == 0
    assert mixing.mix_sources(frame.where("text = ''")).agg(F.sum("taken")).first()[0] == 0


def test_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op8_source_mixing", _mixed, sql.MIXING) is None


def test_rows_come_through_the_schedule(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 1)
    assert compare(spark, connect(sf_dir), sf_dir, "op8_source_mixing", _mixed, sql.MIXING) is not None


def test_mix_is_written_in_the_order_of_its_slots(spark):
    docs = documents(random.Random(7), {"a": 900, "b": 500, "c": 60})
    frame = spark.createDataFrame(docs, SCHEMA)
    mixed = [r.doc_id for r in mixing.mixed_documents(frame, block_words=16).collect()]
    first = {r.doc_id: r.first_slot for r in mixing.mix_sources(frame, block_words=16).where("taken > 0").collect()}
    seen = list(dict.fromkeys(mixed))
    assert set(seen) == set(first) and [first[d] for d in seen] == sorted(first.values())


def test_columns_with_clashing_names(spark):
    docs = documents(random.Random(8), {"a": 90, "b": 50})
    names = ["_copy", "_doc", "_text", "_copies", "row", "slot", "epoch", "text_hash", "words"]
    frame = spark.createDataFrame(docs, SCHEMA).drop("slot").withColumns({n: F.lit(n) for n in names})
    mixed = mixing.mixed_documents(frame, block_words=16)
    assert mixed.columns == frame.columns
    got = mixed.collect()
    assert got and all(r[n] == n for r in got for n in names)


def test_levels_of_many_sources(spark):
    shares = {f"s{k:03}": 1 + k * k % 97 for k in range(200)}
    rows = spark.createDataFrame(list(shares.items()), "source string, size long")
    want = targets(shares)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in mixing.source_targets(rows).collect())
    capped = mixing.source_targets(rows, share=2.5)  # more than all sources may give
    assert all(r.target == 2.0 * r.source_size for r in capped.collect())
