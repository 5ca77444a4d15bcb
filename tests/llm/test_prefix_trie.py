"""The trie against plain Python."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from weftline.llm import prefix_trie as PT, sql
from weftline.llm.entries import _trie
from tests.compare import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, depth string, length string, span string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def rebuilt(rows, group, most):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t for *_, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        out[c] = tuple(turns.get(base, [])[:h] + x[h:])
    return out


def wanted(rows, group=20, most=4):
    seqs, nodes = rebuilt(rows, group, most), {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    own = {p: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p, m in nodes.items()}
    kids, saved, leaves = {p: 0 for p in nodes}, {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            saved[p[:d]] += own[p]
            leaves[p[:d]] += kids[p] == 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if seqs[c] == p)))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def digest_rows(trie):
    ends = PT.end_digests(trie.ends).withColumnRenamed("conv_id", "ends_at")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    rows = trie.nodes.join(ends, "ends_at", "left").select(*names, F.coalesce("ends_sha256", F.lit(PT.NO_ENDS)))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def rows_with_trouble():
    rng = random.Random(3)
    texts = ["a b", "a  b", "c", "", None, "d\x0be f", "long " * 5000]
    rows = []
    for conv in list(range(0, 130)) + [-40, -7, -3, 10**15]:
        if conv % 20 == 0 and conv % 40:
            continue  # some conversations have nothing to borrow from
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(60, None, "user", "first"), (60, None, "user", "first"), (61, 2, "user", "tie"), (61, 2, "user", "tie"), (61, 2, "bot", "tie")]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (200, None, None, None)]
    rows += [(300 + i, t, "user", f"t{t}") for i in range(50) for t in range(8)]  # many alike
    return rows + [(400, t, "user", f"x{t}") for t in range(300)] + [(401, t, "user", f"x{t}") for t in range(200)]


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(PT, "SPAN", 16)
    rows = rows_with_trouble()
    trie = PT.conversation_trie(conversations(spark, rows))
    assert digest_rows(trie) == wanted(rows)
    seqs = rebuilt(rows, 20, 4)
    weights = {}
    for c, s in seqs.items():
        weights.setdefault(s, []).append(c)
    assert sorted((r.conv_id, r.length, r.weight) for r in trie.sequences.collect()) == sorted((min(c), len(s), len(c)) for s, c in weights.items())
    shown = PT.with_texts(trie.nodes, conversations(spark, rows)).select("conv_id", "depth", "role", "text").collect()
    assert len(shown) == len(wanted(rows)) and all((r.role, r.text) == (seqs[r.conv_id][r.depth - 1] if r.depth else (None, None)) for r in shown)


def test_other_groups(spark):
    rows = rows_with_trouble()
    assert digest_rows(PT.conversation_trie(conversations(spark, rows), group=5, most=3)) == wanted(rows, 5, 3)


def test_small_tables(spark):
    one = [(1, 0, None, None)]
    assert digest_rows(PT.conversation_trie(conversations(spark, one))) == wanted(one)
    for rows in (conversations(spark, one).limit(0), conversations(spark, [(None, 1, "a", "b")])):
        assert digest_rows(PT.conversation_trie(rows)) == []


def test_end_digests_go_on_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(3, 1, 2, c) for c in range(100, 0, -1)] + [(3, 1, 5, c) for c in (-4, 9)] + [(0, 0, 0, 1000)]
        got = {r.conv_id: r.ends_sha256 for r in PT.end_digests(spark.createDataFrame(rows, "length long, k1 long, k2 long, conv_id long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    lists = {1: range(1, 101), -4: (-4, 9), 1000: (1000,)}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in lists.items()}


def test_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op11_conversation_trie", _trie, sql.PREFIX_TRIE) is None
