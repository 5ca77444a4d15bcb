"""Line dedup against its definition, run by run."""

import random
import re

from weftline.llm import line_dedup, sql
from weftline.llm.entries import _lines
from tests.compare import compare, connect

SCHEMA = "doc_id long, text string, n_lines string, carried string, n_chars long"


def brute(docs, min_words):
    """Every run of lines, against every earlier run."""
    seen, out = {}, []
    for doc, text in docs:
        lines = text.split("\n") if text else []
        own = [(n, x.strip(" \t\x0b\x0c\r"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for n, x in enumerate(lines)]
        own = [x for x in own if x[2]]
        runs = [(s, e) for s in range(len(own)) for e in range(s, len(own)) if sum(x[2] for x in own[s : e + 1]) >= min_words]
        drop = set()
        for s, e in runs:
            run = tuple(x[1] for x in own[s : e + 1])
            first = seen.setdefault(run, (doc, s, e))
            if first[0] != doc or s > first[2]:
                drop.update(range(own[s][0], own[e][0] + 1))
        kept = "\n".join(x for n, x in enumerate(lines) if n not in drop) if text else text
        out.append((doc, len(lines), kept, len(drop)))
    return out


def run(spark, docs, min_words):
    frame = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], SCHEMA).repartition(3)
    done = line_dedup.remove_repeated_lines(frame, min_words=min_words)
    return sorted(((r.doc_id, r.n_lines, r.text, r.n_removed) for r in done.collect()), key=lambda r: (r[0] is not None, r[0]))


def test_runs_of_lines(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(25)]
    docs = []
    for doc in range(60):
        lines = [rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 14))]
        if rng.random() < 0.5 and docs:
            other = rng.choice(docs)[1].split("\n")
            at = rng.randint(0, len(other))
            lines[len(lines) // 2 : len(lines) // 2] = other[at : at + rng.randint(1, 6)]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), "  ")
        docs.append((doc, "\n".join(lines)))
    docs += [(100, "x\n" * 60), (101, None), (102, ""), (103, "\n \n"), (104, "x\n" * 60), (105, "y z " * 30_000)]
    for least in (5, 12):
        assert run(spark, docs, least) == brute(docs, least)


def test_null_and_repeated_ids(spark):
    a, b = "one two three\nfour five six", "one two three\nfour five six\nseven"
    got = run(spark, [(None, a), (None, a), (1, b), (2, a), (2, a)], 6)
    assert got == [(None, 2, a, 0), (None, 2, a, 0), (1, 3, "seven", 2), (2, 2, "", 2), (2, 2, "", 2)]
    assert run(spark, [], 6) == []


def test_documents_keep_their_columns(spark):
    frame = spark.createDataFrame([(1, "a b c", "k", "l", 5), (2, "a b c\nnew", "m", "n", 9), (3, " a b c ", "o", "p", 7)], SCHEMA)
    done = line_dedup.without_repeated_lines(frame, min_words=3)
    assert done.columns == frame.columns
    assert sorted(tuple(r) for r in done.collect()) == [(1, "a b c", "k", "l", 5), (2, "new", "m", "n", 3)]


def test_windows_cover_every_run():
    words = line_dedup.np.array([3, 1, 1, 5, 2, 8])
    assert list(zip(*(x.tolist() for x in line_dedup.windows(words, 6)), strict=True)) == [(0, 3), (1, 3), (2, 3), (3, 4), (4, 5), (5, 5)]


def test_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op1_line_dedup", _lines, sql.LINE_DEDUP) is None
