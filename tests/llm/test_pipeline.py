"""The pipeline against the same stages in plain Python, each on what the one before kept."""

import hashlib
from math import ceil

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_line_dedup import brute as lines_by_definition
from tests.llm.test_mixing import targets
from tests.llm.test_near_dup import brute as near_by_definition
from weftline.llm import bpe_text, language_id


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        results.append(docs.collect())
    accepted, deduped, distinct, mixed, encoded = results
    for kept in results[:-1]:
        assert kept[0].asDict().keys() == next(iter(rows.values())).asDict().keys()

    model = language_id.train_on(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = language_id.Predictor(model)
    want = {d for d, r in rows.items() if not own.predict([r.text])[2][0]}
    assert {r.doc_id for r in accepted} == want and all(r == rows[r.doc_id] for r in accepted)
    assert len(want) > 0.97 * len(rows)

    want = {d: t for d, _, t, n in lines_by_definition(sorted((d, rows[d].text) for d in want), 50) if not n or t.strip()}
    assert {r.doc_id: r.text for r in deduped} == want
    assert all(r.n_chars == len(r.text) or r.text == rows[r.doc_id].text for r in deduped)

    near = {d for d, _, _, kept in near_by_definition(sorted(want.items()), 5) if kept}
    assert sorted(r.doc_id for r in distinct) == sorted(near) and {r.doc_id: r.text for r in distinct} == {d: want[d] for d in near}

    size = {d: len(want[d].split()) for d in near}
    by_source = {}
    for d in near:
        by_source.setdefault(rows[d].source, []).append(d)
    goal = targets({s: sum(size[d] for d in ds) for s, ds in by_source.items()})
    copies = {}
    for source, ds in by_source.items():
        total, left = sum(size[d] for d in ds), int(goal[source] + 1e-6)
        start = 0
        for d in sorted(ds, key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
            taken = left // total * size[d] + max(0, min(size[d], left % total - start))
            copies[d] = ceil(taken / size[d]) if size[d] else 0
            start += size[d]
    assert sorted(r.doc_id for r in mixed) == sorted(d for d, n in copies.items() for _ in range(n))

    words = Tokenizer.from_file(bpe_text.DEFAULT_TOKENIZER)
    words.no_truncation()
    words.no_padding()
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mixed)
    for r in encoded:
        ids = words.encode(want[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, words.decode(ids, skip_special_tokens=False))


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids", "decoded"]
