"""Language identification: held-out accuracy, calibration and odd inputs."""

import zlib

import numpy as np

from weftline.llm import language_id
from weftline.llm.entries import _languages

SCHEMA = "doc_id long, text string, lang string, score string, found string"


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = _languages(spark, folder).collect()
    assert len(got) == len(truth) and {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    own = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.rejected for r in got]) < 0.02


def documents(n=300):
    rng = np.random.default_rng(2)
    stems = {"aa": ["ka", "ti", "mo", "ru"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["é", "oux", "tion", "ç"]}
    rows = []
    for k in range(n):
        lang = list(stems)[k % 3]
        words = ["".join(rng.choice(stems[lang], rng.integers(1, 4))) for _ in range(rng.integers(5, 60))]
        rows.append((k, " ".join(words), lang, "x", "y"))
    return rows


def test_odd_texts(spark):
    rows = documents() + [(1000, None, "aa", "x", "y"), (1001, "", "aa", "x", "y"), (1002, "12 ½ ,. _", None, "x", "y"), (None, "schein ung", None, "x", "y"),
                          (1003, "kati " * 50_000, "aa", "x", "y"), (1003, "kati " * 50_000, "aa", "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = language_id.identify(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is None:
            assert (r.held_out, r.lang_pred, r.rejected) == (False, "bb", False)
        else:
            assert r.lang_pred == ("aa" if r.doc_id == 1003 else ["aa", "bb", "cc"][r.doc_id % 3])
    again = language_id.identify(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in got} == {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in again}
    kept = language_id.without_rejected(frame)
    assert kept.columns == frame.columns and kept.count() == len(rows) - 3


def test_every_label_is_learned(spark, monkeypatch):
    """More languages than 500, and fewer documents of each where the sample is small."""
    rows = [(k, f"word{k % 510} text", f"l{k % 510}", "x", "y") for k in range(2040)]
    labels = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert len(labels) > 500 and set(language_id.train_on(frame).languages) == labels
    monkeypatch.setattr(language_id, "SAMPLE", 600)
    assert set(language_id.train_on(frame).languages) == labels


def test_no_labels_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "word", None, "x", "y"), (2, "  ", None, "x", "y")], SCHEMA)
    assert sorted((r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(frame).collect()) == [(1, "und", False), (2, "und", True)]
    assert language_id.identify(frame.limit(0)).count() == 0


def test_prediction_is_the_sum_of_subwords(monkeypatch):
    samples = []
    for _, text, lang, *_ in documents(90):
        counts = language_id.text_counts(text)
        samples.append((lang, np.array(sorted(counts)), np.array([counts[b] for b in sorted(counts)])))
    model = language_id.train(samples)
    monkeypatch.setattr(language_id, "TABLE_BYTES", 0)
    own = language_id.Predictor(model)
    unbroken = "".join(t for _, t, *_ in documents(12)).replace(" ", "")
    for text in [t for _, t, *_ in documents(30)] + ["a b " + unbroken + " c", unbroken]:
        counts = language_id.text_counts(text)
        n = sum(counts.values())
        odds = model.scores(sum(model.table[b] * c for b, c in counts.items())[None, :], np.array([n]))
        name, score, _ = own.predict([text])
        assert name[0] == model.languages[int(odds.argmax())] and abs(score[0] - odds.max()) < 1e-5
        assert max(map(len, own.places), default=0) <= language_id.LONGEST_KEPT


def test_subwords_of_long_words_come_in_pieces(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 7)
    for word in ("a", "ab", "abcdef", "abcdefghi", "zürich" * 9, "日本語" * 30):
        want = np.bincount(language_id.subwords(word), minlength=language_id.BUCKETS)
        assert (language_id.bucket_counts(word) == want).all()
        counts = language_id.text_counts(f"{word} x {word}")
        assert {b: int(n) for b, n in counts.items()} == {
            int(b): int(n) for b, n in enumerate(2 * want + np.bincount(language_id.subwords("x"), minlength=language_id.BUCKETS)) if n
        }


def test_no_label_leaks_into_predictions(spark):
    """Labels, sources and ids of held-out documents change nothing."""
    rows = documents()
    changed = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 3 == 1 else lang, "s", "y") for d, t, lang, *_ in rows]
    a, b = (language_id.identify(spark.createDataFrame(x, SCHEMA)).collect() for x in (rows, changed))
    assert {(r.doc_id, r.lang_pred) for r in a} == {(r.doc_id, r.lang_pred) for r in b}
