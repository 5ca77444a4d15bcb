import gc
import json
import random
import tracemalloc
import weakref

import pyarrow as pa
import pytest

from weftline.llm import bpe_text, language_id, line_dedup, near_dup


@pytest.mark.parametrize("following", [language_id._features, line_dedup._line_table, near_dup._sketcher(5)])
def test_tables_of_a_stage_go_when_the_next_takes_the_worker(following):
    with open(bpe_text.DEFAULT_TOKENIZER, encoding="utf-8") as file:
        content = file.read()
    encoder = bpe_text._encoder(content)
    assert encoder.encode(["one two"]) == bpe_text._encoder(content).encode(["one two"])
    assert bpe_text._encoder(content) is encoder
    kept = weakref.ref(encoder)
    del encoder
    texts = pa.array(["a few words"])
    if following is language_id._features:
        columns = [pa.array(["en"]), texts, pa.array([1])]
    elif following is line_dedup._line_table:
        columns = [pa.array([1]), pa.array([2]), texts]
    else:
        columns = [pa.array([1]), texts]
    (found,) = following([pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])])
    assert found.num_rows == 1
    gc.collect()
    assert kept() is None


def test_an_entry_of_the_encoder_is_small():
    """A chunk and the words in it take under 250 bytes of Python's memory each, room of the dict included (168, and 319 when ids and texts were kept written out)."""
    with open(bpe_text.DEFAULT_TOKENIZER, encoding="utf-8") as file:
        encoder = bpe_text.TextEncoder(json.load(file))
    rng = random.Random(8)
    made = {"".join(rng.choice("abcdeeehiinorsttt") for _ in range(rng.randint(4, 10))) for _ in range(20_000)}
    text = " ".join(w if k % 4 else f"{w}," for k, w in enumerate(sorted(made)))
    encoder.encode(["first words, and considerably longer ones"])
    tracemalloc.start()
    try:
        encoder.encode([text])
        encoder.words.follows.clear()
        encoder.words.paths.pairs.clear()
        encoder.words.whole.clear()
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 250 * len(made)


def test_the_driver_gives_the_room_of_the_sample_back(spark, sf_dir, monkeypatch):
    held = []
    monkeypatch.setattr(language_id, "give_back", lambda: held.append(pa.total_allocated_bytes()), raising=False)
    before = pa.total_allocated_bytes()
    assert language_id.train_on(spark.read.parquet(f"{sf_dir}/documents.parquet")) is not None
    assert len(held) == 1 and held[0] <= before
