"""Arrays in files, cut into small byte ranges."""

import json
import random

import pytest

from weftline.plans.lineage import settings
from weftline.sources import json_arrays as J, products as SP


def write(folder, **files):
    folder.mkdir()
    for name, body in files.items():
        (folder / f"{name}.json").write_bytes(body.encode())
    return str(folder)


def read(spark, path, size):
    with settings(spark, spark__sql__files__maxPartitionBytes=str(size), spark__sql__files__openCostInBytes="1"):
        rows = J.array_elements(spark, path).collect()
        ranges = J._pieces(spark, path).select("file", "range").distinct().count()
    out = {}
    for r in sorted(rows, key=lambda r: r.element):
        out.setdefault(r.file.rsplit("/", 1)[1].removesuffix(".json"), []).append((r.element, r.text, r.whole))
    return out, ranges


def items():
    rng = random.Random(4)
    odd = ['}', '{', '"}', '\\', '\\"', '],[', ',', 'ä𝄞', '\n', '}}]"', '']
    deep = lambda n: {"k": deep(n - 1), "l": [1, {"m": "}"}]} if n else []
    return [{"id": n, "name": "".join(rng.choices(odd, k=rng.randint(0, 6))), "d": deep(n % 4), "x{": [[], {}]} for n in range(20)] + [{}]


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_elements_of_a_split_file(spark, tmp_path, size):
    rows = items()
    path = write(tmp_path / "f", plain=json.dumps(rows), pretty="﻿ \n" + json.dumps(rows, indent=2, ensure_ascii=False) + "\n ", one=json.dumps(rows[:1]), none="[ ]")
    got, ranges = read(spark, path, size)
    assert set(got) == {"plain", "pretty", "one"}
    for name, want in (("plain", rows), ("pretty", rows), ("one", rows[:1])):
        assert [n for n, _, _ in got[name]] == list(range(len(want))) and all(w for _, _, w in got[name])
        assert [json.loads(t) for _, t, _ in got[name]] == want
    assert size > 1000 or ranges > 4


def test_files_that_are_no_array(spark, tmp_path):
    bad = {
        "object": '{"id": 1}', "open": '[{"id": 1}', "torn": '[{"id": 1}, {"id"', "number": '[{"id": 1}, 5, {"id": 2}]', "comma": '[{"id": 1} {"id": 2}]',
        "after": '[{"id": 1}] x', "two": '[{"id": 1}][{"id": 2}]', "nested": '[[{"id": 1}]]', "text": "hello }", "quote": '[{"id": "1}]', "extra": '[{"id": 1}]}', "empty": "",
    }
    got, _ = read(spark, write(tmp_path / "f", good='[{"id": 1}]', **bad), 1 << 20)
    assert got.pop("good") == [(0, '{"id": 1}', True)]
    assert all(not whole for rows in got.values() for _, _, whole in rows)


def test_one_broken_element_spoils_its_file_only(spark, tmp_path):
    item = {"id": 1, "name": "n", "price": 2, "stock": 3}
    path = write(tmp_path / "f", a=json.dumps([item, {**item, "id": 2}]), b='[{"id": 3, "name": "n"}, {"id": oops}]', c="[]")
    assert sorted(r.id for r in SP.read_products(spark, path).collect()) == [1, 2]
    assert SP.read_products(spark, str(tmp_path / "nowhere")).count() == 0
