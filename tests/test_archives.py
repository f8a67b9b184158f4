"""JSON arrays in ZIP archives: whole, broken, large, filtered."""

import json
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import archives as Z

ROWS = [{"id": k, "kind": "ab"[k % 2], "text": 'x,]}"\\ é' * (k % 5), "deep": [{"a": [1, {"b": "]"}]}]} for k in range(200)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(at / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("all.json", json.dumps(ROWS, ensure_ascii=False, indent=1))
        z.writestr("none.json", " [ ] ")
        z.writestr("plain.json", '[1, "two", null, true, [3]]')
        z.writestr("notes.txt", "[1]")
    with zipfile.ZipFile(at / "two.zip", "w") as z:
        z.writestr("odd.json", '[{"id": 1, "kind": "a"}, {broken}, {"id": 2, "kind": "a"}, ' + '{"id": 3, "text": "' + "y" * 5000 + '"}, {"id": 4, "kind": "a"}]')
        z.writestr("cut.json", '[{"id": 5, "kind": "a"}, {"id": 6')
    (at / "three.zip").write_bytes(b"no archive")
    return str(at)


def test_elements_at_any_cut():
    whole = json.dumps(ROWS, ensure_ascii=False).encode()
    r = random.Random(1)
    for size in (1, 2, 3, 7, 100, 10**6):
        at, blocks = 0, []
        while at < len(whole):
            n = r.randint(1, size)
            blocks.append(whole[at : at + n])
            at += n
        assert [json.loads(e) for e, p in Z.elements(iter(blocks)) if p is None] == ROWS


def test_archives_are_read(spark, folder):
    Z.register(spark)
    rows = spark.read.format("zipped_json").option("element_bytes", "1000").load(folder).collect()
    of = lambda f: sorted((r for r in rows if r.file == f), key=lambda r: r.at)
    assert [json.loads(r.element) for r in of("all.json")] == ROWS and [r.at for r in of("all.json")] == list(range(200))
    assert [json.loads(r.element) for r in of("plain.json")] == [1, "two", None, True, [3]] and not of("none.json") and not of("notes.txt")
    assert [(r.at, r.element is None) for r in of("odd.json")] == [(0, False), (1, True), (2, False), (3, True), (4, False)]
    assert [r.problem for r in of("odd.json")][3] == "longer than 1000 bytes" and [(r.at, r.problem) for r in of("cut.json")][1] == (1, "the array does not end")
    assert [r.archive.endswith("three.zip") and r.problem is not None for r in rows if r.file is None] == [True]
    assert spark.read.format("zipped_json").load(f"{folder}/one.zip").count() == 205


def test_filters_reach_the_reader(spark, folder):
    Z.register(spark)
    df = spark.read.format("zipped_json").schema("id string, kind string, deep string, file string, problem string").load(f"{folder}/one.zip")
    got = df.filter("kind = 'b' and id in ('3', '5', '8')")
    assert sorted(r.id for r in got.collect()) == ["3", "5"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "= b" not in plan and "IN (" not in plan  # nothing is left of them above the reader
    by_option = spark.read.format("zipped_json").option("field", "kind").option("values", "a").load(f"{folder}/one.zip")
    assert by_option.count() == 100 and df.filter(F.col("file") == "plain.json").count() == 5


def test_memory_stays_small():
    block = json.dumps({"id": 1, "text": "z" * 900}).encode()

    def blocks():
        yield b"["
        for _ in range(20_000):  # 18 MB
            yield block + b", "
        yield block + b"]"

    tracemalloc.start()
    n = sum(1 for _ in Z.elements(blocks()))
    assert n == 20_001 and tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
