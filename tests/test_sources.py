import itertools
import json
import random

import pytest

from wareloom.sources import files
from wareloom.sources.json_object import iter_object, register


def made_object(seed, n):
    rng = random.Random(seed)
    words = ["壶", "lid", "\\", '"', "{", "}", "é", "\t", "a,b", ""]
    return {f"k{i}{rng.choice(words)}": {w: [rng.randrange(9), None, {"in": rng.choice(words)}] for w in rng.sample(words, 3)} for i in range(n)}


@pytest.mark.parametrize("seed, indent", list(itertools.product(range(3), [None, 1])))
def test_an_object_comes_back_in_order_whatever_the_window(tmp_path, seed, indent):
    made, path = made_object(seed, 25), tmp_path / "made.json"
    path.write_text(json.dumps(made, ensure_ascii=seed % 2 == 0, indent=indent), encoding="utf-8-sig" if seed else "utf-8")
    for window in (3, 50, 10**6):
        assert list(iter_object(str(path), window)) == list(made.items())
    assert list(iter_object(f"file://{path}", 64)) == list(made.items())


def test_every_cut_and_every_spare_mark_is_an_error(tmp_path):
    """Breakages are made from a sound file: all prefixes, and a mark put in or taken out between two records."""
    sound, path = json.dumps(made_object(5, 3)), tmp_path / "cut.json"
    middle = sound.index("}, \"k1") + 1
    broken = [sound[:n] for n in range(len(sound))] + [sound + mark for mark in ("}", "1", '"')] + [sound[:middle] + ",," + sound[middle + 1 :], sound[:middle] + sound[middle + 1 :], sound.replace('{"k0', '{7:{},"k0', 1)]
    for text in broken:
        path.write_text(text)
        with pytest.raises(ValueError):
            list(iter_object(str(path), 11))
    path.write_text(json.dumps({"long": {"v": "y" * 900}}))
    with pytest.raises(ValueError):
        list(iter_object(str(path), 32, 400))


def test_nothing_and_the_same_id_again(tmp_path):
    path = tmp_path / "few.json"
    path.write_text(" { } \n", encoding="utf-8")
    assert list(iter_object(str(path))) == []
    pairs = [("again", {"n": i}) for i in range(3)]
    path.write_text("{" + ",".join(f"{json.dumps(k)}:{json.dumps(v)}" for k, v in pairs) + "}")
    assert list(iter_object(str(path), 5)) == pairs


def test_data_source_reads_a_folder_in_parallel(spark, tmp_path):
    register(spark)
    parts = {f"part{i}.json": made_object(20 + i, 6) for i in range(4)}
    for name, made in parts.items():
        (tmp_path / name).write_text(json.dumps(made), encoding="utf-8")
    (tmp_path / "notes.txt").write_text("no object")
    df = spark.read.format("json_object").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    want = sorted((key, json.dumps(value, sort_keys=True)) for made in parts.values() for key, value in made.items())
    assert sorted((r["id"], json.dumps(json.loads(r["record"]), sort_keys=True)) for r in df.collect()) == want


def test_csv_text_and_writes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,note\n1,"two\nlines"\n2,"say ""hi"""\n', encoding="utf-8")
    df = files.read_csv_text(spark, str(path), ["id"])
    assert sorted(tuple(r) for r in df.collect()) == [("1", "two\nlines"), ("2", 'say "hi"')]
    with pytest.raises(ValueError):
        files.read_csv_text(spark, str(path), ["missing"])
    out = str(tmp_path / "out")
    files.write_new(df, out, "json")
    with pytest.raises(Exception):
        files.write_new(df, out, "json")
    assert files.read_jsonl(spark, out, "id string, note string").count() == 2
    files.write_related({"x": df, "y": df}, str(tmp_path / "set"), "v1")
    assert spark.read.json(str(tmp_path / "set" / "_manifest")).head()["version"] == "v1"
    files.write_new(df, str(tmp_path / "parts"), partition_by=["id"])
    assert {p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()} == {"id=1", "id=2"}


def test_config_report_and_replaced_output(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1, "b": [2]}')
    assert files.load_config(str(tmp_path / "c.json"), ["a", "b"]) == {"a": 1, "b": [2]}
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path / "c.json"), ["a", "z"])
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path / "d.json"), [])
    report = str(tmp_path / "r.json")
    files.write_report(spark.createDataFrame([("壶", 2)], "name string, n int"), report)
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"name": "壶", "n": 2}
    with pytest.raises(FileExistsError):
        files.write_report(spark.createDataFrame([("壶", 2)], "name string, n int"), report)
    with pytest.raises(ValueError):
        files.write_report(spark.range(2), str(tmp_path / "s.json"))
    out = str(tmp_path / "table")
    for n in (3, 5):
        files.replace_output(spark.range(n), out)
        assert spark.read.parquet(out).count() == n
    with pytest.raises(Exception):
        files.replace_output(spark.range(4).selectExpr("raise_error('stop') AS x"), out)
    assert spark.read.parquet(out).count() == 5 and sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("table._old")) == []


def test_files_that_are_there(spark, tmp_path):
    (tmp_path / "yes.bin").write_bytes(b"1")
    rows = spark.createDataFrame([(str(tmp_path / "yes.bin"),), (str(tmp_path / "no.bin"),), (str(tmp_path),), (None,), (" ",)], "path string")
    assert [r["exists"] for r in files.existing_files(rows.coalesce(1), "path").collect()] == [True, False, False, False, False]


def test_contracts(spark):
    df = spark.createDataFrame([("a", "s", 0), ("a", "t", 1), ("b", "s", 2)], "id string, scope string, n int")
    assert files.read_scoped(df, "s", "id").count() == 2
    with pytest.raises(ValueError):
        files.read_catalogue(df, "id", ["id"])
    with pytest.raises(ValueError):
        files.read_catalogue(df.limit(0), "id", ["id"])
    assert files.slice_rows(df, "n", 1, 2).count() == 2
    with pytest.raises(ValueError):
        files.slice_rows(df, "n", 1, 3)


def test_vector_index_is_checked_when_read(spark, tmp_path):
    rows = [(i, [float(i), 3.0, 4.0]) for i in range(1, 30)] + [(90, None), (91, [0.0] * 3), (92, [1.0])]
    path = str(tmp_path / "index")
    files.write_vector_index(spark.createDataFrame(rows, "id bigint, embedding array<float>"), path, 3)
    got = files.read_vector_index(spark, path)
    assert got.count() == 29 and abs(sum(x * x for x in got.where("id = 7").head()["embedding"]) - 1) < 1e-6
    (tmp_path / "index" / "index.json").write_text('{"rows": 30, "ids": 30, "dim": 3}')
    with pytest.raises(ValueError):
        files.read_vector_index(spark, path)
    twice = str(tmp_path / "twice")
    files.write_vector_index(spark.createDataFrame(rows[:3] + rows[:1], "id bigint, embedding array<float>"), twice, 3)
    with pytest.raises(ValueError):
        files.read_vector_index(spark, twice)
