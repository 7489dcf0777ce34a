"""Exports are whole or absent, once, and read back as they were."""

import pytest
from pyspark.sql import functions as F

from veritrace.sources import exports

ROWS = [("a.json", '{"x":1}'), ("b.json", "two\nlines"), ("c", ""), ("é +ü%41.json", "ß")]
SCHEMA = "file_name string, value string"


def pairs(df):
    return sorted((r["file_name"], r["value"]) for r in df.collect())


def shown(path):
    return sorted(p.name for p in path.rglob("*") if p.is_file())


def test_files_read_back_as_they_were_and_equal_names_are_numbered(spark, tmp_path):
    df = spark.createDataFrame([*ROWS, ("a.json", "other"), ("c", "d")], SCHEMA)
    exports.export_files(df, str(tmp_path))
    want = {"a-2.json", "a.json", "b.json", "c", "c-2", "é +ü%41.json"}
    assert set(shown(tmp_path)) == want
    got = pairs(exports.read_files(spark, str(tmp_path)))
    assert sorted(v for _, v in got if v) == sorted(r["value"] for r in df.collect() if r["value"])
    assert {n for n, v in got if v} | {"c"} == want
    assert not list(tmp_path.glob("_*"))


def test_paths_are_those_of_spark(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    (tmp_path / "with space").mkdir()
    for path in (f"file://{tmp_path}/one", f"{tmp_path}/with space/two"):
        exports.export_files(df, path)
        assert pairs(exports.read_files(spark, path)) == ROWS[:1]
    assert exports._address(spark, "some/where").endswith("/some/where") and exports._address(spark, "some/where").startswith("file:///")


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(0, 400).select(F.format_string("f%d.json", "id").alias("file_name"), F.when(F.col("id") != 399, "x").alias("value"))
    exports.export_files(spark.createDataFrame(ROWS[:1], SCHEMA), str(tmp_path), "one")
    for name in (bad, spark.createDataFrame([("../up", "x")], SCHEMA), spark.createDataFrame([("_hidden", "x")], SCHEMA)):
        with pytest.raises(Exception, match="not a file that can be exported"):
            exports.export_files(name, str(tmp_path), "two")
    assert shown(tmp_path) == ["a.json"] and not list(tmp_path.glob("_*"))


def test_batches_are_written_once_and_overwritten_together(spark, tmp_path):
    one, two = (spark.createDataFrame([(n, n)], SCHEMA) for n in ("one", "two"))
    for _ in range(2):
        exports.export_files(one, str(tmp_path), "1")
    exports.export_files(two, str(tmp_path), "2")
    assert shown(tmp_path) == ["one", "two"]
    exports.export_files(two, str(tmp_path), "3", "overwrite")
    assert shown(tmp_path) == ["two"] and [p.name for p in tmp_path.iterdir()] == ["batch-3"]
    exports.export_files(one.limit(0), str(tmp_path), "4", "overwrite")
    assert shown(tmp_path) == []


def test_attempts_that_did_not_count_are_taken_out(tmp_path):
    from pyspark.sql import Row

    w = exports._Writer(str(tmp_path), "files", None, False)
    lost, won = (w.write(iter([Row(file_name="x", value=v)])) for v in ("lost", "won"))
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith("_")]
    w.commit([won, None])
    assert [p.read_text() for p in tmp_path.rglob("x")] == ["won"] and lost.folder != won.folder
    w.abort([])  # nothing is staged any more


def test_lines(spark, tmp_path):
    schema = "run_id string, event string, seq long"
    rows = [("r", 'a "quoted"\nevent', 1), ("r", None, 2), (None, "x", 3)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    exports.append_lines(df, str(tmp_path), "1")
    exports.append_lines(df, str(tmp_path), "1")
    exports.append_lines(df, str(tmp_path), "2")
    got = sorted((tuple(r) for r in exports.read_lines(spark, str(tmp_path), schema).collect()), key=repr)
    assert got == sorted(rows * 2, key=repr)
