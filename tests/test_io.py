"""Readers on small files, and upserts."""

from pyspark.sql import functions as F

from loadlark.sources import io


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert [r.x for r in io.read_json_list(spark, str(tmp_path / "a.json"), "x int").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": \n{"x": 3}\n')
    assert [r.x for r in io.read_json_lines(spark, str(tmp_path / "b.jsonl"), "x int").collect()] == [1, 3]
    (tmp_path / "c.csv").write_text("﻿Rate;Notes\n 100 ;call; x\n;\n", encoding="utf-8")
    rows = io.read_semicolon_csv(spark, str(tmp_path / "c.csv"))
    assert rows.columns == ["Rate", "Notes"] and rows.first().Rate == "100"
    (tmp_path / "k.json").write_text('{"a": {"x": 1}, "b": {"x": null}}')
    assert [tuple(r) for r in io.read_keyed_json(spark, str(tmp_path / "k.json"), "x int").orderBy("key").collect()] == [("a", 1), ("b", None)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one_active.json").write_text('{"x": 7}')
    (tmp_path / "r" / "two.json").write_text('{"x": 8}')
    assert [r.x for r in io.read_active(spark, str(tmp_path / "r"), "x int").collect()] == [7]


def test_upsert_and_children(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 3), (3, "e", 1)], "k int, v string, o int")
    assert [r.v for r in io.upsert(old, new, ["k"], "o").orderBy("k").collect()] == ["a", "d", "e"]
    both = io.union_sources(old, new.withColumn("w", F.lit(1)))
    assert both.count() == 5 and both.where("w IS NULL").count() == 2
    lists = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "k int, items array<string>")
    assert [tuple(r) for r in io.children(lists, "k", "items").collect()] == [(1, 0, "x"), (1, 1, "y")]
