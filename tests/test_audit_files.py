"""Audit logs as files: byte ranges, blank lines, odd names, the order of long runs."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from belegwerk.sources import audit_files


def test_blank_lines_do_not_count_and_empty_runs_stay(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"seq":0}\n\n  \n{"seq":1}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n", encoding="utf-8")
    (tmp_path / "d.jsonl").write_text('{"seq":0}\r\n \r\n{"text":"a b\\rc"}', encoding="utf-8")
    runs, lines = audit_files.read_audit_log(spark, str(tmp_path))
    assert {r.run_id for r in runs.collect()} == {"a", "b", "d"}
    assert {(r.run_id, r.line_no, r.line) for r in lines.collect()} == {
        ("a", 0, '{"seq":0}'), ("a", 1, '{"seq":1}'), ("d", 0, '{"seq":0}\r'), ("d", 1, '{"text":"a b\\rc"}')}


@pytest.fixture
def small_ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    yield
    spark.conf.set(key, before)


def test_one_long_log_is_read_by_many_tasks_in_order(spark, tmp_path, small_ranges):
    size = 60_000
    with open(tmp_path / "long.jsonl", "w", encoding="utf-8") as out:
        for k in range(size):
            out.write(f'{{"seq":{k},"note":"{"x" * (k % 90)}"}}\n' + ("\n" if k % 7 == 0 else ""))
    (tmp_path / "short.jsonl").write_text('{"seq":0}\n' * 3, encoding="utf-8")
    lines = audit_files.read_audit_log(spark, str(tmp_path))[1]
    raw = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 30
    wrong = lines.where("run_id = 'long'").where(F.get_json_object("line", "$.seq").cast("int") != F.col("line_no"))
    assert wrong.count() == 0 and lines.where("run_id = 'long'").agg(F.max("line_no")).first()[0] == size - 1
    assert sorted(r.line_no for r in lines.where("run_id = 'short'").collect()) == [0, 1, 2]


def test_round_trip_of_long_runs_and_odd_names(spark, tmp_path, small_ranges):
    names = ["plain", "with space", "%41", "a%2Fb", "a/b", "100%", "x+y", "über", "_hidden", ".dot"]
    rows = [(n, k, f"{n}-{k} {'y' * (k % 50)}") for n in names for k in range(3)] + [("long", k, f"{k} é") for k in range(20_000)]
    df = spark.createDataFrame(rows, "run_id string, seq int, line string").repartition(9)
    folder = str(tmp_path / "out")
    for _ in range(2):  # Writing again replaces.
        audit_files.write_audit_log(df, folder)
    assert len(os.listdir(folder)) == len(names) + 1 and not any(os.path.isdir(os.path.join(folder, f)) for f in os.listdir(folder))
    got = {tuple(r) for r in audit_files.read_audit_log(spark, folder)[1].collect()}
    assert got == set(rows)
    with pytest.raises(Exception, match="without a run"):
        audit_files.write_audit_log(spark.createDataFrame([(None, 1, "x")], df.schema), folder)
    audit_files.write_audit_log(df.limit(0), str(tmp_path / "none"))
