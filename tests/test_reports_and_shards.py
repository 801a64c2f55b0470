"""Rendered tables and shards that are written once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import reports
from tidemark.sources import stored, tables


def lines(df):
    return [r["text"] for r in df.orderBy("part", "line").collect()]


def test_marks_in_cells_are_escaped(spark):
    df = spark.createDataFrame([("b|c", "5%_&<x>"), ("a", None)], "A string, B string")
    assert lines(reports.rendered(df, "markdown", ["A"])) == ["| A | B |", "| --- | --- |", "| a |  |", r"| b\|c | 5%_&<x> |"]
    latex = lines(reports.rendered(df, "latex", ["A"], caption="C", label="t"))
    assert latex[2:5] == [r"\caption{C}", r"\label{t}", r"\begin{tabular}{ll}"] and latex[8:10] == [r"a &  \\", r"b|c & 5\%\_\&<x> \\"] and latex[-1] == r"\end{table}"
    assert lines(reports.rendered(df, "html", ["A"]))[4] == "<tr><td>b|c</td><td>5%_&amp;&lt;x&gt;</td></tr>"


@pytest.mark.parametrize(("form", "text"), [("markdown", "_No rows._"), ("latex", "% No rows."), ("html", '<p id="table">No rows.</p>')])
def test_a_table_without_rows_says_so(spark, form, text):
    assert lines(reports.rendered(spark.createDataFrame([], "A string"), form, ["A"])) == [text]


def test_equal_rows_of_a_report_stay_and_unknown_forms_are_refused(spark):
    df = spark.createDataFrame([("a",), ("a",)], "A string")
    assert lines(reports.rendered(df, "markdown", ["A"]))[2:] == ["| a |", "| a |"]
    with pytest.raises(ValueError, match="unknown form"):
        reports.rendered(df, "pdf", ["A"])


def test_shards_are_written_once(spark, tmp_path):
    root = str(tmp_path / "raw")
    assert tables.write_shards(spark.createDataFrame([], "year int, x int"), root, "t") == []
    assert tables.write_shards(spark.createDataFrame([(2020, 1)], "year int, x int"), root, "t") == ["year=2020"]
    more = spark.createDataFrame([(2020, 9), (2021, 2), (2021, 2), (None, 3)], "year int, x int")
    assert tables.write_shards(more, root, "t") == ["year=2021", "year=__HIVE_DEFAULT_PARTITION__"]
    assert tables.write_shards(more, root, "t") == []
    assert sorted((r["year"] or 0, r["x"]) for r in tables.read_shards(spark, root, "t").collect()) == [(0, 3), (2020, 1), (2021, 2), (2021, 2)]
    assert stored.matches(spark, f"{root}/_t_*") == []  # nothing hidden is left


def test_quotes_are_doubled(spark):
    row = spark.createDataFrame([("o'x", 'a"b')], "t string, n string").select(fn.quoted(F.col("t")).alias("t"), fn.quoted(F.col("n"), '"').alias("n"), fn.text_hash(F.lit("abc")).alias("h")).first()
    assert tuple(row) == ("'o''x'", '"a""b"', "ba7816bf8f01cfea")
