import pytest
from pyspark.sql import functions as F

from tabulens.operators.validate import validate_table


def check(spark, rows, schema, header=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, " + schema)
    df = df.withColumn("__position", F.col("place")).drop("place")
    return validate_table(df, header=header)


def test_clean_table(spark):
    found = check(spark, [(1, "a"), (2, "b")], "x int, y string")
    assert found.valid and found.checks == []
    assert (found.row_count, found.column_count, found.missing_pct) == (2, 2, 0.0)


def test_empty_table_stops(spark):
    found = check(spark, [], "x int")
    assert found.errors == ["empty_table"]
    assert (found.row_count, found.column_count) == (0, 0)


def test_trailing_empty_rows_are_tolerated(spark):
    found = check(spark, [(1, "a"), (2, "b"), (None, None)], "x int, y string")
    assert found.valid and found.warnings == ["empty_rows"]
    assert (found.row_count, found.missing_pct) == (2, 0.0)


def test_one_row_after_an_empty_one_is_tolerated(spark):
    found = check(spark, [(1, "a"), (None, None), (2, "b")], "x int, y string")
    assert found.valid and found.row_count == 2


def test_two_rows_after_an_empty_one_are_a_second_table(spark):
    found = check(spark, [(1, "a"), (None, None), (2, "b"), (3, "c")], "x int, y string")
    assert found.errors == ["stacked_tables", "missing_cells"]
    assert (found.row_count, found.missing_pct) == (4, 0.25)


def test_order_decides_what_follows_an_empty_row(spark):
    rows = [(3, 1, "a"), (1, 2, "b"), (2, 3, "c"), (4, None, None)]
    df = spark.createDataFrame(rows, "o int, x int, y string").withColumn("__position", -F.col("o")).drop("o")
    assert "stacked_tables" in validate_table(df).errors
    with pytest.raises(ValueError):
        validate_table(df.drop("__position"))


def test_empty_column_between_filled_ones(spark):
    found = check(spark, [(1, None, "a"), (2, None, "b")], "x int, n string, y string")
    assert found.errors == ["side_by_side_tables", "missing_cells"]
    assert (found.column_count, found.missing_pct) == (3, 0.3333)


def test_trailing_empty_column_is_ignored(spark):
    found = check(spark, [(1, "a", None), (2, "b", None)], "x int, y string, n string")
    assert found.valid and found.warnings == ["empty_columns"]
    assert (found.column_count, found.missing_pct) == (2, 0.0)


@pytest.mark.parametrize(
    "gaps, severity", [(19, None), (20, None), (21, "warning"), (50, "warning"), (51, "error")]
)
def test_missing_share_thresholds(spark, gaps, severity):
    rows = [(None if i < gaps else i, i) for i in range(500)]
    found = check(spark, rows, "x int, y int")
    assert found.missing_pct == gaps / 1000
    assert [c[1] for c in found.checks] == ([severity] if severity else [])


def test_nan_counts_as_missing(spark):
    found = check(spark, [(float("nan"), 1)] * 2 + [(1.0, 1)] * 8, "x double, y int")
    assert found.missing_pct == 0.1


def test_names(spark):
    found = check(spark, [(1, 2, 3)], "a int, `Unnamed: 1` int, `a.1` int", header=["a", "", "a"])
    assert found.errors == ["duplicate_columns"] and found.warnings == ["unnamed_columns"]
    assert check(spark, [(1,)], "_c0 int").warnings == ["unnamed_columns"]


def test_frames(spark):
    found = check(spark, [(1, None)] * 3, "x int, y int")
    assert found.summary_frame(spark).first().asDict() == {
        "valid": True, "row_count": 3, "column_count": 1, "missing_pct": 0.0,
    }
    assert found.checks_frame(spark).first()["check"] == "empty_columns"
