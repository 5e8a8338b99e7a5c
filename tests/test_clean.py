import random

import pandas as pd
import pytest
from pyspark.sql import types as T

from tabulens.operators.clean import clean_table, cleaning_report


def by_pandas(pdf):
    """The cleaning rules, written with pandas."""
    filled, dropped, before = {}, {}, len(pdf)
    for name in pdf.select_dtypes("number"):
        gaps = int(pdf[name].isna().sum())
        if gaps:
            mean = float(pdf[name].mean())
            filled[name] = {"count": gaps, "fill_value": round(mean, 4)}
            pdf[name] = pdf[name].fillna(mean)
    for name in pdf.select_dtypes(exclude="number"):
        gaps = int(pdf[name].isna().sum())
        if gaps:
            dropped[name] = gaps
            pdf = pdf.dropna(subset=[name])
    return pdf, {"numeric_filled": filled, "text_rows_dropped": dropped, "rows_before": before, "rows_after": len(pdf)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_agrees_with_pandas(spark, seed):
    rng = random.Random(seed)

    def gap(value):
        return None if rng.random() < 0.2 else value

    rows = [
        (i, gap(rng.random() * 100), gap(rng.randrange(9)), gap(rng.choice("abc")), gap(rng.choice("xy")), gap(rng.random() < 0.5))
        for i in range(400)
    ]
    schema = "k bigint, f double, n bigint, s string, t string, b boolean"
    done = clean_table(spark.createDataFrame(rows, schema))
    pdf = pd.DataFrame(rows, columns=["k", "f", "n", "s", "t", "b"])
    pdf[["f", "n"]] = pdf[["f", "n"]].astype(float)
    expected, report = by_pandas(pdf)
    assert done.as_dict() == report
    actual = done.frame.orderBy("k").toPandas()
    assert list(actual["k"]) == list(expected["k"])
    assert actual["n"].tolist() == pytest.approx(expected["n"].tolist())
    assert actual["f"].tolist() == pytest.approx(expected["f"].tolist())


def test_untouched_columns_keep_their_type(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, None, "b")], "whole int, gappy int, s string")
    frame = clean_table(df).frame
    assert frame.schema["whole"].dataType == T.IntegerType()
    assert frame.schema["gappy"].dataType == T.DoubleType()


def test_mean_covers_rows_that_are_dropped_later(spark):
    df = spark.createDataFrame([(10.0, None), (None, "a"), (2.0, "b")], "x double, s string")
    assert [tuple(r) for r in clean_table(df).frame.orderBy("s").collect()] == [(6.0, "a"), (2.0, "b")]


def test_nan_is_filled(spark):
    done = clean_table(spark.createDataFrame([(float("nan"),), (4.0,)], "x double"))
    assert [r["x"] for r in done.frame.collect()] == [4.0, 4.0]


def test_column_without_values_stays_empty(spark):
    done = clean_table(spark.createDataFrame([(None, 1), (None, 2)], "x double, y int"))
    assert done.filled == {"x": (2, None)}
    assert [r["x"] for r in done.frame.collect()] == [None, None]


def test_drops_can_leave_nothing(spark):
    done = clean_table(spark.createDataFrame([("a", None), (None, "b")], "x string, y string"))
    assert (done.rows_after, done.frame.count(), done.dropped) == (0, 0, {"x": 1, "y": 1})


def test_report_is_one_scan(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    plan = cleaning_report(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_dotted_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "`a.1` double, `b c` string")
    done = clean_table(df)
    assert done.as_dict()["numeric_filled"] == {"a.1": {"count": 1, "fill_value": 2.0}}
    assert done.frame.count() == 2
