import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions import scalars as S


def column(spark, values, dtype):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_exact_round_is_python_round(spark, digits):
    rng = random.Random(7)
    values = [21816.12875, 2.675, 0.285, -2.5, 0.0, 1e9 / 7, 123456789.125]
    values += [rng.uniform(-1e6, 1e6) for _ in range(500)]
    values += [rng.randrange(10**6) / 8 for _ in range(500)]
    values += [rng.randrange(10**7) / 200 for _ in range(500)]
    rows = column(spark, values, "double").select("v", S.exact_round(F.col("v"), digits).alias("r")).collect()
    assert [r["r"] for r in rows] == [round(r["v"], digits) for r in rows]


def test_exact_round_of_special_values(spark):
    values = [float("inf"), float("-inf"), None, 1e300]
    rows = column(spark, values, "double").select(S.exact_round(F.col("v"), 2)).collect()
    assert [r[0] for r in rows] == values


def test_float_text_is_python_text(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, -2.5, 1e7, 12345678.9, 1e15, 9.5e15, 1e16, 1.5e300, 0.001, 0.0001, 0.00012, 1e-5, -1.5e-7]
    values += [rng.randrange(10**9) / 100 for _ in range(300)]
    values += [float(rng.randrange(10**12)) for _ in range(100)]
    rows = column(spark, values, "double").select("v", S.float_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [repr(r["v"]) for r in rows]


def test_iso_text(spark):
    moments = [datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60), datetime(2024, 1, 2, 3, 4, 5, 500000), None]
    rows = column(spark, moments, "timestamp_ntz").select(S.iso_text(F.col("v"), T.TimestampNTZType())).collect()
    assert [r[0] for r in rows] == [m and m.isoformat() for m in moments]
    days = column(spark, [date(2024, 2, 29)], "date").select(S.iso_text(F.col("v"), T.DateType()))
    assert days.first()[0] == "2024-02-29T00:00:00"


def test_label_text(spark):
    booleans = column(spark, [True, False, None], "boolean")
    rows = booleans.select(S.label_text(F.col("v"), T.BooleanType())).collect()
    assert [r[0] for r in rows] == ["True", "False", None]


def test_nan_becomes_null_in_floats_only(spark):
    df = spark.createDataFrame([(float("nan"), "x", 1), (2.0, "NaN", None)], "a double, b string, c int")
    assert [tuple(r) for r in S.normalise_missing(df).collect()] == [(None, "x", 1), (2.0, "NaN", None)]


def test_total_survives_64_bit_overflow(spark):
    df = column(spark, [2**62, 2**62, 2**62], "bigint")
    assert df.agg(S.total(F.col("v"), T.LongType())).first()[0] == pytest.approx(3 * 2.0**62)
    exact = column(spark, [2**53, 1], "bigint").agg(S.total(F.col("v"), T.LongType())).first()[0]
    assert exact == float(2**53 + 1)


def test_ratio_and_variation(spark):
    row = spark.range(1).select(
        S.ratio(F.lit(1), F.lit(0)), S.variation(F.lit(2.0), F.lit(0.0)), S.variation(F.lit(2.0), F.lit(-4.0))
    ).first()
    assert tuple(row) == (None, 0.0, -0.5)


def test_safe_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0), (None, 1.0, 5.0)], "x double, y double, c double")
    row = df.agg(S.safe_corr(F.col("x"), F.col("y")), S.safe_corr(F.col("x"), F.col("c"))).first()
    assert row[0] == pytest.approx(4.5 / (2 * 61 / 6) ** 0.5)
    assert row[1] is None


def test_parse_timestamp_is_strict(spark):
    values = ["2024-01-02", "2024-13-02", "02/01/2024", "2024-01-02x", ""]
    rows = column(spark, values, "string").select(S.parse_timestamp(F.col("v"), "yyyy-MM-dd")).collect()
    assert [r[0] for r in rows] == [datetime(2024, 1, 2), None, None, None, None]


def test_looks_like_id(spark):
    names = ["order_ID", "width", "paid", "Index", "line_number", "price", "Numero"]
    rows = column(spark, names, "string").select(S.looks_like_id(F.col("v"))).collect()
    assert [r[0] for r in rows] == [True, True, True, True, True, False, True]


def test_text_timestamps_do_not_depend_on_the_zone(spark):
    from datetime import datetime

    from tabulens.functions.scalars import parse_timestamp

    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        df = spark.createDataFrame([("2024-03-31 02:30:00",), ("2024-10-27 02:30:00",), ("1800-01-01 00:00:01",), ("no",)], "t string")
        found = [r[0] for r in df.select(parse_timestamp(F.col("t"), "yyyy-MM-dd HH:mm:ss")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == [datetime(2024, 3, 31, 2, 30), datetime(2024, 10, 27, 2, 30), datetime(1800, 1, 1, 0, 0, 1), None]
