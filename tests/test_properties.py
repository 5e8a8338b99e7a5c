"""Random tables against pandas."""

import io

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulens.functions.columns import POSITION
from tabulens.operators import charts as C
from tabulens.operators.insights import correlation, top_groups
from tabulens.operators.profile import numeric_profile, text_profile
from tabulens.operators.quantiles import exact_quantiles
from tabulens.sources.csv import read_csv

few = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

values = st.one_of(
    st.none(), st.integers(-5, 5).map(lambda i: i / 4), st.floats(-1e6, 1e6, allow_nan=False)
)
keys = st.one_of(st.none(), st.sampled_from(["a", "b", "ab", "", "É", "z"]))
pairs = st.lists(st.tuples(keys, values, values), min_size=1, max_size=60)


def frames(spark, rows):
    schema = "x string, y double, z double"
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=["x", "y", "z"]).astype(
        {"y": float, "z": float}
    )


def plain(series):
    return [None if pd.isna(v) else float(v) for v in series]


@few
@given(rows=pairs)
def test_grouped_values(spark, rows):
    df, pdf = frames(spark, rows)
    for how in ("sum", "mean", "count"):
        found = C.xy_chart(df, "x", "y", how).collect()
        expected = getattr(pdf.groupby("x")["y"], how)()
        assert [r["label"] for r in found] == list(expected.index)
        assert [r["y"] for r in found] == pytest.approx(plain(expected))


@few
@given(rows=pairs)
def test_numeric_profile(spark, rows):
    df, pdf = frames(spark, rows)
    found = {r["column"]: r for r in numeric_profile(df, ["y", "z"]).collect()}
    for name in ("y", "z"):
        series = pdf[name].dropna()
        row = found[name]
        assert (row["count"], row["null_count"]) == (len(series), len(pdf) - len(series))
        if len(series):
            assert row["mode"] == series.mode().iloc[0]
            for stat, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
                assert row[stat] == pytest.approx(series.quantile(q), abs=1e-9)
        if len(series) > 1:
            assert row["std"] == pytest.approx(series.std(), abs=1e-6)


@few
@given(rows=pairs)
def test_text_profile(spark, rows):
    df, pdf = frames(spark, rows)
    row = text_profile(df, ["x"]).first()
    counts = pdf["x"].dropna().value_counts()
    expected = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    assert [(t["value"], t["count"]) for t in row["top_values"]] == expected
    assert row["unique_count"] == len(counts)
    if expected:
        assert row["mode_value"] == pdf["x"].mode().iloc[0]


@few
@given(rows=pairs)
def test_top_groups_and_correlation(spark, rows):
    df, pdf = frames(spark, rows)
    sums = pdf.groupby("x")["y"].sum()
    expected = sums.sort_values(ascending=False).head(5)
    assert [r["y"] for r in top_groups(df, "x", "y").collect()] == pytest.approx(plain(expected))
    both = pdf[["y", "z"]].dropna()
    found = correlation(df, "y", "z").first()["correlation"]
    if len(both) > 1 and both["y"].nunique() > 1 and both["z"].nunique() > 1:
        assert found == pytest.approx(both["y"].corr(both["z"]), abs=6e-4)
    else:
        assert found is None


@few
@given(data=st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=5, max_size=80))
def test_histogram(spark, data):
    counts, _ = np.histogram(np.array(data), bins=10)
    df = spark.createDataFrame([(v,) for v in data], "v double")
    assert [r["y"] for r in C.histogram(df, "v").collect()] == counts.tolist()


@few
@given(data=st.lists(st.integers(-(2**40), 2**40), min_size=1, max_size=50), p=st.floats(0, 1))
def test_any_quantile_of_integers(spark, data, p):
    df = spark.createDataFrame([(v,) for v in data], "v bigint")
    assert exact_quantiles(df, ["v"], [p]).first()["q0"] == pytest.approx(
        float(np.quantile(data, p)), rel=1e-12, abs=1e-6
    )


cells = st.sampled_from(
    ["1", "-2", "3.5", "1e3", "NA", "", "null", "true", "False", "x", "y z", "a,b", 'q"q', "007", " 8", "N/A", "2024-01-02"]
)


@few
@given(rows=st.lists(st.tuples(cells, cells, cells), min_size=1, max_size=12))
def test_csv(spark, tmp_path_factory, rows):
    text = pd.DataFrame(rows, columns=["a", "b", "c"]).to_csv(index=False)
    path = tmp_path_factory.mktemp("csv") / "t.csv"
    path.write_text(text)
    expected = pd.read_csv(io.StringIO(text), sep=",", engine="python")
    expected = expected.dropna(how="all").dropna(axis=1, how="all")
    frame = read_csv(spark, str(path), separator=",")
    if not len(expected.columns):
        assert frame.count() == 0
        return
    found = frame.orderBy(F.col(POSITION)).drop(POSITION)
    assert found.columns == list(expected.columns)
    assert [tuple(r) for r in found.collect()] == [
        tuple(None if pd.isna(v) else v for v in row) for row in expected.itertuples(index=False)
    ]
