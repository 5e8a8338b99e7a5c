import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.operators import charts as C
from tabulens.plans.report import analyze, auto_report, describe


def frame(spark, rows, schema="x string, y double"):
    return spark.createDataFrame(rows, schema)


def points(df):
    return [tuple(r) for r in df.collect()]


GROUPS = [("a", 1.0), ("a", 3.0), ("b", None), ("b", float("nan")), (None, 9.0), ("c", -2.0)]


def test_group_rules(spark):
    df = frame(spark, GROUPS)
    assert points(C.xy_chart(df, "x", "y")) == [("a", 4.0), ("b", 0.0), ("c", -2.0)]
    assert points(C.xy_chart(df, "x", "y", "none")) == points(C.xy_chart(df, "x", "y", "anything"))
    assert points(C.xy_chart(df, "x", "y", "mean")) == [("a", 2.0), ("b", None), ("c", -2.0)]
    assert points(C.xy_chart(df, "x", "y", "count")) == [("a", 2.0), ("b", 0.0), ("c", 1.0)]
    assert points(C.bar_chart(df, "x", "y")) == [("a", 2.0), ("c", -2.0), ("b", None)]
    assert points(C.pie_chart(df, "x", "y")) == [("a", 4.0), ("b", 0.0), ("c", -2.0)]
    assert points(C.pie_chart(df, "x")) == [("a", 2.0), ("b", 2.0), ("c", 1.0)]


def test_limits(spark):
    df = spark.range(300).selectExpr("id % 100 as x", "double(id) as y")
    assert [p[0] for p in points(C.line_chart(df, "x", "y"))] == [str(i) for i in range(50)]
    assert [p[0] for p in points(C.bar_chart(df, "x", "y"))] == [str(i) for i in range(99, 84, -1)]
    assert [p[0] for p in points(C.pie_chart(df, "x"))] == [str(i) for i in range(10)]
    assert len(points(C.pie_chart(df, "x", "y"))) == 100


def test_labels(spark):
    df = spark.sql("SELECT * FROM VALUES (true, 1, 1.5D, timestamp_ntz'2024-01-02 00:00:00') AS t(b, i, d, t)")
    labels = [points(C.xy_chart(df, x, "i"))[0][0] for x in ("b", "d", "t")]
    assert labels == ["True", "1.5", "2024-01-02T00:00:00"]


def test_boolean_values_are_summed(spark):
    df = frame(spark, [("a", True), ("a", False), ("a", True)], "x string, y boolean")
    assert points(C.xy_chart(df, "x", "y")) == [("a", 2.0)]
    assert points(C.xy_chart(df, "x", "y", "mean"))[0][1] == pytest.approx(2 / 3)


@pytest.mark.parametrize(
    "values",
    [
        [1.0] * 5,
        list(range(11)),
        [i / 100 for i in range(11)] * 3,
        [0.1 * i for i in range(50)],
        [-5.5, 3.25, 1e9, -1e9, 0.0],
        list(np.random.default_rng(1).normal(size=500)),
        list(np.round(np.random.default_rng(2).uniform(0, 1, 500), 1)),
    ],
)
def test_histogram_is_that_of_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    counts, edges = np.histogram(np.array(values, dtype=float), bins=10)
    rows = C.histogram(df, "v").collect()
    assert [r["y"] for r in rows] == counts.tolist()
    assert [r["low"] for r in rows] + [rows[-1]["high"]] == edges.tolist()
    assert [r["label"] for r in rows] == [f"{a:.1f}–{b:.1f}" for a, b in zip(edges, edges[1:])]


def test_histogram_needs_five_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)] + [(None,)], "v double")
    assert C.histogram(df, "v") is None


def test_histogram_refuses_infinity(spark):
    df = spark.createDataFrame([(float("inf"),)] + [(1.0,)] * 5, "v double")
    with pytest.raises(C.Skipped):
        C.histogram(df, "v")


def test_scatter_takes_the_first_complete_pairs(spark):
    df = spark.range(1000).selectExpr("999 - id as k", "if(id % 2 = 0, id, null) as x", "double(id) as y")
    found = points(C.scatter_points(df, "x", "y", F.col("k")))
    assert found == [(float(i), float(i)) for i in range(998, 598, -2)]


def test_points_correlation(spark):
    def of(rows):
        return C.points_correlation(frame(spark, rows, "x double, y double")).first()[0]

    assert of([]) == 0.0 and of([(1.0, 2.0)]) == 0.0
    assert of([(1.0, 2.0), (1.0, 3.0)]) is None
    assert of([(1.0, 2.0), (2.0, 1.0)]) == pytest.approx(-1.0)


REFUSED = [
    {"x": "nope", "y": "y"},
    {"x": "x", "y": "nope"},
    {"x": "x"},
    {"x": "y", "y": "y"},
    {"x": "x", "y": "x2"},
    {"type": "pie", "x": "x", "y": "x2"},
    {"type": "scatter", "x": "x", "y": "y"},
    {"type": "scatter", "x": "y"},
    {"type": "line", "x": "x", "y": "d", "aggregation": "mean"},
    {},
]


@pytest.mark.parametrize("instruction", REFUSED)
def test_requests_that_do_not_fit(spark, instruction):
    df = spark.sql("SELECT 'a' AS x, 'b' AS x2, 1.0D AS y, date'2024-01-01' AS d")
    charts, skipped = C.build_charts(df, [instruction], F.lit(0))
    assert charts == [] and len(skipped) == 1


def test_defaults_and_dispatch(spark):
    df = spark.sql("SELECT 'a' AS x, 'b' AS x2, 1.0D AS y, 2 AS z, date'2024-01-01' AS d")
    wanted = [
        {"x": "x", "y": "y"},
        {"type": "radar", "x": "x", "y": "x2", "aggregation": "count"},
        {"type": "pie", "x": "x", "y": ""},
        {"type": "scatter", "x": "y", "y": "z", "id": "s", "title": "t", "description": "d"},
    ]
    charts, skipped = C.build_charts(df, wanted, F.lit(0))
    assert skipped == [] and [c.type for c in charts] == ["bar", "bar", "pie", "scatter"]
    assert charts[0].chart_id == "chart_1" and charts[0].title == "y by x"
    assert (charts[3].chart_id, charts[3].title, charts[3].description) == ("s", "t", "d")
    assert charts[0].payload()["data"] == {"labels": ["a"], "datasets": [{"label": "y", "data": [1.0]}]}
    assert charts[3].payload()["data"]["datasets"][0]["data"] == [{"x": 1.0, "y": 2.0}]
    table = [tuple(r) for r in C.charts_frame(charts).collect()]
    assert ("s", 0, None, 1.0, 2.0) in table and len(table) == 4


def test_long_table_keeps_display_order(spark):
    df = spark.range(400).selectExpr("string(id) as x", "double(-id) as y")
    chart = C.build_chart(df, {"type": "pie", "x": "x", "y": "y"}, F.lit(0))
    rows = C.charts_frame([chart]).orderBy("position").collect()
    assert [r["label"] for r in rows] == sorted(str(i) for i in range(400))


def test_only_needed_columns_are_read(spark, tmp_path):
    spark.range(10).selectExpr("id as x", "id as y", "id as unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = C.xy_chart(df, "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "IsNotNull(x)" in plan


def test_failed_charts_fall_back_to_the_automatic_ones(spark):
    df = spark.range(60).selectExpr("double(id % 13) as v", "double(id) as w", "concat('g', id % 3) as g")
    report = analyze(df, {"charts": [{"x": "none", "y": "v"}], "analyses": []}, order_by=["w"])
    assert [c.chart_id for c in report.charts] == ["auto_1", "auto_2", "auto_3"]
    assert len(report.skipped) == 1


def test_automatic_charts(spark):
    df = spark.range(60).selectExpr(
        "date_add(date'2024-01-01', int(id % 20)) as day", "double(id % 13) as v", "double(id) as w", "concat('g', id % 3) as g"
    )
    report = auto_report(df, order_by=["w"])
    assert [(c.type, c.x_label, c.y_label) for c in report.charts] == [
        ("line", "day", "v"), ("bar", "g", "v"), ("bar", "v", "rows"), ("scatter", "v", "w"),
    ]
    assert report.charts[3].description.startswith("Correlation: 0.")
    assert [i.column for i in report.insights] == ["v", "g", "w"]
    assert auto_report(spark.range(3).selectExpr("string(id) as t")).charts == []


def test_report_without_numbers(spark):
    df = spark.range(30).selectExpr("concat('g', id % 3) as g")
    report = analyze(df)
    assert report.charts == [] and [i.type for i in report.insights] == ["top_values"]
    assert describe(df).kinds["categorical"] == ["g"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["id % 5000", "string(id % 5000)", "id % 30", "if(id % 7 = 0, null, double(id % 900))"])
def test_first_keys_of_large_tables(spark, monkeypatch, tmp_path, key):
    """Only keys up to a bound from a sample are shuffled; the points stay the same."""
    spark.range(40_000).selectExpr(f"{key} as x", "double(id) as y", "string(id % 3) as g").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    wanted = [{"type": "line", "x": "x", "y": "y", "aggregation": "mean"}, {"x": "x", "y": "y"}, {"type": "pie", "x": "g"}]

    def found():
        charts, _ = C.build_charts(df, wanted, F.lit(0))
        return [points(c.data) for c in charts], sorted(map(str, C.charts_frame(charts).collect()))

    expected = found()
    monkeypatch.setattr(C, "SAMPLED", 0.1)
    monkeypatch.setattr("tabulens.functions.columns.LARGE_BYTES", 0)
    assert found() == expected
    assert "Subquery" in plan_of(C.line_chart(df, "x", "y"))
    few = df.where(C.first_keys(df, "x", 50)).select("x").distinct().count()
    assert 30 <= few <= 2500


def test_shared_points_are_those_of_single_charts(spark):
    df = spark.range(500).selectExpr(
        "id % 60 as k", "date_add(date'2024-01-01', int(id % 70)) as d", "if(id % 5 = 0, null, concat('g', id % 20)) as g",
        "if(id % 11 = 0, double('nan'), id * 1.5) as v", "id % 2 = 0 as b", "int(id) as i", "array(id % 3) as nested",
    )
    wanted = [
        {"type": kind, "x": x, "y": y, "aggregation": how}
        for kind, x, y, how in [
            ("line", "d", "v", "mean"), ("bar", "k", "v", "sum"), ("bar", "g", "b", "mean"), ("bar", "g", "i", "count"),
            ("pie", "g", None, ""), ("pie", "k", None, ""), ("pie", "k", "v", ""), ("scatter", "i", "v", "none"),
            ("line", "v", "i", "sum"), ("bar", "b", "i", "sum"), ("bar", "nested", "v", "sum"),
        ]
    ]
    charts, skipped = C.build_charts(df, wanted, F.col("i"))
    assert skipped == [] and sum(c.shared is not None for c in charts) == 8
    table = C.charts_frame(charts)
    for chart in charts:
        own = table.where(F.col("chart_id") == chart.chart_id).orderBy("position")
        mine = [(r["x"] if chart.type == "scatter" else r["label"], r["y"]) for r in own.collect()]
        alone = points(chart.data)
        assert [m[0] for m in mine] == [a[0] for a in alone]
        assert [m[1] for m in mine] == [pytest.approx(a[1], nan_ok=True) for a in alone]
        if chart.type != "scatter":
            assert chart.payload()["data"]["labels"] == [a[0] for a in alone]


def test_a_batch_reads_its_table_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 as a", "id % 5 as b", "double(id) as v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    batch = C.Batch(df)
    for x, how in (("a", "mean"), ("b", "sum"), ("a", "count")):
        batch.add(x, "v", how, 50)
    batch.add_histogram("v", C.bin_edges("v", 100, 0.0, 99.0))
    plan = plan_of(batch.points)
    assert plan.count("Scan parquet") == 1 and "WindowGroupLimit" in plan
    assert [r["y"] for r in batch.rows(3)] == [10.0] * 10


def test_bins_of_a_batch_are_those_of_the_histogram(spark):
    values = [0.1 * i for i in range(50)] + [4.9] * 3 + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    edges = C.bin_edges("v", 53, 0.0, 4.9)
    batch = C.Batch(df)
    batch.add_histogram("v", edges)
    assert [(r["label"], r["y"]) for r in batch.rows(0)] == [tuple(r) for r in C.histogram(df, "v").select("label", "y").collect()]
    # No value lies in the middle bins, but they are there.
    gap = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 10, 10)], "v double")
    batch = C.Batch(gap)
    batch.add_histogram("v", C.bin_edges("v", 5, 0.0, 10.0))
    assert [r["y"] for r in batch.rows(0)] == [3.0] + [0.0] * 8 + [2.0]


def test_a_large_pie_is_not_collected(spark, monkeypatch):
    monkeypatch.setattr(C, "LISTED_POINTS", 20)
    df = spark.range(100).selectExpr("id as x", "double(id) as y")
    charts, _ = C.build_charts(df, [{"type": "pie", "x": "x", "y": "y", "id": "all"}], F.lit(0))
    assert charts[0].payload()["data"] == {"table": "charts", "chart_id": "all"}
    assert C.charts_frame(charts).count() == 100
