import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.operators import quantiles
from tabulens.operators.frequency import distinct_up_to, top_values, value_counts
from tabulens.operators.profile import (
    date_profile,
    numeric_profile,
    sample_rows,
    sample_stats,
    text_date_profile,
    text_profile,
    token_summary,
)
from tabulens.operators.quantiles import exact_quantiles
from tabulens.operators.types import by_kind, detect_types
from tabulens.plans.report import auto_report, describe


def numbers(spark, values, dtype="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def profile_of(spark, values, dtype="double"):
    return numeric_profile(numbers(spark, values, dtype), ["v"]).first().asDict()


@pytest.mark.parametrize("seed", range(4))
def test_numeric_statistics_are_those_of_pandas(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, rng.randrange(20) / 4, rng.gauss(0, 50)]) for _ in range(300)]
    found = profile_of(spark, values)
    series = pd.Series(values, dtype=float).dropna()
    expected = {
        "count": len(series),
        "null_count": len(values) - len(series),
        "mean": series.mean(),
        "median": series.median(),
        "mode": series.mode().iloc[0],
        "std": series.std(),
        "min": series.min(),
        "max": series.max(),
        "sum": series.sum(),
        "q25": series.quantile(0.25),
        "q75": series.quantile(0.75),
        "iqr": series.quantile(0.75) - series.quantile(0.25),
    }
    for stat, value in expected.items():
        assert found[stat] == pytest.approx(value), stat


def test_small_and_empty_columns(spark):
    one = profile_of(spark, [3.0, None])
    assert (one["std"], one["median"], one["iqr"], one["mode"]) == (None, 3.0, 0.0, 3.0)
    none = profile_of(spark, [None, float("nan")])
    assert (none["count"], none["null_count"]) == (0, 2)
    assert all(none[s] is None for s in ("mean", "median", "mode", "std", "min", "max", "sum", "q25", "iqr"))


def test_mode_takes_the_smallest_on_ties(spark):
    assert profile_of(spark, [5, 5, -1, -1, 7], "int")["mode"] == -1.0


def test_large_integers_are_not_merged(spark):
    big = 2**53
    assert profile_of(spark, [big, big + 1, big + 1], "bigint")["mode"] == float(big + 1)
    assert profile_of(spark, [big + 1, big, big], "bigint")["mode"] == float(big)


@pytest.fixture
def tight(monkeypatch):
    """Make every step of the quantile search happen on small tables."""
    monkeypatch.setattr(quantiles, "SMALL", 10)
    monkeypatch.setattr(quantiles, "MIN_SAMPLE", 400)
    monkeypatch.setattr(quantiles, "INSIDE_LIMIT", 20)


def skewed(kind, n=5000):
    rng = np.random.default_rng(5)
    return {
        "unique": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.34, 7.25, rng.normal(size=n) * 100),
        "hot_median": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)),
        "few": rng.integers(0, 5, n).astype(float),
        "constant": np.full(n, 3.5),
        "heavy_tail": np.exp(rng.normal(size=n) * 6),
        "integers": rng.integers(-(10**6), 10**6, n).astype(float),
    }[kind]


@pytest.mark.parametrize("kind", ["unique", "hot", "hot_median", "few", "constant", "heavy_tail", "integers"])
def test_quantile_search(spark, tight, kind):
    values = skewed(kind)
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(6)
    row = exact_quantiles(df, ["v"], probabilities).first()
    assert [row[f"q{j}"] for j in range(len(probabilities))] == pytest.approx(
        [float(np.quantile(values, p)) for p in probabilities]
    )


@pytest.mark.parametrize("kind", ["unique", "hot", "few"])
def test_misleading_sample_does_not_change_the_result(spark, tight, monkeypatch, kind):
    def mislead(values, brackets):
        for b in brackets:
            b.low, b.high = 1e6, 2e6

    monkeypatch.setattr(quantiles, "_tighten", mislead)
    values = skewed(kind, 2000)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = exact_quantiles(df, ["v"]).first()
    assert [row[f"q{j}"] for j in range(3)] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


@pytest.mark.parametrize("kind", ["unique", "hot_median", "constant", "heavy_tail", "far_apart"])
def test_counts_alone_find_the_ranks(spark, tight, monkeypatch, kind):
    """No sample ever helps; no bracket that is ranked may keep many values inside."""
    kept = []

    def pick(df, columns, brackets, modes=False):
        kept.extend(brackets)
        return plain(df, columns, brackets, modes)

    plain = quantiles.pick
    monkeypatch.setattr(quantiles, "pick", pick)
    monkeypatch.setattr(quantiles, "MAX_MISSES", 1)
    monkeypatch.setattr(quantiles, "_tighten", lambda _, bs: [setattr(b, "high", b.low) for b in bs])
    ends = np.concatenate([-1e300 - np.arange(500) * 1e290, 1e-300 + np.arange(500) * 1e-310, [-np.inf, np.inf]])
    values = ends if kind == "far_apart" else skewed(kind, 1501)
    probabilities = (0.0, 0.25, 0.4995, 0.5, 0.75, 1.0)
    row = exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": values})), ["v"], probabilities).first()
    ordered = np.sort(values)
    for j, p in enumerate(probabilities):
        rank = p * (len(values) - 1)
        low, high = ordered[math.floor(rank)], ordered[math.ceil(rank)]
        wanted = low + (high - low) * (rank - math.floor(rank)) if np.isfinite(low) else low
        assert row[f"q{j}"] == pytest.approx(wanted) or (math.isnan(row[f"q{j}"]) and not np.isfinite(low))
    assert all(len(np.unique(values[(values > b.low) & (values < b.high)])) <= 21 for b in kept)


def test_missed_brackets_are_found_again_without_counting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 10)
    monkeypatch.setattr(quantiles, "_tighten", lambda _, bs: [setattr(b, "high", b.low) for b in bs])
    found = profile_of(spark, [float(i) for i in range(101)])
    assert (found["q25"], found["median"], found["q75"], found["mode"]) == (25.0, 50.0, 75.0, 0.0)


def test_several_columns_at_once(spark, tight):
    frame = pd.DataFrame({k: skewed(k, 3000) for k in ("unique", "hot", "few")})
    frame["ints"] = np.arange(3000)[::-1] % 701
    found = {r["column"]: r for r in numeric_profile(spark.createDataFrame(frame), list(frame)).collect()}
    for name in frame:
        q = frame[name].quantile([0.25, 0.5, 0.75]).tolist()
        assert [found[name][s] for s in ("q25", "median", "q75")] == pytest.approx(q)
        assert found[name]["mode"] == frame[name].mode().iloc[0]


def test_approximate_profile(spark):
    values = [float(i % 1000) for i in range(10000)]
    found = numeric_profile(numbers(spark, values), ["v"], approx=True).first()
    assert found["median"] == pytest.approx(499.5, abs=5) and found["mode"] in values
    found = numeric_profile(numbers(spark, [*values, 7.0, None]), ["v"], approx=True).first()
    assert found["mode"] == 7.0
    empty = numeric_profile(numbers(spark, [None]), ["v"], approx=True).first()
    assert empty["mode"] is None and empty["median"] is None


def test_approximate_texts_are_complete(spark):
    long = "x" * 300
    values = [long + "a"] * 5 + [long + "b"] * 4 + [f"v{i % 3}" for i in range(9)] + [None]
    exact = text_profile(numbers(spark, values, "string"), ["v"]).first()
    assert text_profile(numbers(spark, values, "string"), ["v"], approx=True).first() == exact
    empty = text_profile(numbers(spark, [None], "string"), ["v"], approx=True).first()
    assert empty["unique_count"] == 0 and empty["top_values"] == []


def test_text_statistics(spark):
    values = ["b", "a", "b", None, "a", "c", ""]
    row = text_profile(numbers(spark, values, "string"), ["v"]).first()
    assert (row["count"], row["null_count"], row["unique_count"], row["mode_value"]) == (6, 1, 4, "a")
    assert [tuple(t) for t in row["top_values"]] == [("a", 2, 33.3), ("b", 2, 33.3), ("", 1, 16.7), ("c", 1, 16.7)]


def test_top_ten_of_many(spark):
    values = [f"v{i:03d}" for i in range(200) for _ in range(1 + (i % 13 == 0))]
    top = text_profile(numbers(spark, values, "string"), ["v"]).first()["top_values"]
    assert [t["value"] for t in top] == [f"v{i:03d}" for i in range(0, 130, 13)]
    assert all(t["count"] == 2 for t in top)


def test_top_values_are_limited_before_the_shuffle(spark):
    counts = value_counts(numbers(spark, ["a"], "string"), ["v"])
    plan = top_values(counts, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Partial") and plan.count("WindowGroupLimit") == 2


def test_frequency_table_is_shuffled_once(spark):
    df = spark.range(1000).selectExpr("cast(id % 7 as string) as v", "cast(id as string) as w")
    done = token_summary(df, ["v", "w"])
    done.collect()
    assert "ReusedExchange" in done._jdf.queryExecution().executedPlan().toString()


def by_hand(values):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:10]


STARTS = {
    "all differ": [chr(97 + i % 26) * 3 + str(i) for i in range(40)],
    "one start": ["same start " * 10] * 40,
    "short and long": ["same start " * (i % 12) for i in range(40)],
    "accents": ["éàü" * 30 + "😀" * (i % 3) for i in range(40)],
}


@pytest.mark.parametrize("starts", sorted(STARTS))
@pytest.mark.parametrize("repeats", ["unique", "pairs", "hot"])
def test_long_texts(spark, starts, repeats):
    texts = [s + "-" + "xyz"[i % 3] * (i * 7 % 300) + str(i) for i, s in enumerate(STARTS[starts])]
    copies = {"unique": 1, "pairs": 2, "hot": 1}[repeats]
    values = texts * copies + (texts[5:6] * 50 + texts[7:8] * 20 if repeats == "hot" else []) + [None]
    row = text_profile(numbers(spark, values, "string"), ["v"]).first()
    expected = by_hand(values)
    assert [(t["value"], t["count"]) for t in row["top_values"]] == expected
    assert (row["unique_count"], row["mode_value"]) == (len(set(texts)), expected[0][0])


def test_long_texts_are_not_shuffled(spark):
    long = spark.range(300).select(F.concat(F.repeat(F.col("id").cast("string"), 400)).alias("v"))
    assert value_counts(long, ["v"], shorten=True).agg(F.max(F.length("value"))).first()[0] == 128


def test_boolean_values_print_capitalised(spark):
    row = text_profile(numbers(spark, [True, False, True], "boolean"), ["v"]).first()
    assert (row["mode_value"], [t["value"] for t in row["top_values"]]) == ("True", ["True", "False"])


def test_nested_columns_get_counts_only(spark):
    df = spark.createDataFrame([([1.0],), (None,)], "v array<double>")
    row = text_profile(df, ["v"]).first()
    assert tuple(row)[1:] == (1, 1, None, None, None)
    assert detect_types(df)[0].semantic_type == "text"


def test_empty_text_column(spark):
    row = text_profile(numbers(spark, [None, None], "string"), ["v"]).first()
    assert tuple(row)[1:] == (0, 2, 0, None, [])


def test_elapsed_days(spark):
    rows = [(datetime(2024, 1, 1, 23),), (datetime(2024, 1, 2, 1),), (None,)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    assert tuple(date_profile(df, {"t": None}).first())[1:] == (2, 1, "2024-01-01T23:00:00", "2024-01-02T01:00:00", 0)
    texts = numbers(spark, ["01/02/2024", "28/01/2024"], "string")
    assert tuple(date_profile(texts, {"v": "dd/MM/yyyy"}).first())[3:] == ("2024-01-28T00:00:00", "2024-02-01T00:00:00", 4)


def kinds(spark, values, dtype="string", **options):
    return detect_types(numbers(spark, values, dtype), **options)[0].semantic_type


def test_types_by_column_type(spark):
    assert kinds(spark, [1, 2], "int") == "integer"
    assert kinds(spark, [1, None], "int") == "float"
    assert kinds(spark, [1, 2], "int", had_gaps={"v"}) == "float"
    assert kinds(spark, [1.0], "float") == "float"
    assert kinds(spark, [True, False], "boolean") == "boolean"
    assert kinds(spark, [datetime(2024, 1, 1)], "timestamp") == "date"


def test_string_types(spark):
    assert kinds(spark, ["2024-01-01", None, "2024-12-31"]) == "date"
    assert kinds(spark, ["2024-01-01", "01/02/2024"]) == "text"
    assert kinds(spark, ["2024-01-01 10:00:00", "2024-01-02 00:00:00"]) == "date"
    assert kinds(spark, ["2024", "1999"]) == "date"
    assert kinds(spark, ["a"] * 9 + ["b"]) == "text"  # share is exactly 0.2
    assert kinds(spark, ["a"] * 10 + ["b"]) == "categorical"
    assert kinds(spark, [str(i % 50) + "x" for i in range(1000)]) == "categorical"
    assert kinds(spark, [str(i % 51) + "x" for i in range(1000)]) == "text"
    assert kinds(spark, [None, None]) == "text"
    assert kinds(spark, []) == "text"


def test_strings_stay_text_on_request(spark):
    assert kinds(spark, ["2024-01-01", "2024-01-02"], infer_strings=False) == "text"
    assert kinds(spark, ["a"] * 20, infer_strings=False) == "text"


def test_booleans_with_gaps_are_values(spark):
    assert kinds(spark, [True, None] * 4, "boolean") == "text"
    assert kinds(spark, [True, False, None] * 6, "boolean") == "categorical"
    assert kinds(spark, [True, False] * 6, "boolean", had_gaps={"v"}) == "categorical"


DATES = [
    ["2024-01-05", "2024-12-31"], ["2024-1-5", "2024-12-31"], ["1/5/2024", "12/31/2024"], ["5/1/2024", "31/12/2024"],
    ["31/12/2024", "5/1/2024"], ["05-01-2024", "06-02-2024"], ["31-12-2024", "05-01-2024"], ["31.12.2024", "05.01.2024"],
    ["05.01.2024", "06.02.2024"], ["2024/01/05", "2024/12/31"], ["20240105", "20241231"], ["2024-01", "2024-12"],
    ["01/2024", "12/2024"], ["Jan 5, 2024", "Dec 31, 2024"], ["5 Jan 2024", "31 Dec 2024"],
    ["January 5, 2024", "December 31, 2024"], ["5 January 2024", "31 December 2024"], ["05-Jan-2024", "31-Dec-2024"],
    ["2024-01-05 10:20", "2024-12-31 23:59"], ["2024-01-05T10:20:30", "2024-12-31T10:20:30"],
    ["2024-01-05 10:20:30.5", "2024-01-05 10:20:30.25"], ["2024-01-05 10:20:30.123", "2024-01-05 10:20:30.456789"],
    ["01/05/2024 10:20", "12/31/2024 23:59"], ["31/12/2024 10:20:30", "01/05/2024 23:59:59"],
    ["01/05/2024 10:20 PM", "12/31/2024 11:59 AM"], ["2024", "1999"], ["1234", "5678"], ["12345", "67890"],
    ["5", "12"], ["a1", "b2"], ["2024-01-05", "2024-01-06 10:00:00"], ["2024-13-05", "2024-01-05"], ["Monday", "Tuesday"],
    ["2024-01-05T10:20:30Z", "2024-12-31T10:20:30Z"], ["1600-01-01", "2024-01-01"], ["2024-02-30", "2024-01-01"],
]


@pytest.mark.parametrize("values", DATES, ids=lambda v: v[0])
def test_texts_are_dates_where_pandas_reads_them(spark, values):
    try:
        expected = pd.to_datetime(pd.Series(values, dtype=object)).dt.tz_localize(None)
    except ValueError:
        expected = None
    found = detect_types(numbers(spark, values, "string"))[0]
    if values == ["5/1/2024", "31/12/2024"]:
        # The first value alone would suggest month-first and spoil the column.
        assert found.date_format == "d/M/yyyy" and expected is None
    elif expected is None:
        assert found.semantic_type == "text"
    else:
        row = date_profile(numbers(spark, values, "string"), {"v": found.date_format}).first()
        assert (row["min_date"], row["max_date"]) == (expected.min().isoformat(), expected.max().isoformat())


def test_dates_after_many_gaps(spark):
    assert kinds(spark, [None] * 3000 + ["2024-01-01"]) == "date"


def test_late_misfit_rules_a_format_out(spark):
    values = ["2024-01-01"] * 5000 + ["never"]
    assert kinds(spark, values) == "categorical"


def test_distinct_counts_around_the_limit(spark):
    df = spark.range(5000).selectExpr("string(id % 50) a", "string(id % 51) b", "string(id) c", "string(null) d")
    assert distinct_up_to(df, ["a", "b", "c", "d"], 50) == {"a": 50, "b": None, "c": None, "d": 0}
    assert distinct_up_to(df, ["a", "b"], 51) == {"a": 50, "b": 51}


def test_sketch_never_overstates_few_values(spark):
    """Fifty values of any kind are still counted, whatever their hashes."""
    shifts = [F.concat(F.lit(f"{i}-"), F.col("id") % 50).alias(f"c{i}") for i in range(60)]
    df = spark.range(500).select(*shifts)
    assert set(distinct_up_to(df, df.columns, 50).values()) == {50}


def test_describe_agrees_with_single_operators(spark):
    df = spark.range(500).selectExpr(
        "id", "id % 7 * 1.5 as f", "if(id % 9 = 0, null, id) as g", "concat('c', id % 4) as c",
        "date_format(date_add(date'2024-01-01', int(id % 30)), 'yyyy-MM-dd') as d", "id % 2 = 0 as b", "uuid() as u",
        "array(id) as nested", "timestamp_ntz'2024-01-01 00:00:00' as t",
    )
    described = describe(df)
    assert [t.semantic_type for t in described.types] == [
        "integer", "float", "float", "categorical", "date", "boolean", "text", "text", "date",
    ]
    assert described.types == detect_types(df)
    assert by_kind(described.types) == described.kinds
    assert described.row_count == 500 and described.metadata()["missing_values"] == 56
    rows = {r["column"]: r for r in described.profile.collect()}
    for row in numeric_profile(df, ["id", "f", "g"]).collect():
        assert {k: rows[row["column"]][k] for k in row.asDict()} == row.asDict()
    assert rows["c"]["unique_count"] == 4 and rows["b"]["mode_value"] == "False"
    assert rows["d"]["range_days"] == 29 and rows["t"]["range_days"] == 0
    assert rows["nested"]["unique_count"] is None


def test_describe_without_rows(spark):
    described = describe(numbers(spark, [], "string"))
    assert described.row_count == 0 and described.types[0].semantic_type == "text"
    assert math.isclose(described.metadata()["missing_values"], 0)


def test_samples(spark):
    df = spark.range(100).selectExpr("99 - id as k", "concat('c', id % 3) as c", "double('nan') as n", "uuid() as u")
    rows = sample_rows(df, F.col("k")).collect()
    assert [r["k"] for r in rows] == list(range(30)) and rows[0]["n"] is None
    stats = {r["column"]: r for r in sample_stats(describe(df).profile).collect()}
    assert set(stats) == {"k", "c", "n"}
    assert (stats["k"]["mean"], stats["k"]["median"], stats["k"]["top_values"]) == (49.5, 49.5, None)
    assert (stats["c"]["unique_count"], stats["c"]["top_values"]) == (3, ["c0", "c1", "c2"])


def test_unusual_column_names(spark):
    names = ["a.1", "b c", "Unnamed: 2", "back`tick", "été", "count", "value", "key", "n", "at"]
    df = spark.range(60).select(
        *[
            (F.concat(F.lit("v"), F.col("id") % 3) if i % 2 else F.col("id") * (i + 1.0)).alias(n)
            for i, n in enumerate(names)
        ]
    )
    report = auto_report(df, order_by=["a.1"])
    rows = {r["column"]: r for r in report.described.rows}
    assert list(rows) == names
    assert [rows[n]["unique_count"] for n in names[1::2]] == [3] * 5
    assert rows["a.1"]["median"] == 29.5 and rows["value"]["max"] == 59 * 7.0
    assert [c.data.count() for c in report.charts] == [3, 10, 60]
    assert sample_rows(df, F.col("`a.1`")).columns == names
    counts = value_counts(df, ["b c", "back`tick"]).collect()
    assert {r["column"] for r in counts} == {"b c", "back`tick"}
    assert len(exact_quantiles(df, ["a.1", "Unnamed: 2"]).collect()) == 2


def test_wide_tables_are_scanned_in_groups(spark):
    df = spark.range(50).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(70)])
    described = describe(df)
    assert [r["min"] for r in described.rows] == [float(i) for i in range(70)]
    assert all(r["median"] == 24.5 + i for i, r in enumerate(described.rows))


def test_certain_modes(spark, monkeypatch, tmp_path):
    """A frequent value is certainly the mode; among nearly unique ones the values are counted."""
    from tabulens.operators import quantiles as Q

    spark.range(60_000).selectExpr(
        "if(id % 3 = 0, 0.5, id * 1.25) as often", "id as unique", "if(id < 2, 7, id) as twice", "id % 5 as few"
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = Q.certain_modes(df, df.columns, [60_000] * 4)
    assert found == {0: 0.5, 3: 0.0}
    expected = [tuple(r) for r in numeric_profile(df, df.columns).collect()]
    monkeypatch.setattr("tabulens.functions.columns.LARGE_BYTES", 0)
    assert [tuple(r) for r in numeric_profile(df, df.columns).collect()] == expected
    shuffled = []
    pick = Q.pick
    monkeypatch.setattr("tabulens.operators.profile.pick", lambda d, c, b, modes=False: shuffled.append((modes, {x.source for x in b})) or pick(d, c, b, modes))
    numeric_profile(df, df.columns)
    assert shuffled == [(False, {0, 3}), (True, {1, 2})]


def test_types_take_two_aggregates(spark, monkeypatch, tmp_path):
    from tabulens.functions import columns
    from tabulens.operators import types

    spark.range(3000).selectExpr(
        "date_format(date_add(date'2024-01-01', int(id % 30)), 'dd/MM/yyyy') as d", "concat('c', id % 4) as c",
        "uuid() as u", "id % 2 = 0 as b", "if(id = 5, null, id % 3 = 0) as g", "id as i",
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    calls = []
    monkeypatch.setattr(types, "aggregated", lambda *a: calls.append(len(a[1])) or columns.aggregated(*a))
    found = {t.column: t.semantic_type for t in detect_types(df)}
    assert found == {"d": "date", "c": "categorical", "u": "text", "b": "boolean", "g": "categorical", "i": "integer"}
    assert len(calls) == 2
    assert [tuple(r) for r in text_date_profile(df).collect()] == [
        ("d", 3000, 0, "2024-01-01T00:00:00", "2024-01-30T00:00:00", 29)
    ]
    assert text_date_profile(df.select("c", "i")).collect() == []
