"""A table's state merges, is stored, and saves scans."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tabulens.operators.state import merged
from tabulens.plans.ingest import ingest, open_dataset
from tabulens.plans.report import analyze, auto_report, describe, describe_from


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("state") / "t")
    spark.range(900).selectExpr(
        "id", "if(id % 9 = 0, null, id * 1.5) as v", "if(id % 4 = 1, double('nan'), id % 7 - 3.0) as w",
        "concat('c', id % 6) as c", "concat('t', id) as t", "id % 2 = 0 as b", "array(id) as nested",
        "date_format(date_add(date'2024-01-01', int(id % 40)), 'dd/MM/yyyy') as d", "if(id < 3, '2024-05-06', null) as few",
        "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, int(id)) as at", "string(null) as none",
    ).write.parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or a == b or (math.isnan(a) and math.isnan(b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


@pytest.mark.parametrize("cut", ["id < 450", "id < 1", "id < 3", "id < 0", "id % 2 = 0", "id % 9 = 0"])
def test_two_states_merge_to_that_of_the_union(table, cut):
    one, other = describe(table.where(cut)).state, describe(table.where(f"NOT ({cut})")).state
    whole = describe(table).state
    assert same(merged(one, other), whole) and same(merged(other, one), whole)


def test_a_list_of_values_is_given_up_beyond_its_limit(spark):
    parts = [describe(spark.range(i * 40, i * 40 + 40).selectExpr("concat('g', id) as g")).state for i in (0, 1)]
    assert len(parts[0]["columns"]["g"]["values"]) == 40
    both = merged(*parts)
    assert both["columns"]["g"]["values"] is None and merged(both, parts[0])["columns"]["g"]["values"] is None


def test_other_columns_do_not_merge(spark):
    a, b = (describe(spark.range(5).selectExpr(e)).state for e in ("id", "string(id) as id"))
    with pytest.raises(ValueError):
        merged(a, b)
    with pytest.raises(ValueError):
        describe_from(spark.range(5), b)


def test_a_state_describes_its_table(table):
    known = describe(table)
    again = describe_from(table, json.loads(json.dumps(known.state)))
    assert again.types == known.types and again.row_count == 900
    assert [same(a, b) for a, b in zip(again.basics, known.basics)] == [True] * len(table.columns)
    assert [same(a, b) for a, b in zip(again.rows, known.rows)] == [True] * len(table.columns)


def jobs_of(spark, run):
    group = f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_stored_dataset_is_opened_and_analysed_without_a_scan(spark, table, tmp_path):
    stored = str(tmp_path / "stored")
    done = ingest(spark, table.drop("nested", "none", "few"), stored)
    found = {}

    def opened():
        frame, described = open_dataset(spark, stored)
        found["reports"] = [auto_report(frame, described=described), analyze(frame, described=described)]

    # Spark looks at the files for their schema; nothing else runs.
    assert jobs_of(spark, opened) <= 4
    for report, direct in zip(found["reports"], (auto_report(done.frame, described=done.described), analyze(done.frame, described=done.described))):
        assert [(c.type, c.x_label, c.y_label) for c in report.charts] == [(c.type, c.x_label, c.y_label) for c in direct.charts]
        assert len(report.charts) >= 3
    assert found["reports"][0].insights == auto_report(done.frame, described=done.described).insights


def test_a_dataset_whose_dates_became_texts_is_described_anew(spark, table, tmp_path):
    stored = str(tmp_path / "lines")
    ingest(spark, table.select("id", "c", "at"), stored, store_format="json")
    frame, described = open_dataset(spark, stored)
    assert dict(frame.drop("__position").dtypes)["at"] == "string"
    assert {t.column: t.semantic_type for t in described.types}["at"] == "date"
    assert frame.select(F.max("id")).first()[0] == 899
