"""One key holds a third of all rows, and no join may broadcast by size."""

import pytest
from pyspark.sql import functions as F

from tabulens.operators import charts as C
from tabulens.operators.audit import audit_unique, orphan_keys, orphan_rows
from tabulens.operators.clean import clean_table
from tabulens.operators.history import latest_completed, runs_newest_first
from tabulens.operators.insights import top_groups, trend
from tabulens.operators.profile import numeric_profile, text_profile

ROWS = 120_000
HOT = ROWS // 3


@pytest.fixture(autouse=True, scope="module")
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def rows(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(ROWS).select(
        "id",
        F.when(hot, 7).otherwise(F.col("id")).alias("key"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("cold"), "id")).alias("name"),
        F.when(hot, 0.5).otherwise(F.col("id") + 1.0).alias("value"),
    )


def test_groups(rows):
    assert [tuple(r) for r in top_groups(rows, "name", "value").collect()][0] == (f"cold{ROWS - 1}", float(ROWS))
    assert C.pie_chart(rows, "name").first()["y"] == HOT
    assert C.pie_chart(rows, "key", "value").count() == ROWS - HOT
    assert trend(rows, "key", "value").first()["groups"] == ROWS - HOT


def test_sorted_output_is_spread(rows):
    parts = C.pie_chart(rows, "key", "value").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 4


def test_profiles(rows):
    text = text_profile(rows, ["name"]).first()
    assert (text["unique_count"], text["mode_value"]) == (ROWS - HOT + 1, "hot")
    assert [t["count"] for t in text["top_values"]] == [HOT] + [1] * 9
    assert [t["value"] for t in text["top_values"]][1:4] == ["cold1", "cold10", "cold100"]
    numbers = {r["column"]: r for r in numeric_profile(rows, ["value", "id"]).collect()}
    assert (numbers["value"]["mode"], numbers["value"]["q25"]) == (0.5, 0.5)
    assert numbers["id"]["median"] == (ROWS - 1) / 2 and numbers["id"]["mode"] == 0.0


def test_cleaning(rows):
    gappy = rows.select(
        "id", F.when(F.col("name") != "hot", F.col("value")).alias("v"), F.nullif("name", F.lit("hot")).alias("n")
    )
    done = clean_table(gappy)
    assert (done.filled["v"][0], done.dropped, done.rows_after) == (HOT, {"n": HOT}, ROWS - HOT)


def test_references(spark, rows):
    parents = spark.range(8, ROWS).select("id")  # the hot key 7 is missing
    found = {r["key"]: r["n_rows"] for r in orphan_keys(rows, "key", parents, "id").collect()}
    assert found == {7: HOT + 1, 1: 1, 2: 1, 4: 1, 5: 1}
    lost = orphan_rows(rows, "key", parents, "id")
    assert lost.count() == HOT + 5 and lost.columns == rows.columns
    # No task gets all rows of the frequent key, whether it is sent to the rows or not.
    parts = lost.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < HOT / 2
    assert audit_unique(rows, "t", "key").first()["violations"] == HOT


def test_no_orphan_key_is_frequent(rows, spark, monkeypatch):
    monkeypatch.setattr("tabulens.operators.audit.FREQUENT_ORPHANS", 0)
    parents = spark.range(8, ROWS).select("id")
    assert orphan_rows(rows, "key", parents, "id").count() == HOT + 5


def test_runs(rows):
    runs = rows.select(
        F.col("key").alias("user_id"), "id", F.col("name").alias("file_name"), F.lit("COMPLETED").alias("status"),
        F.lit(None).cast("string").alias("results"), F.lit(1).alias("tokens_consumed"),
        F.timestamp_seconds("id").alias("created_at"),
    )
    latest = latest_completed(runs)
    assert latest.count() == ROWS - HOT
    assert latest.where("user_id = 7").first()["id"] == ROWS - 3
    parts = (
        runs_newest_first(runs)
        .withColumn("part", F.spark_partition_id())
        .where("user_id = 7")
        .groupBy("part")
        .count()
        .collect()
    )
    assert len(parts) >= 2 and max(r["count"] for r in parts) < HOT
