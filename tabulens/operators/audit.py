"""Constraint and reference checks over the run-history tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import col, field_type, is_integral

# Allowed texts.
PLAN_TYPES = ("PAY_AS_YOU_GO", "MONTHLY_UNLIMITED")
RUN_STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
TRANSACTION_TYPES = ("purchase", "consumption")

#: Orphan keys that are sent to the rows, the most frequent ones.
FREQUENT_ORPHANS = 1000

# What each table promises.
REQUIRED = {
    "users": ("first_name", "last_name", "email", "plan_type", "token_balance"),
    "analyses": ("user_id", "file_name", "file_size", "status"),
    "token_transactions": ("user_id", "transaction_type", "amount", "balance_after"),
}
UNIQUE = {
    "users": ("id", "email"),
    "analyses": ("id",),
    "token_transactions": ("id",),
}
REFERENCES = (
    ("analyses", "user_id", "users", "id"),
    ("token_transactions", "user_id", "users", "id"),
    ("token_transactions", "analysis_id", "analyses", "id"),
)


def checks_of(table: str) -> dict[str, Column]:
    """Named conditions every row must meet."""
    return {
        "users": {
            "token_balance_positive": F.col("token_balance") >= 0,
            "valid_plan_type": F.col("plan_type").isin(*PLAN_TYPES),
        },
        "analyses": {
            "file_size_positive": F.col("file_size") > 0,
            "tokens_consumed_positive": F.col("tokens_consumed") >= 0,
            "valid_status": F.col("status").isin(*RUN_STATUSES),
        },
        "token_transactions": {
            "valid_transaction_type": F.col("transaction_type").isin(*TRANSACTION_TYPES),
        },
    }[table]


def audit_rows(
    df: DataFrame, table: str, checks: Mapping[str, Column], required: Sequence[str] = ()
) -> DataFrame:
    """``table, rule, violations`` for row rules, all in one scan.

    A condition that is unknown because of a missing value is not violated;
    missing values are the business of ``required``.
    """
    rules = {name: F.count_if(~condition) for name, condition in checks.items()}
    rules |= {f"{name}_not_null": F.count_if(col(name).isNull()) for name in required}
    counted = df.agg(*[c.alias(f"r{i}") for i, c in enumerate(rules.values())])
    rows = [
        F.struct(
            F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")
        )
        for i, rule in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*rows)))


def audit_unique(df: DataFrame, table: str, key: str) -> DataFrame:
    """``table, rule, violations``: rows beyond the first of each key.

    Whole numbers are counted 64 to a word: a word has a bit per number that
    occurs, so its rows beyond its set bits are the repeated ones.  Numbers of
    one task combine before the shuffle, which for ids that lie together (files
    written in order) has a sixty-fourth of the rows.  Other keys are grouped.
    """
    known = df.where(col(key).isNotNull())
    n_rows = F.count(F.lit(1))
    if is_integral(field_type(df, key)):
        number = col(key).cast("bigint")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))
        words = known.groupBy(F.shiftright(number, 6).alias("word"))
        extra = words.agg((n_rows - F.bit_count(F.bit_or(bit))).alias("extra"))
    else:
        extra = known.groupBy(col(key).alias("key")).agg((n_rows - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(table).alias("table"), F.lit(f"{key}_unique").alias("rule"), "violations"
    )


def audit_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All rules of the given tables (``users``, ``analyses``, ``token_transactions``)."""
    parts = []
    for name, df in tables.items():
        parts.append(audit_rows(df, name, checks_of(name), REQUIRED[name]))
        parts += [audit_unique(df, name, key) for key in UNIQUE[name]]
    return reduce(DataFrame.unionAll, parts)


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """``key, n_rows``: key values without a parent row; missing keys refer to nothing.

    Child rows are counted per key before the join, so a key that fills most
    of the table is one row by then.
    """
    used = child.where(col(key).isNotNull()).groupBy(col(key).alias("key"))
    known = parent.select(col(parent_key).alias("key"))
    return used.agg(F.count(F.lit(1)).alias("n_rows")).join(known, "key", "left_anti")


def orphan_rows(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Whole child rows whose key has no parent row.

    The orphan keys are found first.  The most frequent of them, a bounded number,
    are sent to the rows; only rows of other keys are joined by key, so no task
    gets all rows of a frequent key.
    """
    lost = orphan_keys(child, key, parent, parent_key)
    frequent = lost.orderBy(F.desc("n_rows"), "key").limit(FREQUENT_ORPHANS).select(F.col("key").alias("__often"))
    known = child.join(F.broadcast(frequent), col(key) == F.col("__often"), "left")
    # Rows of frequent keys go through the join under numbers that no other key has.
    spread = F.when(F.col("__often").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    known = known.withColumn("__spread", spread)
    # Zero for every key, but no literal, which would not take part in the join's keys.
    rest = lost.select(F.col("key").alias("__rare"), F.least("n_rows", F.lit(0).cast("bigint")).alias("__none"))
    joined = known.join(rest, (col(key) == F.col("__rare")) & (F.col("__spread") == F.col("__none")), "left")
    found = joined.where(F.col("__often").isNotNull() | F.col("__rare").isNotNull())
    return found.select(*[col(n) for n in child.columns])


def audit_references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``relation, key, n_rows`` over every reference between the given tables."""
    parts = [
        orphan_keys(tables[child], key, tables[parent], parent_key).select(
            F.lit(f"{child}.{key}").alias("relation"), F.col("key").cast("string").alias("key"), "n_rows"
        )
        for child, key, parent, parent_key in REFERENCES
        if child in tables and parent in tables
    ]
    return reduce(DataFrame.unionAll, parts)
