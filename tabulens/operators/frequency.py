"""Value-frequency tables: one row per column and distinct value."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabulens.functions.columns import aggregated, col, field_type, is_text
from tabulens.functions.scalars import label_text, nan_to_null


#: Longest text that stands for itself, and the part of a longer one that is kept.
SHORT = 100
PREFIX = 64
#: Values that a sketch of frequent values keeps.
TRACKED = 10_000
#: A value that the sketch does not keep has at most this share of the rows: the bound
#: of the sketch's map, whose size is the next power of two of TRACKED / 0.75.
UNTRACKED_SHARE = 3.5 / (1 << math.ceil(math.log2(TRACKED / 0.75)))


def countable(dtype: T.DataType) -> bool:
    """Types whose values can be grouped and printed; nested columns cannot."""
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType))


def _long_form(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``column, value`` with the missing values left out."""
    wide = df.select(*[v.alias(n) for n, v in values.items()])
    names = [col(n) for n in values]
    return wide.unpivot([], names, "column", "value").where(F.col("value").isNotNull())


def printed(df: DataFrame, name: str) -> Column:
    """Values as text; distinct texts where the values are distinct."""
    dtype = field_type(df, name)
    value = nan_to_null(col(name), dtype)
    return value if is_text(dtype) else label_text(value, dtype)


def token(value: Column) -> Column:
    """A short stand-in for a text: itself, or the start of it and a SHA-256 digest.

    Stand-ins are longer than ``SHORT`` only for longer texts, and sort like
    the texts unless those share their first ``PREFIX`` characters.
    """
    digest = F.concat(F.substring(value, 1, PREFIX), F.sha2(value, 256))
    return F.when(F.length(value) <= SHORT, value).otherwise(digest)


def likely_top(value: Column, k: int) -> Column:
    """A sketch's list of the ``k`` most frequent values; missing ones may be among them."""
    return F.transform(estimated_top(value, k), lambda item: item["item"])


def estimated_top(value: Column, k: int) -> Column:
    """As ``likely_top``, with the sketch's counts, which are never too low: ``(item, count)``."""
    return F.call_function("approx_top_k", value, F.lit(k), F.lit(TRACKED))


def value_counts(
    df: DataFrame,
    columns: Sequence[str],
    shorten: bool = False,
    only: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``column, value, n`` over printed values, or their stand-ins with ``shorten``.

    ``only`` names the values to count, by column.

    Map-side counting comes before the one shuffle, on column and value, so a
    value that fills most rows costs one row per task.
    """
    values = {n: token(printed(df, n)) if shorten else printed(df, n) for n in columns}
    if only is not None:
        values = {n: F.when(v.isin(*only[n]), v) for n, v in values.items()}
    return _long_form(df, values).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column, smaller value first on ties.

    The ``rank <= k`` filter lets Spark keep only ``k`` rows per column in
    every task before the second shuffle.
    """
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def texts_of(df: DataFrame, tokens: dict[str, Sequence[str]]) -> dict[tuple[str, str], str]:
    """The texts behind a few stand-ins per column, by column and stand-in.

    A set holds each text once, however many rows repeat it.
    """
    wanted = [
        F.when(
            F.substring(printed(df, n), 1, PREFIX).isin(*[t[:PREFIX] for t in found])
            & token(printed(df, n)).isin(*found),
            F.struct(F.lit(n).alias("column"), printed(df, n).alias("value")),
        )
        for n, found in tokens.items()
    ]
    rows = (
        df.select(F.explode(F.array_compact(F.array(*wanted))).alias("hit"))
        .groupBy("hit.column", token(F.col("hit.value")).alias("token"))
        .agg(F.collect_set("hit.value").alias("texts"))
        .collect()
    )
    return {(r["column"], r["token"]): r["texts"][0] for r in rows}


def _highest_estimate(limit: int) -> int:
    """What HyperLogLog++ can report at most for ``limit`` values, up to 250 of them.

    At 5 % it has 512 registers and counts the empty ones while the estimate is
    below 400; ``limit`` values leave at least ``512 - limit`` of them empty.
    """
    if limit > 250:
        raise ValueError("the sketch decides up to 250 values only")
    return math.ceil(512 * math.log(512 / (512 - limit)))


def distinct_sketches(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """A sketch per column whose values can be counted, to be read by ``narrow_columns``."""
    names = [c for c in columns if countable(field_type(df, c))]
    return {n: F.approx_count_distinct(nan_to_null(col(n), field_type(df, n)), 0.05) for n in names}


def narrow_columns(estimates: Mapping[str, int], limit: int) -> list[str]:
    """The columns that may have no more than ``limit`` values; the others certainly have more."""
    return [n for n, e in estimates.items() if e <= _highest_estimate(limit)]


def distinct_values(df: DataFrame, name: str) -> Column:
    """The values of a narrow column, as stand-ins: a set per task holds few and short ones."""
    return F.collect_set(token(printed(df, name)))


def distinct_up_to(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int | None]:
    """Exact distinct counts where they do not exceed ``limit``, else None.

    A sketch proves for most columns that there are more values; only the
    remaining narrow columns are counted exactly.
    """
    narrow = narrow_columns(aggregated(df, distinct_sketches(df, columns)), limit)
    exact = aggregated(df, {n: distinct_values(df, n) for n in narrow})
    return {n: len(exact[n]) if n in exact and len(exact[n]) <= limit else None for n in columns}
