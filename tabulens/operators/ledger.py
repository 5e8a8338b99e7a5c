"""Token balances: credits always apply, a debit only if the balance covers it.

Because a refused debit leaves the balance as it was, a balance is not a
running sum.  Moves are dealt by user, and those of a user with very many moves
by stretches of time, too, whose bounds are literals taken from a sample: every
pass deals alike, without keeping a copy of the table.  Of each stretch two
numbers are computed: the net of its moves, and the least opening balance at which
nothing is refused.  From there upwards the closing balance is known.  Other
stretches are replayed from an assumed opening, all at once.  A replay also
tells between which openings the same moves are refused, so that its net holds for
all of them.  The closings are chained, and what turns out to open outside of all
intervals known is replayed again, until nothing changes.  Finally every stretch
is replayed from its opening balance.  No pass keeps more than one balance, however
large the amounts are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import col

# Fixed value: tokens a new user has.
START_BALANCE = 5

#: Moves of a user are one stretch unless they are more than this, and than a share of all.
LEAST_STRETCH = 64
#: Sampled moves per stretch that bounds are chosen from.
_SAMPLED = 50

_PART, _OPENING = "__part", "__opening"


def balance_ledger(
    moves: DataFrame,
    user: str,
    order_by: Sequence[str],
    amount: str,
    start: int = START_BALANCE,
    parts: int | None = None,
) -> DataFrame:
    """All moves with ``applied`` and ``balance_after``.

    A user with more than one in ``2 * parts`` of all moves is split into
    stretches of about that size; by default ``parts`` is the session's number of
    shuffle partitions.

    ``amount`` is a bigint, positive for credits and negative for debits;
    ``order_by`` must be unique per user.  Moves without a user or an amount
    touch no balance and are left out.
    """
    spark = moves.sparkSession
    valid = moves.where(col(user).isNotNull() & col(amount).isNotNull())
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType(
        [*valid.schema.fields, T.StructField("applied", T.BooleanType()), T.StructField("balance_after", T.LongType())]
    )
    names = [col(n) for n in valid.columns]
    placed = valid.withColumn(_PART, F.lit(0))
    opened = placed.withColumn(_OPENING, F.lit(None).cast("long"))
    bounds = _bounds(valid, user, order_by, parts)
    if bounds is not None:
        placed = _placed(valid, user, order_by, bounds)
        openings = _openings(placed, user, order_by, amount, start, parts)
        # At most some stretches per partition.
        opened = placed.join(F.broadcast(openings), [_PART, user], "left")
    keys = [F.col(_PART), col(user), *[col(c) for c in order_by]]
    dealt = opened.repartition(col(user), F.col(_PART)).sortWithinPartitions(*keys)
    return dealt.select(*names, F.col(_OPENING), F.col(_PART)).mapInArrow(_replay(user, amount, start), schema)


def _bounds(valid: DataFrame, user: str, order_by: Sequence[str], parts: int) -> DataFrame | None:
    """``__who, __bounds``: ascending first keys of all stretches but the first, for users with several.

    Less than ``2 * parts`` users have that many moves, and together they have
    fewer bounds than that.
    """
    spark = valid.sparkSession
    total = valid.count()
    limit = max(LEAST_STRETCH, -(-total // (2 * parts)))
    who = T.StructField("__who", valid.schema[user].dataType)
    per_user = valid.groupBy(col(user).alias("__who")).agg(F.count(F.lit(1)).alias("n"))
    many = {r["__who"]: r["n"] for r in per_user.where(F.col("n") > limit).collect()}
    if not many:
        return None
    users = spark.createDataFrame([(u,) for u in many], T.StructType([who]))
    moves = valid.join(F.broadcast(users), col(user) == F.col("__who"), "left_semi")
    share = min(1.0, _SAMPLED * 2 * parts / sum(many.values()))
    known = moves.select(col(user).alias("__who"), _key(order_by).alias("key")).sample(share, 1)
    found: dict[Any, list] = {u: [] for u in many}
    for row in known.collect():
        if all(v is not None for v in row["key"]):
            found[row["__who"]].append(tuple(row["key"]))
    rows = []
    for u, keys in found.items():
        keys.sort()
        pieces = -(-many[u] // limit)
        rows.append((u, sorted({keys[i * len(keys) // pieces] for i in range(1, pieces)} if keys else ())))
    kind = T.ArrayType(known.schema["key"].dataType)
    return spark.createDataFrame(rows, T.StructType([who, T.StructField("__bounds", kind)]))


def _key(order_by: Sequence[str]):
    return F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order_by)])


def _placed(valid: DataFrame, user: str, order_by: Sequence[str], bounds: DataFrame) -> DataFrame:
    """The moves with ``__part``: how many bounds of their user they have reached, plus one; 0 for a user without any."""
    joined = valid.join(F.broadcast(bounds), col(user) == F.col("__who"), "left")
    key = _key(order_by)
    reached = F.size(F.filter("__bounds", lambda bound: bound <= key)) + 1
    part = F.when(F.col("__bounds").isNotNull(), reached).otherwise(0)
    return joined.select(*[col(n) for n in valid.columns], part.cast("int").alias(_PART))


def _openings(
    placed: DataFrame, user: str, order_by: Sequence[str], amount: str, start: int, parts: int
) -> DataFrame:
    """``__part, user, __opening`` of all stretches of users with several; the driver chains them."""
    spark = placed.sparkSession
    kind = placed.schema[user].dataType
    keys = [F.col("part"), F.col("user"), *[F.col(f"k{i}") for i in range(len(order_by))]]
    shared = placed.where(F.col(_PART) > 0).select(
        F.col(_PART).alias("part"),
        col(user).alias("user"),
        *[col(c).alias(f"k{i}") for i, c in enumerate(order_by)],
        col(amount).alias("amount"),
    )

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(2 * parts, "part", "user").sortWithinPartitions(*keys)

    who = T.StructField("user", kind)
    long = lambda name: T.StructField(name, T.LongType())
    part = T.StructField("part", T.IntegerType())
    sums = dealt(shared).select("part", "user", "amount").mapInArrow(_sums(), T.StructType([part, who, long("net"), long("below")]))
    stretches: dict = {}
    for row in sorted(sums.collect(), key=lambda r: r["part"]):
        stretches.setdefault(row["user"], []).append((row["part"], row["net"], row["below"]))

    opened = T.StructType([part, who, long("opening")])
    closed = T.StructType([*opened.fields, long("net"), long("least"), long("most")])

    def replayed(missing: list[tuple]) -> list[tuple]:
        asked = F.broadcast(spark.createDataFrame(missing, opened))
        rows = dealt(shared.join(asked, ["part", "user"])).select("part", "user", "opening", "amount")
        return [tuple(r) for r in rows.mapInArrow(_closings(), closed).collect()]

    return spark.createDataFrame(settled(stretches, start, replayed), opened).toDF(_PART, user, _OPENING)


def settled(stretches: dict, start: int, replayed: Callable[[list[tuple]], list[tuple]]) -> list[tuple]:
    """(part, user, opening) of all stretches {user: [(part, net, least opening without a refusal)]}.

    ``replayed`` gets such rows and returns them with the net of the applied
    moves and the least and greatest opening for which it holds.
    """
    known: dict = {}
    while True:
        found, missing = _chained(stretches, known, start)
        if not missing:
            return found
        for part, user, _, net, least, most in replayed(missing):
            known.setdefault((part, user), []).append((least, most, net))


def _chained(stretches: dict, known: dict, start: int) -> tuple[list[tuple], list[tuple]]:
    """Openings of all stretches, and those whose closing has to be replayed first.

    Behind an unknown closing the chain goes on with a guess, so that the
    stretches of a user are replayed in the same round: the net of the nearest
    opening known, or that of all moves.
    """
    found, missing = [], []
    for user, rows in stretches.items():
        balance = start
        for part, net, below in rows:
            found.append((part, user, balance))
            intervals = known.get((part, user), ())
            if balance >= below:
                balance += net
                continue
            nearest = min(intervals, key=lambda i: max(i[0] - balance, balance - i[1], 0), default=None)
            if nearest is None or not nearest[0] <= balance <= nearest[1]:
                missing.append((part, user, balance))
            if nearest is None:
                balance = max(balance + net, 0)
            else:
                # Far-off openings tend to close alike: small balances forget where they came from.
                balance = min(max(balance, nearest[0]), nearest[1]) + nearest[2]
    return found, missing


def _runs():
    """Iterates over (key, rows) of neighbouring rows with the same leading columns."""

    def runs(batch, width):
        import numpy as np

        keys = list(zip(*(c.to_pylist() for c in batch.columns[:width])))
        amounts = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        change = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for s, e in zip([0, *change], [*change, len(keys)]):
            if e > s:
                yield keys[s], np.asarray(amounts[s:e], dtype=np.int64)

    return runs


def _sums():
    """Net and least sufficient opening of each stretch; one running sum is all it keeps."""
    runs = _runs()

    def sums(batches):
        import pyarrow as pa

        current, net, lowest, kind = None, 0, 0, None

        def row():
            (part, user) = current
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([user], kind), pa.array([net], pa.int64()), pa.array([max(0, -lowest)], pa.int64())],
                ["part", "user", "net", "below"],
            )

        for batch in batches:
            kind = batch.column("user").type
            for key, amounts in runs(batch, 2):
                if key != current:
                    if current is not None:
                        yield row()
                    current, net, lowest = key, 0, 0
                total = amounts.cumsum()
                lowest = min(lowest, net + int(total.min()))
                net += int(total[-1])
        if current is not None:
            yield row()

    return sums


def _walk():
    """Applies moves in order; blocks without a refusal are one cumulative sum.

    Also returns the least balance after an applied move, and the greatest
    balance that a refused one would have left, None without any.
    """

    def walk(balance, amounts):
        import numpy as np

        applied, after = np.ones(len(amounts), dtype=bool), np.empty(len(amounts), dtype=np.int64)
        lowest = highest = None
        for s in range(0, len(amounts), 256):
            block = amounts[s : s + 256]
            total = balance + block.cumsum()
            low = int(total.min())
            if low >= 0:
                after[s : s + 256] = total
                balance = int(total[-1])
                lowest = low if lowest is None else min(lowest, low)
                continue
            for i, change in enumerate(block.tolist(), s):
                left = balance + change
                if left >= 0:
                    balance = left
                    if lowest is None or left < lowest:
                        lowest = left
                else:
                    applied[i] = False
                    if highest is None or left > highest:
                        highest = left
                after[i] = balance
        return balance, applied, after, lowest, highest

    return walk


def _closings():
    """Net of each stretch from the opening it was asked for, and the openings for which it holds."""
    runs, walk = _runs(), _walk()

    def closings(batches):
        import pyarrow as pa

        current, balance, least, most, kind = None, 0, 0, 0, None

        def row():
            kinds = (pa.int32(), kind, *[pa.int64()] * 4)
            values = zip((*current, balance - current[2], least, most), kinds)
            names = ["part", "user", "opening", "net", "least", "most"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names)

        for batch in batches:
            kind = batch.column("user").type
            for key, amounts in runs(batch, 3):
                if key != current:
                    if current is not None:
                        yield row()
                    current, balance, least, most = key, key[2], 0, 2**63 - 1
                balance, _, _, lowest, highest = walk(balance, amounts)
                # An opening lower by more than the least balance, or higher by what a refusal lacked, changes a refusal.
                if lowest is not None:
                    least = max(least, key[2] - lowest)
                if highest is not None:
                    most = min(most, key[2] - highest - 1)
        if current is not None:
            yield row()

    return closings


def _replay(user: str, amount: str, start: int):
    """Walk each stretch in order from its opening balance; the last two columns are the opening and the part."""
    runs, walk = _runs(), _walk()

    def replay(batches):
        import numpy as np
        import pyarrow as pa

        current, balance = None, start
        for batch in batches:
            opening, part = batch.columns[-2:]
            columns = [part, batch.column(user), opening, batch.column(amount)]
            applied, after = [], []
            for (*who, opened), amounts in runs(pa.RecordBatch.from_arrays(columns, ["part", "user", "opening", "amount"]), 3):
                if who != current:
                    current, balance = who, start if opened is None else opened
                balance, done, left, _, _ = walk(balance, amounts)
                applied.append(done)
                after.append(left)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-2],
                    pa.array(np.concatenate(applied) if applied else [], pa.bool_()),
                    pa.array(np.concatenate(after) if after else [], pa.int64()),
                ],
                [*batch.schema.names[:-2], "applied", "balance_after"],
            )

    return replay
