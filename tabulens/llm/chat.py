"""Chat logs: events are folded into messages, messages rendered with a loss mask.

A log has one row per event. It is partitioned by conversation and sorted by
`seq`. `open` names the role, `delta` appends to the text, `edit` replaces what
there was, `regenerate` discards it. An event names the message it belongs to, so
earlier messages can be edited or regenerated later on; one that names none
belongs to the latest message named before it. Folding needs no loop: what stands
after a message's last edit or regeneration counts, joined in order.

Rendered text marks each turn as

    <|role|>text<|end|>

and in roles and texts `&`, `<` and `|` are written as `&amp;`, `&lt;` and
`&#124;`, so nothing a user writes can look like a mark, and unescaping gives
every text back. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.functions.storage import stage

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("|", "&#124;"))
CLOSE = "<|end|>"
DELTAS = 4

#: A conversation whose texts are control strings of a common template.
PLANTED_ID = -7
PLANTED_TEXT = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text) of the messages of a log.

    The log has conv_id, turn, message, seq, kind, role, text; rows may come in
    any order, and `seq` may have any type that sorts. A conversation's events
    are dealt to one task, which sorts and streams them. Equal events that were
    delivered more than once count once; different events of one `seq` are in the
    order of kind, role and text. Without a `seq` an event comes first. Events
    before any named message belong to a message without a name.

    The role is that of the last `open` event, null without one (a log may be cut
    at a boundary of time). The turn is the least that its events have. Null
    texts append nothing; unknown kinds are ignored, but make a message; a message
    without deltas is empty; no events, no rows. Other columns do not matter.
    """
    order = ["seq", "kind", "role", "text"]
    log = events.select("conv_id", "turn", "message", *order).repartition("conv_id")
    named = F.last("message", ignorenulls=True).over(
        W.partitionBy("conv_id").orderBy(*order, "message").rowsBetween(W.unboundedPreceding, 0)
    )
    log = log.withColumn("message", F.coalesce("message", named))
    # From the last event to the first one: what has a reset after it does not count.
    back = W.partitionBy("conv_id", "message").orderBy(*[F.desc(c) for c in order])
    reset = F.col("kind").isin("edit", "regenerate").cast("int")
    later = F.coalesce(F.sum(reset).over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    again = F.coalesce(F.struct(*order).eqNullSafe(F.lag(F.struct(*order)).over(back)), F.lit(False))
    log = log.select("conv_id", "turn", "message", *order, later.alias("later"), again.alias("again"))
    # An equal event just after a reset is the reset itself, delivered again.
    said = F.when(F.col("kind").isin("delta", "edit") & (F.col("later") == 0) & ~F.col("again"), F.struct(*order))
    opened = F.when(F.col("kind") == "open", F.struct("seq", F.lit("").alias("kind"), "role"))
    folded = log.groupBy("conv_id", "message").agg(
        F.min("turn").alias("turn"), F.max(opened).alias("opened"), F.sort_array(F.collect_list(said)).alias("said")
    )
    text = F.expr("array_join(transform(said, x -> coalesce(x.text, '')), '')")
    return folded.select("conv_id", "turn", "message", F.col("opened.role").alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, `formatted`, and `loss_spans` (start, length) of assistant texts.

    Spans count code points of the escaped texts in `formatted`. Messages are in
    the order of turn (nulls last), role, text and message; a null role is an
    empty one, a null text an empty one. Rows without a conversation are one
    conversation. A conversation is one string, so it has to fit in a row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    written = messages.select(
        "conv_id",
        F.struct(F.col("turn").isNull().alias("late"), "turn", role.alias("role"), text.alias("text"), "message").alias("at"),
        (role == "assistant").alias("loss"),
        F.concat(F.lit("<|"), escape(role), F.lit("|>")).alias("head"),
        escape(text).alias("body"),
    )
    # A running sum per conversation streams through a window; only lengths and texts pass.
    before = W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + len(CLOSE)
    placed = written.withColumn("place", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))
    turn = F.struct("place", "loss", "head", "body")
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    spans = F.expr(
        "transform(filter(m, x -> x.loss), "
        "x -> struct(x.place + length(x.head) AS start, cast(length(x.body) AS bigint) AS length))"
    )
    formatted = F.expr(f"array_join(transform(m, x -> concat(x.head, x.body, '{CLOSE}')), '')")
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, number, role, text and `loss` (null outside the mask) of each turn, parsed from the output.

    The text is split at the ends of turns; a span belongs to the turn in whose
    text it starts, and cuts the loss text out of it by its own length.
    """
    pattern = f"\\Q{CLOSE}\\E"
    parts = rendered.select("conv_id", F.posexplode(F.split("formatted", pattern, -1)).alias("number", "part"))
    before = W.partitionBy("conv_id").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    head = F.locate("|>", F.col("part")) + 1
    place = F.coalesce(F.sum(F.length("part") + len(CLOSE)).over(before), F.lit(0))
    turns = parts.withColumn("start", (place + head).cast("long")).filter("part <> ''")
    spans = rendered.select(F.col("conv_id").alias("of"), F.explode("loss_spans").alias("span"))
    found = turns.join(spans, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("span.start")), "left")
    return found.select(
        "conv_id",
        "number",
        unescape(F.substr("part", F.lit(3), head - 4)).alias("role"),
        unescape(F.substr("part", head + 1)).alias("text"),
        unescape(F.substr("part", head + 1, F.col("span.length").cast("int"))).alias("loss"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """A log whose messages are the rows of the table (conv_id, turn, role, text).

    Every text is streamed in parts. User turns first say something else and are
    edited once the whole conversation is there; assistant turns are broken off
    and regenerated. Only the first event of a message names it, and the late
    edits. Equal rows are separate messages: they are counted first and get a
    number each.
    """
    rows = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    texts = F.coalesce("text", F.lit(""))
    numbered = rows.select(
        "conv_id",
        "turn",
        "role",
        texts.alias("text"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
    ).withColumn("message", F.struct("turn", "role", F.sha2(F.encode("text", "utf-8"), 256).alias("digest"), "copy"))
    size = F.expr(f"cast(length(text) div {DELTAS} + 1 as int)")
    unnamed = F.lit(None).cast(numbered.schema["message"].dataType)

    def event(step: int, kind: str, text: Column) -> Column:
        late = kind == "edit"
        seq = F.struct(F.lit(late).alias("late"), F.col("message").alias("of"), F.lit(step).alias("step"))
        name = F.col("message") if late or kind == "open" else unnamed
        return F.struct(seq.alias("seq"), name.alias("message"), F.lit(kind).alias("kind"), text.alias("text"))

    first = [event(0, "open", F.lit("")), event(1, "delta", F.substr("text", F.lit(1), size))]
    deltas = [event(3 + i, "delta", F.substr("text", size * i + 1, size)) for i in range(DELTAS)]
    log = (
        F.when(F.col("role") == "user", F.array(*first, event(2, "edit", F.col("text"))))
        .when(F.col("role") == "assistant", F.array(*first, event(2, "regenerate", F.lit("")), *deltas))
        .otherwise(F.array(first[0], *deltas))
    )
    return numbered.select("conv_id", "turn", "role", F.explode(log).alias("e")).select("conv_id", "turn", "role", "e.*")


def chat_conversations(conversations: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the rendered text and its spans."""
    spark = conversations.sparkSession
    planted = spark.createDataFrame(
        [(PLANTED_ID, 0, "user", PLANTED_TEXT), (PLANTED_ID, 1, "assistant", PLANTED_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    rendered = stage(render(fold_events(events_of(rows.unionByName(planted)))), "chats")
    turn = F.struct("number", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), "loss")
    back = read_back(rendered).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    joined = back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.said", "").alias("said"),
        F.array_join("turns.loss", "").alias("loss"),
    )
    sizes = rendered.select(F.col("conv_id").alias("of"), F.length("formatted").cast("long").alias("formatted_chars"))
    return joined.join(sizes, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("said", "utf-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(text: str) -> str:
    for plain, written in ESCAPES:
        text = f"replace({text}, '{plain}', '{written}')"
    return text


ORACLE = f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED_TEXT}'
        UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED_TEXT}'),
    said AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
               coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
               sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len("<||>") + len(CLOSE)}) AS formatted
        FROM rows GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
           formatted::BIGINT AS formatted_chars
    FROM said"""
