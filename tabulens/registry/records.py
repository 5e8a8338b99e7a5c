"""Run-history, ledger, audit and instruction queries.

Events stand for runs and token moves, customers for users, documents for files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import instructions as N
from tabulens.operators.audit import audit_references, audit_tables, orphan_rows
from tabulens.operators.history import (
    dataset_id,
    find_run,
    latest_completed,
    run_cost,
    runs_newest_first,
)
from tabulens.operators.ledger import balance_ledger
from tabulens.registry.base import query, table


def runs(spark, folder):
    """Events as runs: a purchase counts as completed, an error as failed."""
    kind = F.col("event_type")
    size = F.floor(F.col("value") * 1024)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat(kind, F.lit(".csv")).alias("file_name"),
        size.alias("file_size"),
        F.concat(F.lit("data/uploads/"), kind, F.lit("_"), "event_id", F.lit(".json")).alias("file_path"),
        F.when(kind == "purchase", "COMPLETED").when(kind == "error", "FAILED").otherwise("PENDING").alias("status"),
        F.concat(
            F.lit('{"metadata": {"columns": ["value", "'),
            kind,
            F.lit('"], "column_types": {"value": {"semantic_type": "float"}, "'),
            kind,
            F.lit('": {"semantic_type": null}}}}'),
        ).alias("results"),
        run_cost(size).alias("tokens_consumed"),
        F.col("ts").alias("created_at"),
    )


_SIZE = "CAST(floor(value * 1024) AS BIGINT)"
_COST = "GREATEST(1, ({size} + 10239) // 10240)"
_RUNS = f"""SELECT event_id AS id, user_id, event_type, event_type || '.csv' AS file_name, {_SIZE} AS file_size,
    CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS status,
    {_COST.format(size=_SIZE)} AS tokens_consumed, ts AS created_at FROM events"""


@query(
    "runs_by_user",
    f"SELECT user_id, id, file_name, status, tokens_consumed, created_at FROM ({_RUNS})",
)
def runs_by_user(spark, folder):
    return runs_newest_first(runs(spark, folder))


@query(
    "runs_of_busiest_user",
    f"""SELECT user_id, id, file_name, status, tokens_consumed, created_at FROM ({_RUNS})
        WHERE user_id = (SELECT user_id FROM events GROUP BY user_id ORDER BY COUNT(*) DESC, user_id LIMIT 1)""",
)
def runs_of_busiest_user(spark, folder):
    counts = runs(spark, folder).groupBy("user_id").count()
    busiest = counts.orderBy(F.desc("count"), "user_id").first()["user_id"]
    return runs_newest_first(runs(spark, folder), busiest)


@query(
    "run_with_owner",
    f"""SELECT 'owner' AS asked_by, id, user_id, event_type || '_' || id AS dataset_id FROM ({_RUNS})
        WHERE id = (SELECT MAX(event_id) FROM events)""",
)
def run_with_owner(spark, folder):
    """The newest run, asked for by its owner and by another user, who gets nothing."""
    all_runs = runs(spark, folder)
    last = all_runs.agg(F.max_by(F.struct("id", "user_id"), "id")).first()[0]
    asked = (("owner", last["user_id"]), ("other", last["user_id"] + 1))
    found = [find_run(all_runs, last["id"], user).withColumn("asked_by", F.lit(who)) for who, user in asked]
    return found[0].unionAll(found[1]).select("asked_by", "id", "user_id", "dataset_id")


@query(
    "latest_run_per_user",
    f"""SELECT user_id, id, file_name, created_at, 'value,' || event_type AS columns,
        'float' AS value_type, 'text' AS other_type
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r
              FROM ({_RUNS}) WHERE status = 'COMPLETED') WHERE r = 1""",
)
def latest_run_per_user(spark, folder):
    return latest_completed(runs(spark, folder)).select(
        "user_id",
        "id",
        "file_name",
        "created_at",
        F.array_join("columns", ",").alias("columns"),
        F.col("column_types")["value"].alias("value_type"),
        F.element_at("column_types", F.element_at("columns", 2)).alias("other_type"),
    )


@query("run_dataset_ids", "SELECT event_id AS id, event_type || '_' || event_id AS dataset_id FROM events")
def run_dataset_ids(spark, folder):
    return runs(spark, folder).select("id", dataset_id(F.col("file_path")).alias("dataset_id"))


@query("run_cost", f"SELECT doc_id, n_chars, {_COST.format(size='n_chars')} AS cost FROM documents")
def run_cost_of_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "n_chars", run_cost(F.col("n_chars")).alias("cost"))


def moves(spark, folder):
    """Purchases add 20 tokens, every other event is a run to pay for."""
    cost = run_cost(F.floor(F.col("value") * 1024))
    amount = F.when(F.col("event_type") == "purchase", F.lit(20).cast("bigint")).otherwise(-cost)
    return table(spark, folder, "events").select("event_id", "user_id", "ts", amount.alias("amount"))


def _ledger_sql(user: str, factor: int) -> str:
    return f"""WITH RECURSIVE m AS (
            SELECT event_id, user_id, ts, amount,
                   ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r
            FROM (SELECT event_id, {user} AS user_id, ts, {factor} * CASE WHEN event_type = 'purchase' THEN 20
                         ELSE -{_COST.format(size=_SIZE)} END AS amount FROM events)),
        l AS (
            SELECT event_id, user_id, amount, r, 5 + amount >= 0 AS applied,
                   CASE WHEN 5 + amount >= 0 THEN 5 + amount ELSE 5 END AS balance_after FROM m WHERE r = 1
            UNION ALL
            SELECT m.event_id, m.user_id, m.amount, m.r, l.balance_after + m.amount >= 0,
                   CASE WHEN l.balance_after + m.amount >= 0 THEN l.balance_after + m.amount ELSE l.balance_after END
            FROM l JOIN m ON m.user_id = l.user_id AND m.r = l.r + 1)
        SELECT event_id, user_id, amount, applied, balance_after FROM l"""


@query("balance_ledger", _ledger_sql("user_id", 1))
def ledger(spark, folder):
    return balance_ledger(moves(spark, folder), "user_id", ["ts", "event_id"], "amount").drop("ts")


@query("balance_ledger_spread", _ledger_sql("CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END", 1_000_000_000))
def ledger_of_a_hot_user(spark, folder):
    """One user has a third of all moves, with large amounts, in 16 ranges."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))
    scaled = moves(spark, folder).withColumns({"user_id": user, "amount": F.col("amount") * 1_000_000_000})
    return balance_ledger(scaled, "user_id", ["ts", "event_id"], "amount", parts=16).drop("ts")


def history_tables(spark, folder):
    customers = table(spark, folder, "customer")
    documents = table(spark, folder, "documents")
    events = table(spark, folder, "events")
    users = customers.select(
        F.col("c_custkey").alias("id"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("email"),
        F.when(F.col("c_acctbal") > 5000, "PAY_AS_YOU_GO").otherwise("TRIAL").alias("plan_type"),
        F.floor("c_acctbal").alias("token_balance"),
    )
    analyses = documents.select(
        F.col("doc_id").alias("id"),
        F.col("n_chars").alias("user_id"),
        F.col("source").alias("file_name"),
        (F.col("n_chars") - 100).alias("file_size"),
        F.lit("COMPLETED").alias("status"),
        run_cost(F.col("n_chars")).alias("tokens_consumed"),
    )
    transactions = events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("transaction_type"),
        F.floor("value").alias("amount"),
        F.when(F.col("event_type") != "purchase", F.floor(F.col("value") * 10)).alias("analysis_id"),
        F.floor("value").alias("balance_after"),
    )
    return {"users": users, "analyses": analyses, "token_transactions": transactions}


_USERS = """SELECT c_custkey AS id, NULLIF(c_mktsegment, 'MACHINERY') AS first_name, c_name AS last_name,
    c_mktsegment || c_nationkey AS email,
    CASE WHEN c_acctbal > 5000 THEN 'PAY_AS_YOU_GO' ELSE 'TRIAL' END AS plan_type,
    floor(c_acctbal) AS token_balance FROM customer"""
_ANALYSES = """SELECT doc_id AS id, n_chars AS user_id, source AS file_name, n_chars - 100 AS file_size FROM documents"""
_MOVES = """SELECT event_id AS id, user_id, event_type AS transaction_type,
    CASE WHEN event_type <> 'purchase' THEN CAST(floor(value * 10) AS BIGINT) END AS analysis_id FROM events"""


def _rule(table_name: str, rule: str, count: str, source: str) -> str:
    return f"SELECT '{table_name}' AS \"table\", '{rule}' AS rule, {count} AS violations FROM ({source})"


def _zero_rules(table_name: str, rules: list[str], source: str) -> str:
    """Rules that the derived tables cannot break."""
    return " UNION ALL ".join(_rule(table_name, r, "COUNT(*) FILTER (WHERE id IS NULL)", source) for r in rules)


@query(
    "constraint_audit",
    " UNION ALL ".join(
        [
            _rule("users", "token_balance_positive", "COUNT(*) FILTER (WHERE token_balance < 0)", _USERS),
            _rule(
                "users",
                "valid_plan_type",
                "COUNT(*) FILTER (WHERE plan_type NOT IN ('PAY_AS_YOU_GO', 'MONTHLY_UNLIMITED'))",
                _USERS,
            ),
            _rule("users", "first_name_not_null", "COUNT(*) - COUNT(first_name)", _USERS),
            _rule("users", "id_unique", "COUNT(id) - COUNT(DISTINCT id)", _USERS),
            _rule("users", "email_unique", "COUNT(email) - COUNT(DISTINCT email)", _USERS),
            _zero_rules(
                "users",
                ["last_name_not_null", "email_not_null", "plan_type_not_null", "token_balance_not_null"],
                _USERS,
            ),
            _rule("analyses", "file_size_positive", "COUNT(*) FILTER (WHERE file_size <= 0)", _ANALYSES),
            _rule("analyses", "id_unique", "COUNT(id) - COUNT(DISTINCT id)", _ANALYSES),
            _zero_rules(
                "analyses",
                [
                    "tokens_consumed_positive",
                    "valid_status",
                    "user_id_not_null",
                    "file_name_not_null",
                    "file_size_not_null",
                    "status_not_null",
                ],
                _ANALYSES,
            ),
            _rule(
                "token_transactions",
                "valid_transaction_type",
                "COUNT(*) FILTER (WHERE transaction_type NOT IN ('purchase', 'consumption'))",
                _MOVES,
            ),
            _rule("token_transactions", "id_unique", "COUNT(id) - COUNT(DISTINCT id)", _MOVES),
            _zero_rules(
                "token_transactions",
                [
                    "user_id_not_null",
                    "transaction_type_not_null",
                    "amount_not_null",
                    "balance_after_not_null",
                ],
                _MOVES,
            ),
        ]
    ),
)
def constraint_audit(spark, folder):
    return audit_tables(history_tables(spark, folder))


# Where a row of the derived tables breaks each rule that they keep otherwise.
_GAPS = {
    "users": ("last_name", "email", "plan_type", "token_balance"),
    "analyses": ("user_id", "file_name", "file_size", "status"),
    "token_transactions": ("user_id", "transaction_type", "amount", "balance_after"),
}


def _broken_tables(spark, folder):
    """The same tables with gaps, unknown states and negative costs, each in every seventh row."""
    tables = history_tables(spark, folder)
    tables["analyses"] = tables["analyses"].withColumns(
        {
            "status": F.when(F.col("id") % 7 == 5, F.lit("LOST")).otherwise(F.col("status")),
            "tokens_consumed": F.when(F.col("id") % 7 == 6, -1).otherwise(F.col("tokens_consumed")),
        }
    )
    return {
        name: frame.withColumns(
            {c: F.when(F.col("id") % 7 != i, F.col(c)) for i, c in enumerate(_GAPS[name])}
        )
        for name, frame in tables.items()
    }


def _kept(name: str, column: str) -> str:
    """Condition under which a broken table keeps the value of a column."""
    return f"id % 7 <> {_GAPS[name].index(column)}" if column in _GAPS[name] else "TRUE"


def _gap_rules() -> list[str]:
    sources = {"users": _USERS, "analyses": _ANALYSES, "token_transactions": _MOVES}
    return [
        _rule(name, f"{c}_not_null", f"COUNT(*) FILTER (WHERE NOT ({_kept(name, c)}))", sources[name])
        for name, columns in _GAPS.items()
        for c in columns
    ]


def _unique_rule(name: str, column: str, source: str) -> str:
    keep = f"CASE WHEN {_kept(name, column)} THEN {column} END"
    return _rule(name, f"{column}_unique", f"COUNT({keep}) - COUNT(DISTINCT {keep})", source)


@query(
    "constraint_audit_broken",
    " UNION ALL ".join(
        [
            *_gap_rules(),
            _rule("users", "first_name_not_null", "COUNT(*) - COUNT(first_name)", _USERS),
            _rule(
                "users",
                "token_balance_positive",
                f"COUNT(*) FILTER (WHERE token_balance < 0 AND {_kept('users', 'token_balance')})",
                _USERS,
            ),
            _rule(
                "users",
                "valid_plan_type",
                f"COUNT(*) FILTER (WHERE plan_type = 'TRIAL' AND {_kept('users', 'plan_type')})",
                _USERS,
            ),
            _unique_rule("users", "id", _USERS),
            _unique_rule("users", "email", _USERS),
            _rule(
                "analyses",
                "file_size_positive",
                f"COUNT(*) FILTER (WHERE file_size <= 0 AND {_kept('analyses', 'file_size')})",
                _ANALYSES,
            ),
            _rule("analyses", "tokens_consumed_positive", "COUNT(*) FILTER (WHERE id % 7 = 6)", _ANALYSES),
            _rule("analyses", "valid_status", "COUNT(*) FILTER (WHERE id % 7 = 5)", _ANALYSES),
            _unique_rule("analyses", "id", _ANALYSES),
            _rule(
                "token_transactions",
                "valid_transaction_type",
                "COUNT(*) FILTER (WHERE transaction_type NOT IN ('purchase', 'consumption') "
                f"AND {_kept('token_transactions', 'transaction_type')})",
                _MOVES,
            ),
            _unique_rule("token_transactions", "id", _MOVES),
        ]
    ),
)
def constraint_audit_broken(spark, folder):
    """Every rule but the unique numbers is broken by some row."""
    return audit_tables(_broken_tables(spark, folder))


def _orphan_sql(relation: str, key: str, child: str, parent: str) -> str:
    return f"""SELECT '{relation}' AS relation, CAST({key} AS VARCHAR) AS key, COUNT(*) AS n_rows
        FROM ({child}) AS c WHERE {key} IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM ({parent}) AS p WHERE p.id = c.{key}) GROUP BY {key}"""


@query(
    "orphan_keys",
    " UNION ALL ".join(
        [
            _orphan_sql("analyses.user_id", "user_id", _ANALYSES, _USERS),
            _orphan_sql("token_transactions.user_id", "user_id", _MOVES, _USERS),
            _orphan_sql("token_transactions.analysis_id", "analysis_id", _MOVES, _ANALYSES),
        ]
    ),
)
def orphan_key_counts(spark, folder):
    return audit_references(history_tables(spark, folder))


@query(
    "orphan_rows",
    f"""SELECT id, user_id, transaction_type, analysis_id FROM ({_MOVES}) AS c WHERE analysis_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = c.analysis_id)""",
)
def orphan_moves(spark, folder):
    tables = history_tables(spark, folder)
    found = orphan_rows(tables["token_transactions"], "analysis_id", tables["analyses"], "id")
    return found.select("id", "user_id", "transaction_type", "analysis_id")


def answers(spark, folder):
    """Model answers made from parts: plain, fenced, within prose, without JSON, and too long."""
    size, name, brand = F.col("p_size"), F.col("p_name"), F.col("p_brand")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    body = text(
        '{"insights": [{"id": "own", "title": "', name, '", "type": "trend", "required_columns": ["', brand,
        '"]}, {"description": "', brand, '", "feasibility": null}], ',
        '"charts": [{"x": "', F.col("p_type"), '", "y": "p_retailprice"}, {"type": "pie", "x": "p_brand"}], ',
        '"analyses": [{"type": "correlation", "columns": ["p_size", "', name, '"]}], "summary": "', brand, '"}',
    )
    many = text(
        '{"insights": [', F.array_join(F.array_repeat(text('{"title": "', name, '"}'), 8), ", "), "]}"
    )
    answer = (
        F.when(size <= 10, body)
        .when(size <= 20, text("```json\n", body, "\n```"))
        .when(size <= 30, text("Here it is: ", body, " I hope it helps."))
        .when(size <= 40, text("No idea about ", name))
        .otherwise(many)
    )
    return table(spark, folder, "part").select("p_partkey", answer.alias("answer"))


_WITH_JSON = "p_size <= 30"
_MANY = "p_size > 40"


@query(
    "answer_insights",
    f"""SELECT p_partkey, 1 AS position, 'own' AS id, p_name AS title, '' AS description, 'trend' AS type,
               'medium' AS feasibility, p_brand AS required_columns FROM part WHERE {_WITH_JSON}
        UNION ALL SELECT p_partkey, 2, 'insight_2', 'Insight 2', p_brand, 'comparison', NULL, ''
               FROM part WHERE {_WITH_JSON}
        UNION ALL SELECT p_partkey, CAST(i AS INTEGER), 'insight_' || i, p_name, '', 'comparison', 'medium', ''
               FROM part, range(1, 7) AS r(i) WHERE {_MANY}""",
)
def answer_insights(spark, folder):
    rows = N.insight_rows(N.parse_answers(answers(spark, folder), "p_partkey", "answer"), "p_partkey")
    return rows.withColumn("required_columns", F.array_join("required_columns", ","))


@query(
    "answer_charts",
    f"""SELECT p_partkey, 1 AS position, 'chart_1' AS id, 'bar' AS type, 'Graphique 1' AS title,
               'sum' AS aggregation, '' AS description, p_type AS x, 'p_retailprice' AS y
        FROM part WHERE {_WITH_JSON}
        UNION ALL SELECT p_partkey, 2, 'chart_2', 'pie', 'Graphique 2', 'sum', '', 'p_brand', NULL
        FROM part WHERE {_WITH_JSON}""",
)
def answer_charts(spark, folder):
    return N.chart_rows(N.parse_answers(answers(spark, folder), "p_partkey", "answer"), "p_partkey")


@query(
    "answer_analyses",
    f"""SELECT p_partkey, 1 AS position, 'analysis_1' AS id, 'correlation' AS type, '' AS description,
               'sum' AS aggregation, 'p_size,' || p_name AS columns FROM part WHERE {_WITH_JSON}""",
)
def answer_analyses(spark, folder):
    rows = N.analysis_rows(N.parse_answers(answers(spark, folder), "p_partkey", "answer"), "p_partkey")
    return rows.withColumn("columns", F.array_join("columns", ","))


@query(
    "answer_summaries",
    f"""SELECT p_partkey, {_WITH_JSON} OR {_MANY} AS parsed,
        CASE WHEN {_WITH_JSON} THEN p_brand ELSE '' END AS summary FROM part""",
)
def answer_summary_rows(spark, folder):
    return N.answer_summaries(N.parse_answers(answers(spark, folder), "p_partkey", "answer"), "p_partkey")
