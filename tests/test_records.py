import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabulens.operators import instructions as N
from tabulens.operators import ledger
from tabulens.operators.audit import audit_rows, audit_unique, checks_of, orphan_keys, orphan_rows
from tabulens.operators.history import dataset_id, find_run, latest_completed, run_cost, runs_newest_first
from tabulens.operators.ledger import balance_ledger
from tabulens.plans.report import analyze


def simulate(moves, start):
    """Brute force: one move after the other."""
    balances, found = {}, {}
    for user, place, amount in sorted(moves):
        before = balances.get(user, start)
        applied = before + amount >= 0
        balances[user] = before + amount if applied else before
        found[user, place] = (applied, balances[user])
    return found


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Keep all range partitions, so that users lie in several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def run_ledger(spark, moves, start):
    df = spark.createDataFrame(moves, "user int, place int, amount bigint").repartition(5)
    rows = balance_ledger(df, "user", ["place"], "amount", start).collect()
    return {(r["user"], r["place"]): (r["applied"], r["balance_after"]) for r in rows}


@pytest.mark.parametrize("seed, credits", [(1, 0), (2, 0), (3, 40), (4, 300)])
def test_ledger_agrees_with_brute_force(spark, seed, credits):
    rng = random.Random(seed)
    moves = []
    for i in range(3000):
        user = 7 if i % 3 == 0 else rng.randrange(1000)  # one user has a third of all moves
        amount = rng.randrange(1, credits) if credits and rng.random() < 0.05 else -rng.randrange(1, 12)
        moves.append((user, i, amount))
    assert run_ledger(spark, moves, 5) == simulate(moves, 5)


def test_ledger_of_a_single_user(spark):
    rng = random.Random(9)
    moves = [(1, i, rng.choice([-3, -2, -7, 4])) for i in range(2000)]
    assert run_ledger(spark, moves, 5) == simulate(moves, 5)


def test_hot_user_is_spread_over_partitions(spark):
    moves = [(7 if i % 3 else i, i, -1) for i in range(3000)]
    df = spark.createDataFrame(moves, "user int, place int, amount bigint")
    parts = balance_ledger(df, "user", ["place"], "amount").withColumn("part", F.spark_partition_id())
    hot = parts.groupBy("part").agg(F.count_if(F.col("user") == 7).alias("n")).where("n > 0").collect()
    assert len(hot) >= 4 and max(r["n"] for r in hot) < 1000


@pytest.mark.parametrize("unit", [1, 2, 10])
@pytest.mark.parametrize("credit", [15, 900, 30000])
def test_ledger_with_high_balances(spark, unit, credit):
    """Balances that run up and drain over several partitions."""
    rng = random.Random(unit * credit)
    moves = []
    for i in range(4000):
        amount = credit if rng.random() < 0.02 else -rng.choice([1, 3, 7, 50])
        moves.append((rng.choice([1, 1, 2]), i, amount * unit))
    assert run_ledger(spark, moves, 5) == simulate(moves, 5)


def test_ledger_of_credits_only(spark):
    moves = [(1, i, i % 5) for i in range(500)]
    assert run_ledger(spark, moves, 0) == simulate(moves, 0)


def test_refused_debit_leaves_the_balance(spark):
    found = run_ledger(spark, [(1, 1, -3), (1, 2, -9), (1, 3, -2), (1, 4, -1), (2, 1, -5), (2, 2, 6)], 5)
    assert found == {
        (1, 1): (True, 2), (1, 2): (False, 2), (1, 3): (True, 0), (1, 4): (False, 0), (2, 1): (True, 0), (2, 2): (True, 6),
    }


def test_ledger_keeps_other_columns_and_text_users(spark):
    df = spark.createDataFrame(
        [("u", datetime(2024, 1, 1), 2**60, -1, None), ("u", datetime(2024, 1, 2), None, -9, "x"), (None, None, 1, -1, "y")],
        "user string, at timestamp_ntz, big bigint, amount bigint, note string",
    )
    rows = balance_ledger(df, "user", ["at"], "amount").orderBy("at").collect()
    assert [tuple(r) for r in rows] == [
        ("u", datetime(2024, 1, 1), 2**60, -1, None, True, 4),
        ("u", datetime(2024, 1, 2), None, -9, "x", False, 4),
    ]


@pytest.mark.parametrize(
    "size, cost", [(None, 1), (0, 1), (1, 1), (10240, 1), (10241, 2), (20480, 2), (20481, 3), (10 * 1024 * 1024, 1024)]
)
def test_run_cost(spark, size, cost):
    assert spark.range(1).select(run_cost(F.lit(size).cast("bigint"))).first()[0] == cost


RESULT = '{"metadata": {"columns": ["a", "b"], "column_types": {"a": {"semantic_type": "date"}, "b": {}}}, "charts": []}'


@pytest.fixture(scope="module")
def runs(spark):
    day = datetime(2024, 1, 1)
    rows = [
        (1, 10, "a.csv", "data/uploads/a.json", "COMPLETED", RESULT, 1, day),
        (2, 10, "b.csv", None, "FAILED", None, 0, day + timedelta(days=5)),
        (3, 10, "c.csv", "c.json.json", "COMPLETED", RESULT, 2, day + timedelta(days=3)),
        (4, 10, "d.csv", "x/y/d", "COMPLETED", None, 2, day + timedelta(days=3)),
        (5, 11, "e.csv", "e.json", "PENDING", None, 0, day),
        (6, 12, "f.csv", "f.json", "COMPLETED", RESULT, 1, day),
    ]
    return spark.createDataFrame(
        rows,
        "id int, user_id int, file_name string, file_path string, status string, results string, tokens_consumed int, created_at timestamp_ntz",
    )


def test_runs_newest_first(runs):
    assert [r["id"] for r in runs_newest_first(runs, 10).collect()] == [2, 4, 3, 1]
    assert [r["id"] for r in runs_newest_first(runs).collect()] == [2, 4, 3, 1, 5, 6]


def test_latest_completed(runs):
    rows = {r["user_id"]: r for r in latest_completed(runs).collect()}
    assert set(rows) == {10, 12}
    assert (rows[10]["id"], rows[10]["columns"]) == (4, None)
    assert rows[12]["columns"] == ["a", "b"] and rows[12]["column_types"] == {"a": "date", "b": "text"}


def test_find_run_checks_the_owner(runs):
    assert find_run(runs, 1, 11).count() == 0
    assert find_run(runs, 1, 10).first()["dataset_id"] == "a"
    ids = runs.orderBy("id").select(dataset_id(F.col("file_path"))).collect()
    assert [r[0] for r in ids] == ["a", "", "c", "d", "e", "f"]


def test_audit_rules(spark):
    users = spark.createDataFrame(
        [(1, "a", -1, "PAY_AS_YOU_GO"), (2, "a", None, "FREE"), (2, None, 5, None)], "id int, email string, token_balance int, plan_type string"
    )
    rows = audit_rows(users, "users", checks_of("users"), ("email", "token_balance")).collect()
    assert {r["rule"]: r["violations"] for r in rows} == {
        "token_balance_positive": 1, "valid_plan_type": 1, "email_not_null": 1, "token_balance_not_null": 1,
    }
    assert audit_unique(users, "users", "id").first()["violations"] == 1
    assert audit_unique(users, "users", "email").first()["violations"] == 1
    assert audit_unique(users.limit(0), "users", "id").first()["violations"] == 0


def _shuffled(df):
    """Rows that each exchange of a query writes, in the order of the plan from its end."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop(0)
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
    return found


def test_unique_ids_that_lie_together_hardly_shuffle(spark):
    ids = spark.range(-3200, 60_800, 1, 4).selectExpr("id", "cast(id AS string) AS name")
    found = audit_unique(ids, "t", "id")
    assert found.first()["violations"] == 0
    assert _shuffled(found)[-1] == 1000
    assert _shuffled(audit_unique(ids, "t", "name"))[-1] == 64_000


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "string", "decimal(20, 0)"])
def test_repeated_keys_of_every_kind(spark, kind):
    # Ends of the range, both sides of zero and of a word, and gaps.
    numbers = [-128, -128, -65, -64, -64, -64, -1, -1, 0, 0, 0, 63, 64, 64, 127, None, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "n int").selectExpr(f"cast(n AS {kind}) AS `a.b`")
    assert audit_unique(rows.repartition(5), "t", "a.b").first()["violations"] == 7
    assert audit_unique(rows.where("`a.b` IS NULL"), "t", "a.b").first()["violations"] == 0


def test_least_and_greatest_long(spark):
    ends = [-(2**63), 2**63 - 1, 2**63 - 1, -(2**63), 0]
    rows = spark.createDataFrame([(n,) for n in ends], "n long")
    assert audit_unique(rows, "t", "n").first()["violations"] == 2


def test_orphans(spark):
    parents = spark.range(5)
    children = spark.createDataFrame([(9,)] * 40 + [(1,), (None,), (8,)], "parent bigint")
    assert {tuple(r) for r in orphan_keys(children, "parent", parents, "id").collect()} == {(9, 40), (8, 1)}
    assert orphan_rows(children, "parent", parents, "id").count() == 41


ANSWERS = {
    "plain": '{"insights": [{"title": "t"}], "charts": [{"x": "a"}], "analyses": [{}], "summary": "s"}',
    "fenced": '```json\n{"insights": [{"id": "mine"}]}\n```',
    "fenced_spaces": '  \n```\n{"charts": [{"type": "pie", "x": "a", "y": null}]}\n```  ',
    "prose": 'Sure! {"insights": [{"title": "in {braces}"}]} Bye',
    "none": "no json here",
    "broken": '{"insights": [',
    "reversed": "} nothing {",
    "list": '[{"insights": []}]',
    "number": "42",
    "null_list": '{"insights": null}',
    "wrong_items": '{"charts": ["x"]}',
    "empty": "{}",
    "nulls": '{"insights": [{"id": null, "type": null, "required_columns": ["a", "b"]}]}',
    "many": '{"insights": [' + ", ".join('{"title": "%d"}' % i for i in range(9)) + "]}",
    "blank": "",
    "missing": None,
}


@pytest.fixture(scope="module")
def parsed(spark):
    return N.parse_answers(spark.createDataFrame(list(ANSWERS.items()), "k string, answer string"), "k", "answer").cache()


def rows_of(table, key):
    return [r.asDict() for r in table.where(F.col("k") == key).orderBy("position").collect()]


def test_which_answers_parse(parsed):
    good = {r["k"] for r in parsed.collect() if r["parsed"]}
    assert good == {"plain", "fenced", "fenced_spaces", "prose", "empty", "nulls", "many"}


def test_defaults_fill_absent_fields_only(parsed):
    insights = N.insight_rows(parsed, "k")
    assert rows_of(insights, "plain") == [
        {"k": "plain", "position": 1, "id": "insight_1", "title": "t", "description": "", "type": "comparison",
         "feasibility": "medium", "required_columns": []}
    ]
    row = rows_of(insights, "nulls")[0]
    assert (row["id"], row["type"], row["title"], row["required_columns"]) == (None, None, "Insight 1", ["a", "b"])
    assert rows_of(insights, "prose")[0]["title"] == "in {braces}"
    assert [r["title"] for r in rows_of(insights, "many")] == [str(i) for i in range(6)]
    assert rows_of(insights, "broken") == []


def test_charts_and_analyses(parsed):
    chart = rows_of(N.chart_rows(parsed, "k"), "plain")[0]
    assert (chart["id"], chart["type"], chart["aggregation"], chart["x"], chart["y"]) == ("chart_1", "bar", "sum", "a", None)
    analysis = rows_of(N.analysis_rows(parsed, "k"), "plain")[0]
    assert (analysis["id"], analysis["type"], analysis["columns"]) == ("analysis_1", "groupby", [])
    summaries = {r["k"]: r["summary"] for r in N.answer_summaries(parsed, "k").collect()}
    assert summaries["plain"] == "s" and summaries["none"] == "" and summaries["empty"] == ""


def test_parsed_instructions_drive_an_analysis(spark):
    text = '{"charts": [{"type": "pie", "x": "c"}, {"type": "line", "x": "c", "y": "v"}], "analyses": [{"columns": ["c", "v"]}]}'
    answers = N.parse_answers(spark.createDataFrame([(1, text)], "k int, answer string"), "k", "answer")
    df = spark.range(40).selectExpr("concat('c', id % 2) as c", "double(id) as v")
    report = analyze(df, N.instructions_of(answers, "k", 1), order_by=["v"])
    assert [c.type for c in report.charts] == ["pie", "line"]
    assert report.insights[0].data == {"c1": 400.0, "c0": 380.0}


def test_ledger_memory_does_not_follow_the_amounts(spark):
    """Opening balances are never listed: large debits against large credits stay cheap."""
    moves = [(1, i, 10**9 if i % 3 else -60_000_000 * (i % 7)) for i in range(400)]
    moves += [(1, 400 + i, -(10**9) * (i % 5)) for i in range(800)]
    assert run_ledger(spark, moves, 5) == simulate(moves, 5)


def test_ledger_of_many_random_moves_of_one_user(spark):
    import random

    rng = random.Random(1)
    moves = [(1, i, rng.randint(-200_000, 190_000)) for i in range(60_000)] + [(2, 1, 7)]
    assert run_ledger(spark, moves, 5) == simulate(moves, 5)


def stretches_of(moves, count):
    """A user's moves as so many stretches: their sums, and a replay that counts its rounds."""
    parts = [moves[i * len(moves) // count : (i + 1) * len(moves) // count] for i in range(count)]
    rows = []
    for i, part in enumerate(parts, 1):
        total, lowest = 0, 0
        for amount in part:
            total += amount
            lowest = min(lowest, total)
        rows.append((i, total, -lowest))
    rounds = []

    def replayed(missing):
        import pyarrow as pa

        rounds.append(len(missing))
        found = []
        for part, user, opening in missing:
            columns = [[part], [user], [opening]]
            n = len(parts[part - 1])
            batch = pa.RecordBatch.from_arrays(
                [*(pa.array(c * n, pa.int64()) for c in columns), pa.array(parts[part - 1], pa.int64())],
                ["part", "user", "opening", "amount"],
            )
            made = next(iter(ledger._closings()(iter([batch]))))
            found.append(tuple(c[0].as_py() for c in made.columns))
        return found

    return {1: rows}, parts, rounds, replayed


@pytest.mark.parametrize("credit, every, debits", [(20, 5, (1, 12)), (900, 50, (1, 50)), (20, 5, (4, 4)), (7, 2, (1, 12)), (3, 2, (1, 9))])
@pytest.mark.parametrize("unit", [1, 1_000_000_000])
def test_few_rounds_settle_many_stretches(credit, every, debits, unit):
    rng = random.Random(credit)
    moves = [unit * (credit if rng.random() < 1 / every else -rng.randint(*debits)) for _ in range(64 * 300)]
    stretches, parts, rounds, replayed = stretches_of(moves, 64)
    openings = {part: opening for part, _, opening in ledger.settled(stretches, 5, replayed)}
    balance = 5
    for i, part in enumerate(parts, 1):
        assert openings[i] == balance
        for amount in part:
            balance = balance + amount if balance + amount >= 0 else balance
    assert len(rounds) <= 5


def test_a_replay_holds_for_an_interval_of_openings():
    rng = random.Random(3)
    moves = [rng.choice([9, -2, -5, -11]) for _ in range(40)]
    _, _, _, replayed = stretches_of(moves, 1)
    nets = {}
    for opening in range(60):
        _, _, _, net, least, most = replayed([(1, 1, opening)])[0]
        assert least <= opening <= most
        nets[opening] = (net, least, most)
    for net, least, most in nets.values():
        for opening in range(least, min(most, 59) + 1):
            assert nets[opening][0] == net
