"""Queries that write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.functions.storage import new_folder
from tabulens.operators import charts as C
from tabulens.operators.charts import bar_chart, line_chart
from tabulens.operators.clean import clean_table
from tabulens.plans.check import validate_file
from tabulens.plans.ingest import ingest, open_dataset
from tabulens.plans.report import auto_report, describe
from tabulens.registry.base import (
    CLEAN_ORDERS,
    gappy_orders,
    query,
    rounded,
    sql_iso,
    sql_round,
    table,
)
from tabulens.sources.csv import read_csv
from tabulens.sources.documents import load_dataset, load_results, save_dataset, save_results
from tabulens.sources.files import UPLOAD_EXTENSIONS, audit_files


@query(
    "csv_scan",
    """SELECT o_orderkey, CAST(CASE WHEN o_totalprice >= 60000 THEN o_custkey END AS DOUBLE) AS customer,
        o_orderstatus = 'F' AS finished, NULLIF(o_orderpriority, '5-LOW') AS priority,
        o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day,
        'a "quoted"; ' || o_orderstatus AS note FROM orders""",
)
def csv_scan(spark, folder):
    """Semicolons, quotes, missing-value tokens and an empty column."""
    orders = table(spark, folder, "orders")
    path = new_folder(spark, "orders.csv")
    orders.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 60000, F.col("o_custkey").cast("string")).otherwise("N/A").alias("customer"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("finished"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("NULL").alias("priority"),
        F.lit(None).cast("string").alias("nothing"),
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit('a "quoted"; '), "o_orderstatus").alias("note"),
    ).write.csv(path, header=True, sep=";", escape='"')
    return read_csv(spark, path, position=False)


def _write_lines(lines, header: str, path: str) -> None:
    """Write texts with a header before the first line of every file."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    headed = F.when(first, F.concat(F.lit(header + "\n"), "line")).otherwise(F.col("line"))
    lines.select(headed.alias("value")).write.text(path)


@query(
    "csv_folder",
    """SELECT p_partkey AS lower_id, CAST(p_size AS DOUBLE) AS upper_id,
              CASE WHEN p_partkey % 3 = 2 THEN p_brand || chr(10) || 'or "' || p_type || '"' ELSE p_brand END AS note,
              CAST(NULL AS DOUBLE) AS price FROM part
       WHERE p_partkey % 3 <> 1
       UNION ALL SELECT p_partkey, NULL, p_brand, p_retailprice FROM part WHERE p_partkey % 3 = 1""",
)
def csv_folder(spark, folder):
    """Parts in files with other columns, orders and separators; names differ in case, some span lines."""
    part = table(spark, folder, "part").withColumn("rest", F.col("p_partkey") % 3)
    path = new_folder(spark, "parts")
    plain, other, quoted = (part.where(F.col("rest") == i) for i in (0, 1, 2))
    line = F.concat_ws(",", "p_partkey", "p_size", "p_brand")
    _write_lines(plain.select(line.alias("line")), 'id,ID,"a\nnote"', f"{path}/1")
    line = F.concat_ws(";", "p_retailprice", "p_brand", "p_partkey")
    _write_lines(other.select(line.alias("line")), 'price;"a\nnote";id', f"{path}/2")
    text = F.concat(F.lit('"'), "p_brand", F.lit('\nor ""'), "p_type", F.lit('"""'))
    line = F.concat_ws(",", text, "p_partkey", "p_size")
    _write_lines(quoted.select(line.alias("line")), '"a\nnote",id,ID', f"{path}/3")
    return read_csv(spark, f"{path}/*", position=False).toDF("lower_id", "upper_id", "note", "price")


_BLANKED = """SELECT ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS place,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS k,
    NULLIF(o_orderpriority, '5-LOW') AS priority FROM orders"""


@query(
    "validate_csv",
    f"""WITH s AS ({_BLANKED}), f AS (SELECT MIN(place) AS first FROM s WHERE k IS NULL),
        a AS (SELECT COUNT(*) AS n FROM s, f WHERE place > first AND k IS NOT NULL),
        m AS (SELECT {sql_round('(3 * COUNT(*) - 2 * COUNT(k)) * 1.0 / (3 * COUNT(*))', 4)} AS pct FROM s)
        SELECT 'stacked_tables' AS "check", 'error' AS severity, CAST(n AS DOUBLE) AS metric FROM a WHERE n > 1
        UNION ALL SELECT 'side_by_side_tables', 'error', 1.0
        UNION ALL SELECT 'missing_cells', 'error', pct FROM m WHERE pct > 0.05
        UNION ALL SELECT 'unnamed_columns', 'warning', 1.0
        UNION ALL SELECT 'duplicate_columns', 'error', 1.0""",
)
def validate_csv(spark, folder):
    """Orders as a file with blank rows, a blank column and a repeated name."""
    orders = table(spark, folder, "orders")
    filled = F.col("o_orderpriority") != "5-LOW"
    path = new_folder(spark, "blanked") + ".csv"
    lines = orders.orderBy("o_orderdate", "o_orderkey").select(
        F.when(filled, F.col("o_orderkey").cast("string")).alias("k"),
        F.lit(None).cast("string").alias(" "),
        F.when(filled, F.col("o_orderpriority")).alias("K"),
    )
    lines.toDF("k", " ", "k").write.csv(path, header=True, ignoreTrailingWhiteSpace=True)
    return validate_file(spark, path).checks_frame(spark).drop("detail")


@query(
    "dataset_store",
    f"""SELECT o_orderkey, {sql_round('price', 2)} AS price, status, priority, {sql_iso('o_orderdate')} AS o_orderdate
        FROM ({CLEAN_ORDERS})""",
)
def dataset_store(spark, folder):
    """Cleaned orders written as JSON lines with metadata, then loaded: dates come back as texts."""
    cleaned = clean_table(gappy_orders(spark, folder))
    path = new_folder(spark, "dataset")
    metadata = describe(cleaned.frame, had_gaps=cleaned.had_gaps).metadata()
    save_dataset(cleaned.frame, metadata, cleaned.as_dict(), path, "json")
    frame, _ = load_dataset(spark, path)
    return frame.withColumn("price", F.round("price", 2))


@query(
    "ingested_csv",
    f"""WITH s AS (SELECT p_partkey, p_name, CASE WHEN p_size > 5 THEN p_size END AS size, p_type,
                  NULLIF(p_brand, 'Brand#7') AS brand, p_retailprice FROM part),
        c AS (SELECT * REPLACE (COALESCE(size, (SELECT AVG(size) FROM s)) AS size) FROM s WHERE brand IS NOT NULL)
        SELECT 'p_partkey' AS "column", 'integer' AS type, COUNT(*) AS count, {sql_round('AVG(p_partkey)', 4)} AS mean,
               {sql_round('MEDIAN(p_partkey)', 4)} AS median, CAST(NULL AS BIGINT) AS unique_count FROM c
        UNION ALL SELECT 'size', 'float', COUNT(*), {sql_round('AVG(size)', 4)}, {sql_round('MEDIAN(size)', 4)}, NULL FROM c
        UNION ALL SELECT 'p_type', 'categorical', COUNT(*), NULL, NULL, COUNT(DISTINCT p_type) FROM c
        UNION ALL SELECT 'p_name', CASE WHEN COUNT(DISTINCT p_name) <= 50 AND COUNT(DISTINCT p_name) < 0.2 * COUNT(*)
               THEN 'categorical' ELSE 'text' END, COUNT(*), NULL, NULL, COUNT(DISTINCT p_name) FROM c
        UNION ALL SELECT 'brand', CASE WHEN COUNT(DISTINCT brand) < 0.2 * COUNT(*) THEN 'categorical' ELSE 'text' END,
               COUNT(*), NULL, NULL, COUNT(DISTINCT brand) FROM c
        UNION ALL SELECT 'p_retailprice', 'float', COUNT(*), {sql_round('AVG(p_retailprice)', 4)},
               {sql_round('MEDIAN(p_retailprice)', 4)}, NULL FROM c""",
)
def ingested_csv(spark, folder):
    """Parts as a file with gaps: scanned, typed, cleaned, described and stored."""
    part = table(spark, folder, "part")
    source = new_folder(spark, "parts") + ".csv"
    part.select(
        "p_partkey",
        "p_name",
        F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).otherwise("NA").alias("size"),
        "p_type",
        F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")).alias("brand"),
        "p_retailprice",
    ).write.csv(source, header=True, sep="|")
    done = ingest(spark, source, new_folder(spark, "parts"))
    profile = done.described.profile.select("column", "type", "count", "mean", "median", "unique_count")
    done.release()
    return rounded(profile, mean=4, median=4)


@query(
    "reopened_dataset",
    f"""SELECT 'auto_1' AS chart_id, {sql_iso('o_orderdate')} AS label, {sql_round('y', 4)} AS y FROM (
            SELECT o_orderdate, AVG(price) AS y FROM ({CLEAN_ORDERS}) GROUP BY 1 ORDER BY 1 LIMIT 50)
        UNION ALL SELECT 'auto_2', status, {sql_round('AVG(price)', 4)} FROM ({CLEAN_ORDERS}) GROUP BY status""",
)
def reopened_dataset(spark, folder):
    """Cleaned orders stored with their state: opened again, their charts are chosen without a scan."""
    path = new_folder(spark, "reopened")
    ingest(spark, gappy_orders(spark, folder).drop("o_orderkey"), path)
    frame, described = open_dataset(spark, path)
    report = auto_report(frame, described=described)
    points = C.charts_frame(report.charts[:2]).select("chart_id", "label", "y")
    return rounded(points, y=4)


@query(
    "result_store",
    f"""SELECT label, {sql_round('y', 4)} AS y FROM (SELECT o_orderpriority AS label, AVG(o_totalprice) AS y
        FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)""",
)
def result_store(spark, folder):
    """Two datasets share the result tables; one is read back."""
    orders = table(spark, folder, "orders")
    path = new_folder(spark, "results")
    save_results({"charts": bar_chart(orders, "o_orderpriority", "o_totalprice")}, "by_priority", path)
    save_results({"charts": line_chart(orders, "o_orderdate", "o_totalprice")}, "by_date", path)
    found = load_results(spark, path, "charts", "by_priority")
    return found.select("label", F.round("y", 4).alias("y"))


@query(
    "document_source",
    """SELECT s_suppkey, s_name, s_acctbal, 'list' AS shape FROM supplier
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'full' FROM supplier""",
)
def document_source(spark, folder):
    """Suppliers as JSON documents of up to 100 rows each: bare lists, and with metadata."""
    rows = table(spark, folder, "supplier").withColumn("page", F.floor(F.col("s_suppkey") / 100))
    record = F.struct("s_name", "s_suppkey", "s_acctbal")
    # At most 100 rows per group.
    pages = rows.groupBy("page").agg(F.collect_list(record).alias("data"))
    names = F.array(*map(F.lit, ("s_suppkey", "s_name", "s_acctbal")))
    full = F.struct(F.struct(names.alias("columns")).alias("_meta"), "data")
    path = new_folder(spark, "documents")
    found = []
    for shape, document in (("list", F.col("data")), ("full", full)):
        written = pages.select(F.to_json(document).alias("value"), "page")
        written.repartition("page").write.partitionBy("page").text(f"{path}/{shape}.json")
        frame, _ = load_dataset(spark, f"{path}/{shape}.json")
        found.append(frame.select("s_suppkey", "s_name", "s_acctbal", F.lit(shape).alias("shape")))
    return found[0].unionAll(found[1])


@query(
    "document_layouts",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, 'x "}{" ' || o_orderpriority AS note, 'list' AS shape FROM orders
       UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 'x "}{" ' || o_orderpriority, 'compact' FROM orders
       UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 'x "}{" ' || o_orderpriority, 'indented' FROM orders""",
)
def document_layouts(spark, folder):
    """Orders as documents of up to 5000 rows, with and without metadata and line breaks, cut into records per split."""
    note = F.concat(F.lit('x "}{" '), "o_orderpriority").alias("note")
    record = F.struct("o_orderkey", "o_orderstatus", "o_totalprice", note)
    rows = table(spark, folder, "orders").withColumn("page", F.floor(F.col("o_orderkey") / 5000))
    # At most 5000 rows per group.
    pages = rows.groupBy("page").agg(F.collect_list(record).alias("data"))
    meta = F.struct(F.array(F.lit("o_orderkey"), F.lit("note")).alias("columns"), F.size("data").alias("row_count"))
    full = F.struct(meta.alias("_meta"), "data")
    path = new_folder(spark, "layouts")
    found = []
    for shape, value in (("list", F.to_json("data")), ("compact", F.to_json(full)), ("indented", F.to_json(full, {"pretty": "true"}))):
        pages.select(value.alias("value"), "page").repartition("page").write.partitionBy("page").text(f"{path}/{shape}.json")
        frame, _ = load_dataset(spark, f"{path}/{shape}.json")
        found.append(frame.select("o_orderkey", "o_orderstatus", "o_totalprice", "note", F.lit(shape).alias("shape")))
    return found[0].unionAll(found[1]).unionAll(found[2])


@query(
    "file_audit",
    """WITH files AS (
            SELECT CASE WHEN c_nationkey % 2 = 0 THEN '.txt' ELSE '.csv' END AS extension,
                   SUM(strlen(c_name) + 1)::BIGINT AS size
            FROM customer GROUP BY c_nationkey),
        rules AS (SELECT SUM(size) // COUNT(*) AS most FROM files)
        SELECT extension, size, extension = '.csv' AS known_extension, size <= most AS within_size,
               extension = '.csv' AND size <= most AS admitted
        FROM files, rules""",
)
def file_audit(spark, folder):
    """A file of customer names per nation, half of them text and half CSV; files of up to the mean size fit."""
    names = table(spark, folder, "customer").select("c_name", "c_nationkey")
    path = new_folder(spark, "uploads")
    for kind, rest in (("text", 0), ("csv", 1)):
        part = names.filter(F.col("c_nationkey") % 2 == rest).repartition("c_nationkey")
        part.write.partitionBy("c_nationkey").format(kind).save(f"{path}/{kind}")
    total, count = names.agg(F.sum(F.octet_length("c_name") + 1), F.count_distinct("c_nationkey")).first()
    return audit_files(spark, path, UPLOAD_EXTENSIONS, total // count).drop("file_name")
