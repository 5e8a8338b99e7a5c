import io
import json
from types import SimpleNamespace

import pandas as pd
import pytest

from tabulens.functions.columns import POSITION
from tabulens.functions.storage import new_folder, scope, shared_folder, stage
from tabulens.operators.clean import clean_table
from tabulens.operators.ledger import balance_ledger
from tabulens.plans.check import validate_file
from tabulens.plans.ingest import ingest
from tabulens.plans.report import analyze
from tabulens.sources.csv import read_csv, read_header, read_table
from tabulens.sources.documents import load_dataset, load_results, save_dataset, save_results
from tabulens.sources.files import UPLOAD_EXTENSIONS, audit_files


def write(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


SAMPLES = {
    "semicolon": "a;b;c\n1;x;2.5\n2;y;3\n3;z;4.25\n",
    "tab": "a\tb\n1\tx\n2\ty\n",
    "tokens": "a,b,c\n1,NA,2\n2,n/a,NaN\n3,x,4\nnull,None,5\n",
    "gaps_make_floats": "a,b\n1,2\n,3\n5,6\n",
    "booleans": "a,b,c\nTrue,true,yes\nFalse,FALSE,no\nTRUE,false,yes\n",
    "boolean_with_gap": "a,b\nTrue,1\n,2\nFalse,3\n",
    "strict_numbers": "a,b,c,d\n1d,0x10,1e3,.5\n2d,0x11,2E-2,5.\n",
    "mixed": "a,b\n1,1\nx,2.5\n",
    "empty_lines_and_columns": "a,b,c\n1,,2\n\n,,\n3,,4\n",
    "repeated_names": "a,a,b,a\n1,2,3,4\n5,6,7,8\n",
    "blank_name": "a,,b\n1,2,3\n4,5,6\n",
    "quotes": 'a,b\n1,"x, ""y"""\n2,"two\nlines"\n',
    "signs": "a,b\n+1,-2\n-3,+4.5\n",
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_csv_reads_like_pandas(spark, tmp_path, name):
    expected = pd.read_csv(io.StringIO(SAMPLES[name]), sep=None, engine="python")
    expected = expected.dropna(how="all").dropna(axis=1, how="all")
    frame = read_csv(spark, write(tmp_path, SAMPLES[name])).orderBy(POSITION).drop(POSITION)
    assert frame.columns == [str(c) for c in expected.columns]
    rows = [tuple(r) for r in frame.collect()]
    wanted = [tuple(None if pd.isna(v) else v for v in row) for row in expected.itertuples(index=False)]
    assert rows == wanted
    kinds = {"int64": "bigint", "float64": "double", "bool": "boolean"}
    for (_, kind), dtype in zip(frame.dtypes, expected.dtypes):
        if str(dtype) in kinds:
            assert kind == kinds[str(dtype)]


def test_header_is_not_renamed_in_raw(spark, tmp_path):
    header = read_header(spark, write(tmp_path, "x|x|\n1|2|3\n"))
    assert header.separator == "|"
    assert header.raw == ("x", "x", "")
    assert header.names == ("x", "x.1", "Unnamed: 2")


def test_header_with_a_line_break(spark, tmp_path):
    path = write(tmp_path, '"a\n\nb, or ""c""",c\n1,"x\ny"\n2,z\n')
    header = read_header(spark, path)
    assert header.raw[1:] == ("c",) and header.raw[0].startswith("a\n")
    frame = read_csv(spark, path).orderBy(POSITION).drop(POSITION)
    assert len(frame.columns) == 2
    assert [tuple(r) for r in frame.collect()] == [(1, "x\ny"), (2, "z")]


def test_names_differ_without_case(spark, tmp_path):
    frame = read_csv(spark, write(tmp_path, "id,ID,Id.1,id\n1,2,3,4\n"), position=False)
    assert frame.columns == ["id", "ID.2", "Id.1", "id.3"]
    assert frame.first() == (1, 2, 3, 4)


def test_files_are_matched_by_name(spark, tmp_path):
    folder = tmp_path / "in [1]"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n2,y\n")
    (folder / "2.csv").write_text("b;a;c\nz;3;True\n")
    (folder / "3.csv").write_text('a,b\n4,"two\nlines"\n')
    (folder / "4.csv").write_text("")
    path = str(tmp_path / "in ?1?")
    frame = read_csv(spark, path).orderBy(POSITION).drop(POSITION)
    assert frame.columns == ["a", "b", "c"]
    assert [tuple(r) for r in frame.collect()] == [
        (1, "x", None), (2, "y", None), (3, "z", True), (4, "two\nlines", None)
    ]


def test_one_odd_quote_leaves_other_files_splittable(spark, tmp_path):
    lines = "n,t\n" + "".join(f"{i},v{i}\n" for i in range(3000))
    for name in ("1.csv", "2.csv", "3.csv"):
        (tmp_path / name).write_text(lines + ('9,5" pipe\n' if name == "2.csv" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = read_csv(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 12
        assert frame.count() == 9001
        assert frame.where("t = '5\" pipe'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folder_without_extension(spark, tmp_path):
    write(tmp_path, "a,b\n1,2\n")
    assert not validate_file(spark, str(tmp_path)).valid
    assert validate_file(spark, str(tmp_path), "csv").valid


@pytest.mark.parametrize(
    "line, separator",
    [("p_key|size|p_type|brand|price", "|"), ("a b c", " "), ("a:b:c", ":"), ("single", ","), ('"a;b",c', ","), ("a\tb", "\t")],
)
def test_separator(spark, tmp_path, line, separator):
    assert read_header(spark, write(tmp_path, line + "\n1\n")).separator == separator


def test_position_follows_the_file(spark, tmp_path):
    lines = "n,t\n" + "".join(f"{i},v{i}\n" for i in range(5000))
    path = write(tmp_path, lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = read_csv(spark, path)
        assert frame.rdd.getNumPartitions() > 3
        assert [r["n"] for r in frame.orderBy(POSITION).select("n").collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unknown_format_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, write(tmp_path, "x", "data.txt"))


def test_empty_file_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path, "\n\n"))


def test_audit_boundaries(spark, tmp_path):
    for name, size in (("a.CSV", 10), ("b.csv", 11), ("c.txt", 1), ("noext", 1), ("d.x.csv", 2)):
        (tmp_path / name).write_bytes(b"x" * size)
    rows = {r["file_name"]: r for r in audit_files(spark, str(tmp_path), UPLOAD_EXTENSIONS, 10).collect()}
    assert {n: r["admitted"] for n, r in rows.items()} == {"a.CSV": True, "b.csv": False, "c.txt": False, "noext": False, "d.x.csv": True}
    assert rows["b.csv"]["known_extension"] and not rows["b.csv"]["within_size"]
    assert rows["a.CSV"]["extension"] == ".csv"


def test_audit_does_not_read_content(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    plan = audit_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_dataset_round_trip(spark, tmp_path, fmt):
    source = write(tmp_path, "day,b,a,flag\n2024-01-02,x,1.5,True\n2024-02-03,y,,False\n")
    done = ingest(spark, source)
    path = save_dataset(done.frame, done.described.metadata(), done.cleaned.as_dict(), str(tmp_path / "out"), fmt)
    frame, meta = load_dataset(spark, path)
    assert frame.columns == ["day", "b", "a", "flag"]
    placed, _ = load_dataset(spark, path, position=True)
    assert [r["b"] for r in placed.orderBy(POSITION).collect()] == ["x", "y"]
    assert sorted(map(tuple, frame.collect())) == [("2024-01-02", "x", 1.5, True), ("2024-02-03", "y", 1.5, False)]
    assert meta["row_count"] == 2 and meta["created_at"].endswith("Z")
    assert meta["cleaning_report"]["numeric_filled"] == {"a": {"count": 1, "fill_value": 1.5}}
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path / "absent"))


def test_documents_with_and_without_metadata(spark, tmp_path):
    data = [{"z": 1, "a": "2024-01-02T00:00:00"}, {"z": None, "a": None}]
    full = {"_meta": {"columns": ["z", "a"], "row_count": 2}, "data": data}
    frame, meta = load_dataset(spark, write(tmp_path, json.dumps(full, indent=2), "full.json"))
    assert frame.columns == ["z", "a"] and meta["row_count"] == 2
    assert [tuple(r) for r in frame.collect()] == [(1, "2024-01-02T00:00:00"), (None, None)]
    frame, meta = load_dataset(spark, write(tmp_path, json.dumps(data), "bare.json"))
    assert meta == {} and frame.count() == 2
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path / "absent.json"))


def test_results_are_kept_per_dataset(spark, tmp_path):
    path = str(tmp_path / "results")
    for name, value in (("one", 1), ("two", 2), ("007", 7)):
        save_results({"numbers": spark.createDataFrame([(value,)], "v int")}, name, path)
    assert load_results(spark, path, "numbers", "two").select("v").collect()[0]["v"] == 2


def test_report_tables_can_be_stored(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2]) for i in range(40)], "k int, v double, c string")
    report = analyze(df, order_by=["k"], dataset_id="d")
    path = save_results(report.tables(), "d", str(tmp_path / "report"))
    assert load_results(spark, path, "charts", "d").count() == sum(c.data.count() for c in report.charts)
    json.dumps(report.document(), default=str)


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert configured is None or folder == configured.rstrip("/")


def test_only_local_sessions_make_their_own_folder():
    class Context:
        folder = None
        applicationId = "app-1"

        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    def session(master):
        settings = {"spark.sql.warehouse.dir": "file:/there/"}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, _=None: settings.get(name)), sparkContext=Context(master))

    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local) == "file:/there/tabulens-app-1"
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077"))


def staged_folders(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tabulens")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(s.getPath().getName()) for s in system.listStatus(path)} if system.exists(path) else set()


def test_a_scope_removes_what_was_staged_in_it(spark):
    before = staged_folders(spark)
    with scope(spark):
        assert stage(spark.range(3), "inner").count() == 3
        new_folder(spark, "never-written")
        with scope(spark):
            stage(spark.range(3), "innermost")
        assert len(staged_folders(spark)) == len(before) + 1
    assert staged_folders(spark) == before
    kept = stage(spark.range(3), "kept")
    assert kept.count() == 3 and len(staged_folders(spark)) == len(before) + 1


def test_ingestion_leaves_nothing_behind(spark, tmp_path):
    before = staged_folders(spark)
    done = ingest(spark, write(tmp_path, "a,b\n1,x\n2,y\n"), str(tmp_path / "store"))
    assert len(staged_folders(spark)) == len(before) + 1
    done.release()
    assert staged_folders(spark) == before
    assert load_dataset(spark, str(tmp_path / "store"))[0].count() == 2


def test_a_ledger_stages_nothing(spark):
    before = staged_folders(spark)
    moves = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 7, id) as user", "id % 11 - 6 as amount")
    assert balance_ledger(moves, "user", ["id"], "amount").count() == 2000
    assert staged_folders(spark) == before


def test_clean_after_scan_keeps_position(spark, tmp_path):
    frame = clean_table(read_csv(spark, write(tmp_path, "a,b\n1,x\n2,\n3,z\n"))).frame
    assert [r["a"] for r in frame.orderBy(POSITION).collect()] == [1, 3]


def test_results_are_replaced_not_repeated(spark, tmp_path):
    path = str(tmp_path / "results")
    for value in (1, 2):
        for name in ("007", "8"):
            save_results({"numbers": spark.createDataFrame([(value,)], "v int")}, name, path)
    assert [r["v"] for r in load_results(spark, path, "numbers", "007").collect()] == [2]
    assert load_results(spark, path, "numbers", "7").count() == 0


def test_dataset_is_replaced(spark, tmp_path):
    path = str(tmp_path / "d")
    for value in (1, 2):
        save_dataset(spark.createDataFrame([(value,)], "v int"), {"columns": ["v"]}, {}, path)
    assert [r["v"] for r in load_dataset(spark, path)[0].collect()] == [2]


@pytest.mark.parametrize(
    "text, errors, warnings",
    [
        ("a,b\n1,2\n3,4\n", [], []),
        ("a,b\n", ["empty_table"], []),
        ("a,a\n1,2\n", ["duplicate_columns"], []),
        ("a,,b\n1,2,3\n", [], ["unnamed_columns"]),
        ("a,b\n1,2\n,\n3,4\n5,6\n", ["stacked_tables", "missing_cells"], []),
        ("a,b\n1,2\n3,4\nNA,null\n", [], ["empty_rows"]),
        ("a,b,c\n1,,2\n3,,4\n", ["side_by_side_tables", "missing_cells"], []),
    ],
)
def test_file_validation(spark, tmp_path, text, errors, warnings):
    found = validate_file(spark, write(tmp_path, text))
    assert (found.errors, found.warnings) == (errors, warnings)


def test_files_that_cannot_be_validated(spark, tmp_path):
    assert validate_file(spark, str(tmp_path / "absent.csv")).errors == ["unreadable"]
    assert validate_file(spark, write(tmp_path, "", "blank.csv")).errors == ["unreadable"]
    assert validate_file(spark, "book.xlsx").errors == ["unsupported_format"]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_columnar_and_json_sources(spark, tmp_path, fmt):
    gap = float("nan") if fmt == "parquet" else None  # JSON has no NaN
    rows = [(1, 1.5, None, "a"), (None, None, None, None), (2, gap, None, "b"), (None, gap, None, None)]
    path = f"{tmp_path}/t.{fmt}"
    df = spark.createDataFrame(rows, "d bigint, i double, n string, s string")
    df.coalesce(1).write.option("ignoreNullFields", "false").format(fmt).save(path)
    frame = read_table(spark, path).orderBy(POSITION).drop(POSITION)
    found = {n: [r[n] for r in frame.collect()] for n in frame.columns}
    assert found == {"d": [1, 2], "i": [1.5, None], "s": ["a", "b"]}
    done = ingest(spark, path, str(tmp_path / "store"))
    assert done.described.row_count == 2
    assert load_dataset(spark, str(tmp_path / "store"))[1]["row_count"] == 2


def test_documents_have_positions_on_request(spark, tmp_path):
    path = write(tmp_path, json.dumps([{"a": i} for i in range(50)]), "list.json")
    rows, _ = load_dataset(spark, path, position=True)
    assert [r["a"] for r in rows.orderBy(POSITION).collect()] == list(range(50))


def test_approximate_ingestion(spark, tmp_path):
    text = "n,c,t\n" + "".join(f"{i},g{i % 3},x{i}\n" for i in range(200))
    done = ingest(spark, write(tmp_path, text), approx=True)
    rows = {r["column"]: r for r in done.described.rows}
    assert rows["n"]["median"] == pytest.approx(99.5, abs=1) and 0 <= rows["n"]["mode"] < 200
    assert rows["c"]["type"] == "categorical" and rows["c"]["unique_count"] == 3
    assert rows["t"]["type"] == "text" and len(rows["t"]["top_values"]) == 10
    assert [c.type for c in analyze(done.frame, described=done.described).charts] == ["bar"]


def test_undocumented_strings_stay_text(spark, tmp_path):
    """The narrow typing: strings are text, so one scatter and three summaries come out."""
    text = "day,city,a,b\n" + "".join(f"2024-01-{1 + i % 28:02d},c{i % 4},{i},{i % 7}\n" for i in range(300))
    done = ingest(spark, write(tmp_path, text), infer_strings=False)
    assert [t.semantic_type for t in done.described.types] == ["text", "text", "integer", "integer"]
    report = analyze(done.frame, described=done.described)
    assert [(c.type, c.x_label, c.y_label) for c in report.charts] == [("scatter", "a", "b")]
    assert report.charts[0].data.count() == 200
    assert [(i.type, i.column) for i in report.insights] == [("stats", "b"), ("top_values", "city"), ("stats", "a")]
