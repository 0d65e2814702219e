import hashlib
import time

import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrameWriter

from plumbline.operators.columns import ROW_ID, column_table, describe_columns, header_checks
from plumbline.sources import arrow_files, readers, sinks


def test_only_empty_cells_are_missing(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,zip,status,empty,n\n1,00501,N/A,,1.5\n2,02134,null, ,2\n3,10001,ok,,\n")
    df, _ = readers.read_delimited(spark, str(path))
    rows = df.orderBy(ROW_ID).collect()
    assert dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["n"] == "double"
    assert [r.status for r in rows] == ["N/A", "null", "ok"]
    assert [r.empty for r in rows] == [None, None, None]
    strict, _ = readers.read_delimited(spark, str(path), strict_reference=True)
    assert dict(strict.dtypes)["n"] == "string"


def test_ragged_rows_and_duplicate_headers(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("a,a,b\n1,2,3\n1,2,3,4\n5,6\n")
    df, skipped = readers.read_delimited(spark, str(path))
    assert [c for c in df.columns if c != ROW_ID] == ["a", "a.1", "b"]
    assert df.count() == 2
    assert skipped.first().skipped_rows == 1


def test_json_documents_and_lines(spark, tmp_path):
    (tmp_path / "doc.json").write_text('[{"id": 1, "n": {"x": {"y": 2}}},\n {"id": 2, "n": {"x": {"y": 3}}}]')
    (tmp_path / "lines.json").write_text('{"id": 1, "tags": [1, 2]}\n{"id": 2, "tags": []}\n')
    doc = readers.read_json(spark, str(tmp_path / "doc.json"))
    assert [(r.id, r["n.x.y"]) for r in doc.orderBy("id").collect()] == [(1, 2), (2, 3)]
    assert readers.read_json(spark, str(tmp_path / "lines.json")).count() == 2


def test_feather(spark, tmp_path):
    for i in range(3):
        feather.write_feather(pa.table({"id": [i, i + 10], "s": ["x", None]}), str(tmp_path / f"{i}.feather"))
    df = readers.read_feather(spark, str(tmp_path), "id bigint, s string")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 10, 11, 12]


def test_arrow_files_are_split_by_batches_and_typed_by_their_footer(spark, tmp_path):
    table = pa.table({"id": list(range(1000)), "s": [f"x{i}" if i % 3 else None for i in range(1000)],
                      "l": [[i, None] for i in range(1000)]})
    with pa.ipc.new_file(str(tmp_path / "a.arrow"), table.schema) as writer:
        for batch in table.to_batches(max_chunksize=50):
            writer.write_batch(batch)
    (tmp_path / "_SUCCESS").write_text("")
    df = arrow_files.read_arrow_files(spark, str(tmp_path), split_bytes=1)
    assert df.dtypes == [("id", "bigint"), ("s", "string"), ("l", "array<bigint>")]
    assert df.rdd.getNumPartitions() == 20
    assert arrow_files.read_arrow_files(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    rows = sorted(df.collect())
    assert [tuple(r) for r in rows] == [(i, f"x{i}" if i % 3 else None, [i, None]) for i in range(1000)]
    some = readers.read_feather(spark, str(tmp_path / "a.arrow"), "s string, id double")
    assert some.drop(ROW_ID).dtypes == [("s", "string"), ("id", "double")] and some.count() == 1000


def test_whole_files_are_hashed_block_by_block(spark, tmp_path, monkeypatch):
    contents = {"a.bin": b"", "b.bin": b"x" * 3_000_001, "c d.bin": bytes(range(256)) * 10}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in sinks.file_fingerprints(spark, str(tmp_path)).collect()}
    assert found == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}


def test_folder_options_and_feather_without_a_schema(spark, tmp_path):
    (tmp_path / "semi.txt").write_bytes("a;b\ncaf\u00e9;2\n".encode("latin-1"))
    feather.write_feather(pa.table({"id": [1, 2]}), str(tmp_path / "t.feather"))
    paths = [str(tmp_path / n) for n in ("semi.txt", "t.feather", "gone.feather")]
    frames, status = readers.read_folder(
        spark, paths, options={paths[0]: {"sep": ";", "encoding": "ISO-8859-1"}})
    assert frames["semi.txt"].drop(ROW_ID).first().asDict() == {"a": "caf\u00e9", "b": 2}
    assert frames["t.feather"].count() == 2
    assert {r.dataset: r.status for r in status.collect()}["gone.feather"] == "failed"


def test_row_ids_follow_files_and_positions(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).repartition(4).write.parquet(path)
    a = {r.id: r[ROW_ID] for r in readers.read_parquet(spark, path).collect()}
    b = {r.id: r[ROW_ID] for r in readers.read_parquet(spark, path).repartition(7).collect()}
    assert a == b and len(set(a.values())) == 100


def test_folder_failures_are_kept_apart(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.parquet").write_text("not parquet")
    frames, status = readers.read_folder(
        spark, [str(tmp_path / n) for n in ("ok.csv", "bad.parquet", "notes.docx")])
    assert list(frames) == ["ok.csv"]
    assert {r.dataset: r.status for r in status.collect()} == {
        "ok.csv": "loaded", "bad.parquet": "failed", "notes.docx": "failed"}


def test_sinks(spark, tmp_path):
    df = spark.range(5).selectExpr("id", f"id AS {ROW_ID}")
    out = str(tmp_path / "out")
    assert not sinks.write_cleaned(df, out, published=False)
    assert sinks.write_cleaned(df, out, published=True)
    assert spark.read.parquet(out).columns == ["id"]
    log = spark.createDataFrame([("r1", "x")], "run_id string, issue string")
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert sinks.dataset_key("data/My Orders (1).csv") == "my_orders_1"


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    same = sinks.table_fingerprint(a.orderBy("i", ascending=False)).first()
    other = sinks.table_fingerprint(spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")).first()
    assert sinks.table_fingerprint(a).first() == same != other


def test_headers(spark):
    df = spark.range(1).toDF("Unnamed: 0")
    table = column_table(spark, describe_columns("t", df)).unionByName(column_table(
        spark, describe_columns("u", spark.range(1).selectExpr("id AS a", "id AS a"))))
    found = {r.dataset: (r.duplicate_names, r.unnamed_headers, r.status) for r in header_checks(table).collect()}
    assert found == {"t": (0, 1, "fail"), "u": (1, 0, "fail")}


def test_quoted_cells_extra_fields_and_wide_integers(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,Name,name,wide\n1,"he said ""hi"", ok",a,12345678901234567890\n'
                    '2,"line1\nline2",b,2\n3,c,d,4,\n4,c\n5,"a,b",q,7,8,9\n6,1,2,,x\n')
    df, skipped = readers.read_delimited(spark, str(path))
    rows = {r.id: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 4] and df.count() == 3
    assert rows[1].Name == 'he said "hi", ok' and rows[2].Name == "line1\nline2"
    assert str(rows[1].wide) == "12345678901234567890" and rows[4]["name.1"] is None
    assert skipped.first().skipped_rows == 3


def test_integers_never_lose_digits(spark, tmp_path):
    path = tmp_path / "w.csv"
    lines = [f"123456789012345678{i},9{i}{'0' * 40},{1.5 if i else '12345678901234567'}" for i in range(3)]
    path.write_text("a,b,c\n" + "\n".join(lines) + "\n")
    df, _ = readers.read_delimited(spark, str(path))
    assert [t for _, t in df.drop(ROW_ID).dtypes] == ["bigint", "string", "string"]
    assert df.select("a").distinct().count() == df.select("b").distinct().count() == 3


def test_xml_rows_are_found_and_flattened(spark, tmp_path):
    path = tmp_path / "x.xml"
    path.write_text('<?xml version="1.0"?><!-- <no> -->\n<list>\n<rec><a>1</a><b><c> </c><d>2</d></b></rec>\n'
                    '<rec><a>3</a><b><c>x</c></b></rec></list>')
    rows = readers.read_xml(spark, str(path)).collect()
    assert [(r.a, r["b.c"], r["b.d"]) for r in rows] == [(1, None, 2), (3, "x", None)]


def test_equal_file_names_and_bad_files_stay_apart(spark, tmp_path):
    for folder in ("f1", "f2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "o.csv").write_text(f"a\n{folder}\n")
    (tmp_path / "bad.xml").write_text("<only/>")
    found, status = readers.read_folder(
        spark, [str(tmp_path / p) for p in ("f1/o.csv", "f2/o.csv", "bad.xml")])
    assert {n: df.first().a for n, df in found.items()} == {"f1/o.csv": "f1", "f2/o.csv": "f2"}
    assert {r.dataset: r.status for r in status.collect()} == {
        "f1/o.csv": "loaded", "f2/o.csv": "loaded", "bad.xml": "failed"}


def test_ragged_rows_next_to_long_quoted_cells(spark, tmp_path):
    path = tmp_path / "long.csv"
    long = '"' + 'a,""b""' * 15_000 + '"'
    path.write_text(f"id,t,u\n1,{long}\n2,{long},x,y\n3,{long},z\n")
    df, skipped = readers.read_delimited(spark, str(path))
    assert {r.id: (len(r.t), r.u) for r in df.collect()} == {1: (75_000, None), 3: (75_000, "z")}
    assert skipped.first().skipped_rows == 1


def test_xml_children_of_all_tags_are_rows(spark, tmp_path):
    path = tmp_path / "m.xml"
    path.write_text("<!-- x > -->\n" * 300 + '<export><info><v>1</v><rec>no</rec></info><rec k="a>b"><a>2</a></rec>'
                    "<rec><a><![CDATA[<3>]]></a></rec>\n<!-- <rec><a>4</a></rec> --><other><a>5</a></other></export>")
    rows = readers.read_xml(spark, str(path)).collect()
    assert [(r.v, r.rec, r.a, r._k) for r in rows] == [
        (1, "no", None, None), (None, None, "2", "a>b"), (None, None, "<3>", None), (None, None, "5", None)]


def test_a_run_written_again_is_stored_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("r1", "x"), ("r1", "y"), ("007", "z")], "run_id string, issue string")
    for part in (rows, rows.where("run_id = 'r1' AND issue = 'x'")):
        sinks.write_log(part, log)
    assert {tuple(r) for r in spark.read.parquet(log).select("issue").collect()} == {("x",), ("z",)}
    history = str(tmp_path / "history")
    runs = spark.createDataFrame(
        [("data/My Orders (1).csv", "007", "a", 1), ("12.csv", "007", "b", 2)],
        "dataset string, run_id string, column string, row_count int")
    for _ in range(2):
        sinks.write_history(runs, history)
    sinks.write_history(runs.where("row_count = 1").selectExpr(
        "dataset", "'008' AS run_id", "column", "row_count"), history)
    found = sinks.read_history(spark, history)
    assert sorted((r.dataset, r.run_id) for r in found.collect()) == [
        ("12.csv", "007"), ("data/My Orders (1).csv", "007"), ("data/My Orders (1).csv", "008")]
    assert sinks.read_history(spark, history, "my-orders-1.csv").count() == 2
    assert sinks.read_history(spark, history, "x/12.json").count() == 1
    names = ["data/My Orders (1).csv", "12.csv", "...", "a.b.c", "/x/_y_.csv", "plain", ".csv"]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.k for r in table.selectExpr("n", f"{sinks.key_of('n')} AS k").collect()}
    assert got == {n: sinks.dataset_key(n) for n in names}


def test_long_comments_and_sections_take_linear_time(spark, tmp_path):
    path = tmp_path / "c.xml"
    many = "a > b " * 200_000
    path.write_text(f"<!--> {many}--><list><!----><r><v><![CDATA[{many}]]></v></r><!-- {many} --><r><v>2</v></r></list>")
    started = time.time()
    rows = readers.read_xml(spark, str(path)).collect()
    assert [len(r.v) for r in rows] == [len(many.strip()), 1] or [len(r.v) for r in rows] == [len(many), 1]
    assert time.time() - started < 60


def test_xml_without_a_tag_is_read_file_by_file_without_a_sort(spark, tmp_path, monkeypatch):
    folder = tmp_path / "many.xml"
    folder.mkdir()
    for f in range(3):
        (folder / f"{f}.xml").write_text("<export>" + "".join(
            f"<rec><key>{f}-{i}</key></rec>" for i in range(3000 * (f + 1))) + "</export>")
    plans = []
    write = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: (plans.append(
        self._df._jdf.queryExecution().executedPlan().toString()), write(self, path))[1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    try:
        rows = readers.read_xml(spark, str(folder)).select("key").collect()
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "5000b"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before[1]
    assert {r.key for r in rows} == {f"{f}-{i}" for f in range(3) for i in range(3000 * (f + 1))}
    assert len(rows) == 18000 and plans and "Exchange" not in plans[0] and "Sort" not in plans[0]
