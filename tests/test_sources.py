import glob
import os

import pytest
from pyspark.sql import functions as F

from basketline import errors
from basketline.operators import cleaning, metrics
from basketline.plans import bootstrap, dashboard
from basketline.session import stored, unread_tables
from basketline.sources import intake, snapshots
from basketline.sources.tables import raw_lines, typed_lines
from basketline.streaming import continuous
from tests.frames import sample_lines

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"
LINE = "7001,LOAF,Rye loaf,4,5/6/2025 7:40,2.50,311,Norway"
KEY = b"\x01" * 32


def put(folder, name, content):
    path = os.path.join(str(folder), name)
    with open(path, "wb") as handle:
        handle.write(content if isinstance(content, bytes) else content.encode())
    return path


def test_reads_text_in_order(spark, tmp_path):
    put(tmp_path, "a.csv", "﻿" + HEADER + '\r\n1,2,"a ""b""\nc, d",3,x,4,,UK\r\n5,6,,"",,,,\n')
    rows = intake.ingest(spark, str(tmp_path)).orderBy("ord").collect()
    assert rows[0]["Description"] == 'a "b"\nc, d' and rows[0]["CustomerID"] is None
    assert [row["row"] for row in rows] == [1, 2]
    assert rows[1]["Quantity"] is None


def test_layouts_may_differ(spark, tmp_path):
    put(tmp_path, "a.csv", f"{HEADER}\n{LINE}\n")
    moved = "Country," + HEADER.rsplit(",", 1)[0]
    put(tmp_path, "b.csv", f"{moved}\nFrance,1,2,x,3,d,4,5\n")
    put(tmp_path, "c.csv", (HEADER + "\n1,2,caf\xe9,3,d,4,5,UK\n").encode("latin-1"))
    frame = intake.ingest(spark, str(tmp_path))
    assert {row["Country"] for row in frame.collect()} == {"Norway", "France", "UK"}
    assert frame.where(F.col("Description") == "caf\xe9").count() == 1


@pytest.mark.parametrize(
    ("name", "content", "error"),
    [
        ("a.txt", "x", errors.UnsupportedFileTypeError),
        ("a.csv", b"PK\x03\x04abc", errors.MimeMismatchError),
        ("a.csv", b"a,b\x00", errors.MimeMismatchError),
        ("a.xlsx", b"plain", errors.MimeMismatchError),
        ("a.csv", HEADER.replace(",Country", ""), errors.SchemaViolationError),
        ("a.csv", HEADER + ",Extra", errors.SchemaViolationError),
        ("a.csv", HEADER.replace("Country", "InvoiceNo"), errors.SchemaViolationError),
        ("a.csv", HEADER.replace("StockCode", ",StockCode"), errors.SchemaViolationError),
        ("a.csv", HEADER + ",", errors.SchemaViolationError),
        ("a.csv", HEADER + "," * 40 + "Extra", errors.SchemaViolationError),
        ("a.csv", "a" * 9000 + "\x00", errors.MimeMismatchError),
        ("a.csv", "", errors.FileParseError),
        ("a.csv", f"{HEADER}\n=1+1,2,3,4,5,6,7,8\n", errors.FormulaInjectionError),
    ],
)
def test_bad_files(spark, tmp_path, name, content, error):
    put(tmp_path, name, content)
    with pytest.raises(error):
        intake.ingest(spark, str(tmp_path))


def test_limits(spark, tmp_path):
    put(tmp_path, "a.csv", f"{HEADER}\n{LINE}\n{LINE}\n")
    with pytest.raises(errors.FileTooLargeError):
        intake.ingest(spark, str(tmp_path), max_file_bytes=8)
    with pytest.raises(errors.FileTooLargeError):
        intake.ingest(spark, str(tmp_path), max_rows=1)
    assert intake.ingest(spark, str(tmp_path), max_rows=2).count() == 2
    with pytest.raises(ValueError):
        intake.ingest(spark, str(tmp_path), max_rows=0)


def test_the_row_cap_counts_records_before_anything_is_written(spark, tmp_path, monkeypatch):
    broken = LINE + "\n" + LINE.replace(LINE.split(",")[2], '"of two\nlines, ""quoted"""')
    put(tmp_path, "a.csv", f"{HEADER}\n{broken}\n\n{LINE}\n")
    put(tmp_path, "b.csv", f"{HEADER}\n")
    put(tmp_path, "c.csv", f"{HEADER}\r{LINE}\r{LINE}\r")
    report = intake.inspect_files(spark, str(tmp_path))
    counted = {r["file"][-5:]: r["rows"] for r in intake.data_rows(spark, str(tmp_path), report).collect()}
    assert counted == {"a.csv": 3, "b.csv": 0, "c.csv": 2}
    assert intake.ingest(spark, str(tmp_path), max_rows=5).count() == 5

    def unexpected(*_):
        raise AssertionError("written past the cap")

    monkeypatch.setattr(intake, "written", unexpected)
    with pytest.raises(errors.FileTooLargeError):
        intake.ingest(spark, str(tmp_path), max_rows=4)


def test_too_many_cells_fail(spark, tmp_path):
    put(tmp_path, "a.csv", f"{HEADER}\n{LINE},more\n")
    with pytest.raises(Exception, match="more cells"):
        intake.ingest(spark, str(tmp_path)).collect()


def test_permissive_scan_and_report(spark, tmp_path):
    put(tmp_path, "a.csv", f"{HEADER}\n{LINE}\n @x,2,=y,-6,5,+.5e3,7,8\n")
    frame = intake.ingest(spark, str(tmp_path), strict=False)
    issues = intake.formula_issues(frame).orderBy("position").collect()
    assert [(i["row"], i["column"]) for i in issues] == [(2, "InvoiceNo"), (2, "Description")]
    report = intake.quality_report(frame).first().asDict()
    assert report == {
        "total_rows": 2, "accepted_rows": 1, "error_count": 2, "warning_count": 0,
        "has_errors": True,
    }


def test_check_columns():
    intake.check_columns(list(reversed(HEADER.split(","))))
    with pytest.raises(errors.SchemaViolationError, match="duplicate"):
        intake.check_columns(HEADER.split(",") + ["Country"])


def test_mapped_tables_clean_to_the_typed_lines(spark, small):
    cleaned = cleaning.clean(raw_lines(spark, small), cleaning.ROW_LOCAL_STAGES)
    typed = typed_lines(spark, small)
    assert raw_lines(spark, small).select("ord").distinct().count() == raw_lines(spark, small).count()
    assert typed_lines(spark, small, guests=True).where("CustomerID IS NULL").count() > 0
    assert cleaned.exceptAll(typed).count() == 0 and typed.exceptAll(cleaned).count() == 0


def test_snapshot_round_trip(spark, tmp_path):
    lines, store = sample_lines(spark), str(tmp_path)
    with pytest.raises(errors.StorageError, match="no snapshot"):
        snapshots.latest_snapshot(spark, store)
    for name in ("20260102T000000Z", "20260101T000000Z"):
        written = snapshots.write_snapshot(lines, store, KEY, name)
    assert written == {"snapshot_id": "20260101T000000Z", "rows": 6, "columns": 12}
    assert snapshots.list_snapshots(spark, store) == ["20260101T000000Z", "20260102T000000Z"]
    assert snapshots.latest_snapshot(spark, store) == "20260102T000000Z"
    restored = snapshots.read_snapshot(spark, store, KEY, verify=True)
    assert restored.schema == lines.schema
    assert restored.orderBy("ord").collect() == lines.orderBy("ord").collect()
    files = glob.glob(f"{store}/data/**/*.parquet", recursive=True)
    assert not any(b"Rye loaf" in open(path, "rb").read() for path in files)


def test_snapshot_integrity(spark, tmp_path):
    store = str(tmp_path)
    snapshots.write_snapshot(sample_lines(spark), store, KEY, "20260101T000000Z")
    with pytest.raises(errors.StorageError, match="damaged"):
        snapshots.read_snapshot(spark, store, b"\x02" * 32)
    with pytest.raises(errors.StorageError, match="no snapshot 2025"):
        snapshots.read_snapshot(spark, store, KEY, "20250101T000000Z")
    path = f"{store}/data/snapshot_id=20260101T000000Z"
    blocks = spark.read.parquet(path)
    swapped = blocks.withColumn("Country", F.col("Description"))
    swapped.write.parquet(f"{store}/swapped")
    altered = spark.read.parquet(f"{store}/swapped")
    altered.write.mode("overwrite").parquet(path)
    with pytest.raises(errors.StorageError, match="damaged"):
        snapshots.read_snapshot(spark, store, KEY, verify=True)
    with pytest.raises(Exception):
        snapshots.read_snapshot(spark, store, KEY).collect()
    assert snapshots.read_snapshot(spark, store, KEY, columns=["Revenue"], verify=True).count() == 6
    altered.limit(0).write.mode("overwrite").parquet(path)
    with pytest.raises(errors.StorageError, match="damaged"):
        snapshots.read_snapshot(spark, store, KEY)


def test_views_of_a_snapshot(spark, tmp_path):
    store = str(tmp_path)
    snapshots.write_snapshot(sample_lines(spark), store, KEY, "20260101T000000Z")
    seen = snapshots.read_view(spark, store, KEY, "revenue", "viewer")
    assert "CustomerID" not in seen.columns and "Country" in seen.columns
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "StockCode" not in plan
    with pytest.raises(errors.StorageError, match="closed"):
        snapshots.read_view(spark, store, KEY, "customers", "viewer")
    with pytest.raises(errors.StorageError, match="unknown view"):
        snapshots.read_view(spark, store, KEY, "secrets", "admin")


def test_bootstrap(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, "a.csv", f"{HEADER}\n{LINE}\nC7001,LOAF,Rye loaf,-4,5/7/2025 8:26,2.50,311,Norway\n")
    store = str(tmp_path / "store")
    name = bootstrap.ensure_snapshot(spark, str(source), store, KEY)
    assert bootstrap.ensure_snapshot(spark, str(source), store, KEY) == name
    lines = snapshots.read_snapshot(spark, store, KEY)
    assert lines.where("CustomerID = '311'").count() == 0
    assert lines.where("PairedInvoiceNo = '7001'").count() == 1
    assert metrics.revenue_summary(lines).first()["net_revenue"] == 0.0


def test_streamed_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, "a.csv", f"{HEADER}\n{LINE}\n")
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        raw = continuous.stream_raw_lines(spark, str(source))
        continuous.stream_clean_lines(raw, target, state).awaitTermination()
        put(source, "b.csv", f"{HEADER}\n{LINE}\n1,2,x,3,d,4,,UK\n")
    assert spark.read.parquet(target).count() == 2


def test_dashboard(spark):
    lines = sample_lines(spark)
    assert dashboard.analyses_for("customers", "viewer") == ()
    for tab, analysis in (
        ("revenue", "country_revenue"), ("products", "top_products"), ("time", "revenue_by_month"),
    ):
        assert dashboard.answer(lines, "viewer", tab, analysis).data.count() > 0
    with pytest.raises(errors.AccessError):
        dashboard.answer(lines, "viewer", "customers", "repeat_rate")
    with pytest.raises(ValueError, match="no analysis"):
        dashboard.run_analysis("profit", lines)
    chart = dashboard.answer(lines, "analyst", "customers", "customer_segments")
    assert chart.explanation.first()["row_count"] == 0
    with pytest.raises(ValueError, match="StockCode"):
        dashboard.answer(lines, "viewer", "revenue", "country_revenue", stock_codes=["LOAF"])


def test_inspection_writes_no_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    names, plain = [], intake.written
    monkeypatch.setattr(intake, "written", lambda frame, name: names.append(name) or plain(frame, name))
    assert [r["problem"] for r in intake.inspect_files(spark, str(tmp_path)).collect()] == ["schema_violation"]
    assert names == []


def test_lines_are_not_moved_to_their_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = intake._records(intake._numbered_lines(spark, str(tmp_path)))
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_are_joined_once(spark, small, monkeypatch):
    from basketline.plans import queries

    assert not any("lineitem" in name for name in queries.QUERIES["stage_metrics"](spark, small).inputFiles())
    calls, plain = [], queries.typed_lines
    monkeypatch.setattr(queries, "typed_lines", lambda *args, **more: calls.append(more) or plain(*args, **more))
    queries.QUERIES["chart_explanations"](spark, small)
    assert len(calls) == 1


def test_cells_of_plain_and_quoted_records_agree(spark, tmp_path):
    bare = [" 1 ,2,,3 ,x,4,=,UK", "1,2,3", ",,,,,,,", "7,café,\ta,-5,d,+1,5, "]
    put(tmp_path, "a.csv", HEADER + "\n" + "\n".join(bare) + "\r\n")
    wrapped = [",".join(f'"{cell}"' if cell else "" for cell in line.split(",")) for line in bare]
    put(tmp_path, "b.csv", HEADER + "\n" + "\n".join(wrapped) + "\r\n")
    rows = intake.ingest(spark, str(tmp_path), strict=False).orderBy("ord").collect()
    cells = [tuple(row)[:8] for row in rows]
    assert len(cells) == 8 and cells[:4] == cells[4:]
    assert cells[0] == (" 1 ", "2", None, "3 ", "x", "4", "=", "UK") and cells[1][3:] == (None,) * 5
    assert [row["ord"]["number"] for row in rows] == [1] * 4 + [2] * 4


def test_formulas_are_found_whatever_stands_before(spark):
    cells = {"=1": True, " =1": True, "@a": True, "-5.5": False, "-a": True, "＝1": True, "7=": False, "a": False, "": False,
             ":": False, "<": False, "~": False, "\x7f": False, "é": False, "\t": True, "?": False, None: False}
    frame = spark.createDataFrame(list(cells.items()), "cell string, expected boolean")
    assert frame.where(intake.is_formula(F.col("cell")) != F.col("expected")).collect() == []


def test_records_of_one_line_are_looked_through_once(spark, tmp_path):
    """Lines are read again for records of several lines only if there are any; raw lines are screened as they are written."""
    for name, cell, scans in (("one", '"a, b"', 1), ("several", '"a\nb"', 2)):
        folder = tmp_path / name
        folder.mkdir()
        put(folder, "a.csv", f"{HEADER}\n{LINE.replace('Rye loaf', cell)}\n")
        lines = intake.source_lines(spark, str(folder))
        frame = intake.scan_files(spark, str(folder), intake.inspect_files(spark, str(folder), lines=lines), lines)
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("begun0") and plan.count("Union") == scans - 1
        assert frame.count() == 1


def test_lines_of_a_file_are_not_sorted_to_find_its_header(spark, tmp_path):
    put(tmp_path, "a.csv", f"{HEADER}\n{LINE}\n")
    facts = intake._file_facts(intake._numbered_lines(spark, str(tmp_path)))
    assert "SortAggregate" not in facts._jdf.queryExecution().executedPlan().toString()
    assert facts.first()["first"] == HEADER.encode()


def test_ingest_writes_one_copy_of_the_lines(spark, tmp_path, monkeypatch):
    put(tmp_path, "a.csv", f'{HEADER}\n{LINE}\n{LINE.replace("Rye loaf", '"a' + chr(10) + 'b"')}\n')
    names = []
    for kind in ("written", "stored"):
        plain = getattr(intake, kind)
        monkeypatch.setattr(intake, kind, lambda frame, name, plain=plain: names.append(name) or plain(frame, name))
    assert intake.ingest(spark, str(tmp_path), max_rows=2).count() == 2
    assert names == ["raw-lines"]


def test_files_that_change_while_they_are_read(spark, tmp_path, monkeypatch):
    put(tmp_path, "a.csv", f"{HEADER}\n{LINE}\n{LINE}\n")
    put(tmp_path, "b.csv", f"{HEADER}\r{LINE}\r")
    assert intake.ingest(spark, str(tmp_path)).count() == 3
    plain = intake.scan_files
    monkeypatch.setattr(intake, "scan_files", lambda *args: plain(*args).where("row < 2"))
    with pytest.raises(errors.FileAccessError, match="changed"):
        intake.ingest(spark, str(tmp_path))


def test_scans_of_an_ingest_split_alike(spark):
    key = "spark.sql.files.minPartitionNum"
    with intake._splits_kept(spark):
        assert int(spark.conf.get(key)) == spark.sparkContext.defaultParallelism
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "3")
    try:
        with intake._splits_kept(spark):
            assert spark.conf.get(key) == "3"
        assert spark.conf.get(key) == "3"
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("keep", [True, False])
def test_bootstrap_holds_no_more_than_it_needs(spark, tmp_path, monkeypatch, keep):
    """While the snapshot is written the raw lines are gone, and the source if it is not to be kept; afterwards all tables are."""
    source, shared, seen = tmp_path / "in", tmp_path / "shared", []
    source.mkdir()
    put(source, "a.csv", f"{HEADER}\n{LINE}\nC7001,LOAF,Rye loaf,-4,5/7/2025 8:26,2.50,311,Norway\n")
    monkeypatch.setattr("basketline.session._application_folder", lambda _: str(shared))
    plain = bootstrap.write_snapshot

    def write(*args):
        seen.extend([sorted(name.rsplit("-", 1)[0] for name in os.listdir(shared)), source.exists()])
        return plain(*args)

    monkeypatch.setattr(bootstrap, "write_snapshot", write)
    bootstrap.ensure_snapshot(spark, str(source), str(tmp_path / "store"), KEY, keep_source=keep)
    assert seen == [["keyed-lines"], keep] and source.exists() is keep
    assert os.listdir(shared) == []
    assert snapshots.read_snapshot(spark, str(tmp_path / "store"), KEY).where("PairedInvoiceNo = '7001'").count() == 1
    put(tmp_path, "bad.csv", f"{HEADER}\n=1+1,2,3,4,5,6,7,8\n")
    with pytest.raises(errors.FormulaInjectionError):
        bootstrap.ensure_snapshot(spark, str(tmp_path / "bad.csv"), str(tmp_path / "none"), KEY, keep_source=keep)
    assert os.listdir(shared) == [] and (tmp_path / "bad.csv").exists()


def test_stored_tables_leave_no_shuffles(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for n in range(files.size()) if (name := files.apply(n).getName()).startswith("shuffle_")}

    before = shuffles()
    table = stored(spark.range(100).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert not [name for name in shuffles() - before if name.endswith(".data")]
    assert table.count() == 7
    assert unread_tables(table.where("k > 1"), [table.inputFiles()[0].rsplit("/", 1)[0], "x/other-1"]) == ["x/other-1"]


def test_shares_of_the_lines_are_all_lines(spark, small):
    whole, shares = raw_lines(spark, small), [raw_lines(spark, small, share=(n, 3)) for n in range(3)]
    together = shares[0].unionByName(shares[1]).unionByName(shares[2])
    assert together.exceptAll(whole).count() == 0 and whole.exceptAll(together).count() == 0
    assert all(share.count() > 0 for share in shares)


def test_repeated_texts_are_packed_as_a_dictionary(spark, tmp_path):
    """A few long texts in many rows, with nulls, take little room and come back as they were."""
    text = F.sha2((F.col("id") % 50).cast("string"), 256)
    lines = spark.range(20_000).select("id", F.when(F.col("id") % 7 > 0, text).alias("text"), F.col("id").cast("string").alias("each"))
    snapshots.write_snapshot(lines, str(tmp_path), KEY, "20260101T000000Z")
    restored = snapshots.read_snapshot(spark, str(tmp_path), KEY, verify=True)
    assert restored.schema == lines.schema and restored.orderBy("id").collect() == lines.orderBy("id").collect()
    blocks = spark.read.parquet(f"{tmp_path}/data").agg(F.sum(F.octet_length("text"))).first()[0]
    assert blocks < 2 * 20_000
