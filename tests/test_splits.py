import csv
import io
import random

import pytest

from basketline.schema import RAW_COLUMNS
from basketline.sources import intake


def rows_of(draw, n):
    pool = ["plain", "", 'a "quoted" word', "two\nlines", "\n", '"', '""', "x,y", "\r\n", "é日本", " spaced ", "a\n\nb\n", "=1+1"]
    return [[f"{i}", *[draw.choice(pool) for _ in RAW_COLUMNS[1:]]] for i in range(n)]


def written_file(path, header, rows, end="\n", encoding="utf-8", blank=False):
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator=end)
    writer.writerow(header)
    for i, row in enumerate(rows):
        writer.writerow(row)
        if blank and i % 5 == 0:
            text.write(end)
    path.write_bytes(text.getvalue().encode(encoding, "replace"))


def as_cells(rows, header, encoding="utf-8"):
    order = [header.index(name) for name in RAW_COLUMNS]
    return [tuple(row[i].encode(encoding, "replace").decode(encoding) or None for i in order) for row in rows]


@pytest.mark.parametrize("size", [500, 1 << 20])
def test_records_over_any_splits(spark, tmp_path, size):
    """Files in many pieces, cut anywhere, with quoted line breaks, blank lines, two encodings and orders of columns."""
    draw = random.Random(size)
    first, second, third = (rows_of(draw, n) for n in (60, 25, 40))
    turned = list(reversed(RAW_COLUMNS))
    written_file(tmp_path / "a.csv", list(RAW_COLUMNS), first, blank=True)
    written_file(tmp_path / "b.csv", turned, second, end="\r\n")
    written_file(tmp_path / "c.csv", list(RAW_COLUMNS), third, encoding="latin-1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = intake.source_lines(spark, str(tmp_path))
        blocks = lines.select("file", "block").distinct().count()
        assert blocks > 3
        report = intake.inspect_files(spark, str(tmp_path), None, lines)
        found = intake.scan_files(spark, str(tmp_path), report, lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert {r["problem"] for r in report.collect()} == {None}
    got = {}
    for r in sorted(found, key=lambda r: r["row"]):
        got.setdefault(r["file"][-5:], []).append((r["row"], tuple(r[name] for name in RAW_COLUMNS)))
    want = {"a.csv": as_cells(first, list(RAW_COLUMNS)), "b.csv": as_cells(second, turned), "c.csv": as_cells(third, list(RAW_COLUMNS), "latin-1")}
    assert got == {name: [*enumerate(rows, 1)] for name, rows in want.items()}


def test_a_file_that_ends_within_quotes(spark, tmp_path):
    """The last record takes in all that is left."""
    good = [["1", *["x"] * 7]]
    written_file(tmp_path / "a.csv", list(RAW_COLUMNS), good)
    with open(tmp_path / "a.csv", "a") as file:
        file.write('2,"open\n3,x,x,x,x,x,x,x\n')
    report = intake.inspect_files(spark, str(tmp_path))
    rows = intake.scan_files(spark, str(tmp_path), report).orderBy("row").collect()
    assert [(r["row"], r[RAW_COLUMNS[0]]) for r in rows] == [(1, "1"), (2, "2")]


def test_old_line_breaks_and_large_files(spark, tmp_path):
    written_file(tmp_path / "a.csv", list(RAW_COLUMNS), [["1", *["x"] * 7], ["2", *["y"] * 7]], end="\r")
    written_file(tmp_path / "b.csv", list(RAW_COLUMNS), [["3", *["z" * 500] * 7]])
    (tmp_path / "none.csv").write_bytes(b"")
    report = {r["file"][-5:]: r for r in intake.inspect_files(spark, str(tmp_path), 1000).collect()}
    assert report["b.csv"]["problem"] == "too_large" and report["b.csv"]["encoding"] is None
    assert report["e.csv"]["problem"] == "empty" and report["a.csv"]["problem"] is None
    whole = intake.inspect_files(spark, str(tmp_path))
    rows = intake.scan_files(spark, str(tmp_path), whole).collect()
    assert sorted((r["row"], r[RAW_COLUMNS[0]]) for r in rows) == [(1, "1"), (1, "3"), (2, "2")]
