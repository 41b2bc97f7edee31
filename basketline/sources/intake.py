"""Delimited source files: file checks, all-text scan, formula screening, quality report.

Files are read as lines, in as many tasks as Spark splits them into, and never as a whole. What is asked of a file
(whether it is valid UTF-8, binary, and its first line) adds up over its lines. Records may hold quoted line breaks:
a line goes on a record if the quotes before it are odd in number. Each split counts its quotes, and its records for
either case; sums over the splits of a file then tell which case holds, and number the records. Only records of
several lines are put together by a shuffle. To ingest, files are scanned twice, for these sums and for the cells, so
that no copy of the lines is written.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketline import schema
from basketline.errors import (
    FileAccessError,
    FileParseError,
    FileTooLargeError,
    FormulaInjectionError,
    MimeMismatchError,
    SchemaViolationError,
    UnsupportedFileTypeError,
)
from basketline.functions.text import is_formula
from basketline.operators.ordinals import with_ordinals
from basketline.session import materialize, stored, written

_PROBLEM_ERRORS = {
    "unsupported_extension": UnsupportedFileTypeError,
    "too_large": FileTooLargeError,
    "mime_mismatch": MimeMismatchError,
    "unreadable_format": UnsupportedFileTypeError,
    "empty": FileParseError,
    "schema_violation": SchemaViolationError,
}


def check_columns(columns: list[str]) -> None:
    """Raise unless the columns are exactly the raw ones, in any order."""
    repeated = sorted({name for name in columns if columns.count(name) > 1})
    if repeated:
        raise SchemaViolationError(f"duplicate columns: {', '.join(repeated)}")
    missing = [name for name in schema.RAW_COLUMNS if name not in columns]
    unexpected = [name for name in columns if name not in schema.RAW_COLUMNS]
    if missing or unexpected:
        raise SchemaViolationError(f"missing={missing}; unexpected={unexpected}")


def _first_line(line: Column, utf8: Column) -> Column:
    """First line of a file as text, without a byte-order mark."""
    raw = line.cast("binary")
    text = F.when(utf8, F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.ltrim(F.substring_index(F.rtrim(text, F.lit("\r")), "\r", 1), F.lit("\ufeff"))


def _header(line: Column) -> Column:
    """All cells of a header line; an empty cell is an empty text."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))

    def bare(cell: Column) -> Column:
        inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1), inner).otherwise(cell)

    return F.transform(cells, bare)


def _line_numberer():
    """Batch function that numbers lines from 0 within each split of a file (a stretch of rows in order).

    Adds odd (whether the quotes before the line, from the start of the split, are odd in number), and the records
    begun so far if the split starts outside of quotes, and if inside. An empty line begins no record.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, quotes, begun = None, 0, 0, [0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = pc.dictionary_encode(batch.column("file"))
            codes, blocks = names.indices.to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            counts = batch.column("quotes").to_numpy().astype(np.int64)
            full = ~batch.column("blank").to_numpy(zero_copy_only=False)
            out = np.empty((4, n), np.int64)
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                key = names.dictionary[int(codes[a])].as_py(), int(blocks[a])
                if key != current:
                    current, place, quotes, begun = key, 0, 0, [0, 0]
                upto = quotes + np.cumsum(counts[a:b])
                odd = (upto - counts[a:b]) & 1
                out[0, a:b] = np.arange(place, place + b - a)
                out[1, a:b] = odd
                for case in (0, 1):
                    out[2 + case, a:b] = begun[case] + np.cumsum(full[a:b] & (odd == case))
                    begun[case] = int(out[2 + case, b - 1])
                place, quotes = place + b - a, int(upto[-1])
            columns = [*batch.columns, *(pa.array(x) for x in out)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "place", "odd", "begun0", "begun1"])

    return number


def _text_lines(spark: SparkSession, path: str | list[str], max_file_bytes: int | None = None) -> DataFrame:
    """The lines of all files as Spark reads them; files above the size limit are not opened."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    return lines if max_file_bytes is None else lines.where(F.col("_metadata.file_size") <= max_file_bytes)


def _text_flags(value: Column) -> dict[str, Column]:
    """What is asked of each line of a file, given as bytes."""
    return {"utf8": F.is_valid_utf8(value.cast("string")), "binary": F.contains(value, F.lit(bytearray(b"\0")))}


def _numbered_lines(
    spark: SparkSession,
    path: str | list[str],
    max_file_bytes: int | None = None,
    text: DataFrame | None = None,
    whole: bool = True,
) -> DataFrame:
    """The lines of all files: file, block (where their split starts), place, value and counts.

    text: those of `_text_lines`, if they are there already. Not whole: what `_split_sums` asks of lines in place of
    their values, which are left to the first splits of files, where the header is.
    """
    lines = _text_lines(spark, path, max_file_bytes) if text is None else text
    raw, block, value = F.octet_length("value"), F.col("_metadata.file_block_start"), F.col("value").cast("binary")
    flags = {} if whole else _text_flags(value)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        block.alias("block"),
        (value if whole else F.when(block == 0, value)).alias("value"),
        *[flag.alias(name) for name, flag in flags.items()],
        F.when(F.contains("value", F.lit('"')), raw - F.octet_length(F.replace("value", F.lit('"'), F.lit(""))))
        .otherwise(0).cast("int").alias("quotes"),
        ((raw == 0) | (F.col("value") == "\r")).alias("blank"),
    )
    fields = T.StructType([*lines.schema.fields])
    for name in ("place", "odd", "begun0", "begun1"):
        fields = fields.add(name, "long")
    return lines.mapInArrow(_line_numberer(), fields)


def source_lines(spark: SparkSession, path: str | list[str], max_file_bytes: int | None = None) -> DataFrame:
    """The numbered lines of all files, written once."""
    return written(_numbered_lines(spark, path, max_file_bytes), "source-lines")


@contextmanager
def _splits_kept(spark: SparkSession) -> Iterator[None]:
    """All scans of a file in here split it alike, also if executors come or go in between."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    if before is None:
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def _split_sums(lines: DataFrame) -> DataFrame:
    """Per split what its lines add up to, in one pass: counts for `_splits`, and what `_file_facts` asks for. Lines that
    are such sums already are returned as they are."""
    if "loose0" in lines.columns:
        return lines
    flags = {} if "utf8" in lines.columns else _text_flags(F.col("value"))
    first = F.when((F.col("block") == 0) & (F.col("place") == 0), F.col("value"))
    even = F.col("quotes") % 2 == 0
    return lines.withColumns(flags).groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("odd"), F.max("begun0").alias("begun0"), F.max("begun1").alias("begun1"),
        *[F.count_if(~((F.col("odd") == case) & even)).alias(f"loose{case}") for case in (0, 1)],
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("binary").alias("binary"),
        # There is one at most; the largest would be found by sorting all lines, as texts have no fixed width.
        F.get(F.collect_list(first), F.lit(0)).alias("first"),
    )


def _file_facts(lines: DataFrame) -> DataFrame:
    """Per file what its lines add up to, and its first line."""
    return _split_sums(lines).groupBy("file").agg(
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("binary").alias("binary"),
        F.get(F.collect_list("first"), F.lit(0)).alias("first"),
    )


def _empty_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Path of every file of zero bytes, which Spark's file sources leave out of their listings."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for name in [path] if isinstance(path, str) else path:
        root = jvm.org.apache.hadoop.fs.Path(name)
        listing = root.getFileSystem(conf).listFiles(root, True)
        while listing.hasNext():
            status = listing.next()
            if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
                found.append((status.getPath().toString(),))
    return spark.createDataFrame(found, "path string")


def inspect_files(
    spark: SparkSession,
    path: str | list[str],
    max_file_bytes: int | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """One row per file: kind, size, short name digest, encoding, header, and `problem` or null.

    With a size limit, files above it are listed without being opened. Files of zero bytes are listed as
    empty. lines: those of `source_lines`, or their `_split_sums`, if they are there already.
    """
    if max_file_bytes is not None and max_file_bytes < 1:
        raise ValueError("the byte limit must be above zero")
    lines = _numbered_lines(spark, path, max_file_bytes) if lines is None else lines
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    facts = {
        "file": F.col("path"),
        "source_id": F.substring(F.sha2(name, 256), 1, 12),
        "extension": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)),
        "length": F.col("length"),
    }
    described = [column.alias(label) for label, column in facts.items()]
    # The contents are not asked for, so the files are listed and not opened.
    listed = files.select("path", "length").unionByName(_empty_files(spark, path).withColumn("length", F.lit(0).cast("long")))
    zipped = F.startswith("first", F.lit(bytearray(schema.ZIP_SIGNATURE)))
    utf8, binary = F.coalesce("utf8", F.col("length") == 0), F.coalesce("binary", F.lit(False))
    opened = (F.col("length") == 0) | F.col("utf8").isNotNull()
    everything = listed.select(*described).join(_file_facts(lines), "file", "left").select(
        *facts,
        F.when(opened, F.coalesce(zipped, F.lit(False))).alias("zipped"),
        F.when(opened, binary).alias("binary"),
        F.when(opened, F.when(utf8, "UTF-8").otherwise("ISO-8859-1")).alias("encoding"),
        F.when(~zipped & ~binary, _first_line(F.col("first"), F.col("utf8"))).alias("line"),
        # A carriage return within the first line: lines end by these alone.
        F.coalesce(F.contains(F.rtrim(F.col("first").cast("string"), F.lit("\r")), F.lit("\r")), F.lit(False)).alias("old_breaks"),
    )
    everything = materialize(everything)
    everything = everything.withColumn("header", _header(F.col("line")))
    extension, header = F.col("extension"), F.col("header")
    required = F.array(*[F.lit(column) for column in schema.RAW_COLUMNS])
    valid_header = (F.size(header) == len(schema.RAW_COLUMNS)) & (
        F.array_sort(header) == F.array_sort(required)
    )
    problem = (
        F.when(~extension.isin("csv", "xlsx"), "unsupported_extension")
        .when((extension == "xlsx") & ~F.col("zipped"), "mime_mismatch")
        .when((extension == "csv") & (F.col("zipped") | F.col("binary")), "mime_mismatch")
        .when(F.lit(False) if max_file_bytes is None else F.col("length") > max_file_bytes, "too_large")
        .when(extension == "xlsx", "unreadable_format")
        .when(F.col("length") == 0, "empty")
        .when(~F.coalesce(valid_header, F.lit(False)), "schema_violation")
    )
    return everything.withColumn("problem", problem).drop("zipped", "binary", "line")


def require_clean_files(report: DataFrame) -> None:
    """Raise for the first file, by name, that has a problem."""
    found = report.where(F.col("problem").isNotNull()).orderBy("file").first()
    if found is not None:
        error = _PROBLEM_ERRORS[found["problem"]]
        raise error(f"source {found['source_id']}: {found['problem']} header={found['header']}")


def _row_numberer():
    """Batch function that numbers rows from 1 within each file.

    A file is never split and its rows arrive in order, so a running count is exact and needs no
    shuffle.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count = None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column("file"))
            rows, begin = [], 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name != current:
                    current, count = name, 0
                rows.append(np.arange(count + 1, count + 1 + end - begin))
                count += end - begin
                begin = end
            numbers = np.concatenate(rows) if rows else np.empty(0, "int64")
            yield batch.append_column("row", pa.array(numbers, pa.int64()))

    return number


def _read(spark: SparkSession, path, header: list[str], encoding: str, only: DataFrame | None) -> DataFrame:
    """Rows of files whose lines end by carriage returns alone, numbered; a file is one task.

    `only` lists them if the path holds others.
    """
    fields = [T.StructField(name, T.StringType()) for name in (*header, "_record")]
    lines = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_record")
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", True)
        .option("recursiveFileLookup", "true")
        .csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    numbered = T.StructType([*lines.schema.fields, T.StructField("row", T.LongType())])
    lines = lines.mapInArrow(_row_numberer(), numbered)
    if only is not None:
        lines = lines.join(only, "file", "left_semi")
    return _with_cells(lines, header)


def _with_cells(lines: DataFrame, header: list[str]) -> DataFrame:
    """The raw columns of parsed rows, and file and row."""
    # A record with too few cells is padded with nulls; one with too many is an error.
    wide = ", ".join(f"c{n} string" for n in range(len(header) + 1))
    extra = F.from_csv("_record", wide, {"escape": '"', "nullValue": "\x01"})[f"c{len(header)}"]
    cells = {name: F.nullif(F.col(name), F.lit("")) for name in header}
    cells[header[0]] = F.when(
        F.col("_record").isNotNull() & extra.isNotNull(),
        F.raise_error(F.lit("a record has more cells than the header")),
    ).otherwise(cells[header[0]])
    return lines.select(*[cells[name].alias(name) for name in schema.RAW_COLUMNS], "file", "row")


def _splits(lines: DataFrame) -> DataFrame:
    """Splits of all files: whether they begin inside quotes, how many records begin in and before them, and their
    lines that are not a record alone."""
    blocks = _split_sums(lines)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(earlier) % 2, F.lit(0))
    blocks = blocks.withColumn("inside", inside)
    begun = F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    loose = F.when(F.col("inside") == 0, F.col("loose0")).otherwise(F.col("loose1")).alias("loose")
    return blocks.withColumn("own", begun).select(
        "file", "block", "inside", "own", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), loose
    )


def _records(lines: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """The records of all files: file, record (from 1, the header is the first) and text, as bytes.

    splits: those of the lines, if they are there already; then lines are looked through for records of several
    lines only where the splits count some.
    """
    counted, splits = splits is not None, _splits(lines) if splits is None else splits
    # One small row per split: the lines stay where they are.
    placed = lines.join(F.broadcast(splits.drop("own", "loose")), ["file", "block"]).withColumn("starts", F.col("odd") == F.col("inside"))
    number = F.col("before") + F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    placed = placed.where(~(F.col("starts") & F.col("blank"))).withColumn("record", number)
    alone = F.col("starts") & (F.col("quotes") % 2 == 0)
    single = placed.where(alone).select("file", "record", "value")
    if counted and not splits.where("loose > 0").head(1):
        return single
    # Every line that does not stand alone is of a record of several lines, or of one that never ends.
    pieces = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    broken = F.lit(bytearray(b"\n"))
    joined = F.aggregate(pieces, F.lit(bytearray(b"")), lambda text, line: F.concat(text, broken, line["value"]))
    several = placed.where(~alone).groupBy("file", "record").agg(joined.alias("value"))
    several = several.withColumn("value", F.substring("value", 2, 2_147_483_646))
    return single.unionByName(several)


def _parsed(records: DataFrame, header: list[str], encoding: str) -> DataFrame:
    """Records of files with this layout as cells; the header is left out."""
    fields = ", ".join(f"`{name}` string" for name in (*header, "_record"))
    # Files are UTF-8 only if all their lines are valid.
    text = F.col("value").cast("string") if encoding == "UTF-8" else F.decode("value", encoding)
    text = F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record", "quote": '"', "escape": '"', "multiLine": "true"}
    rows = records.where("record > 1").select("file", (F.col("record") - 1).alias("row"), text.alias("text"))
    # A record without quotes and breaks that has as many cells as the header is cut at its commas.
    cut = rows.withColumn("parts", F.split("text", ",", -1))
    breaks = [F.contains("text", F.lit(mark)) for mark in ('"', "\r", "\n", "\0")]
    plain = (F.size("parts") == len(header)) & ~reduce(or_, breaks)
    parts = [F.get("parts", F.lit(n)).alias(name) for n, name in enumerate(header)]
    cells = F.struct(*parts, F.lit(None).cast("string").alias("_record"))
    parsed = cut.select("file", "row", F.when(plain, cells).otherwise(F.from_csv("text", fields, options)).alias("cells"))
    return parsed.select("cells.*", "file", "row")


def scan_files(
    spark: SparkSession, path: str | list[str], report: DataFrame, lines: DataFrame | None = None, sums: DataFrame | None = None
) -> DataFrame:
    """Read inspected files as text columns plus (file, row) and the source order `ord`.

    lines, sums: those of `source_lines`, and their `_split_sums`, if they are there already.
    Files are read per layout: one header order and one encoding at a time. There are only a few
    layouts: orders of eight names in two encodings. Which file has which is a join, so no list of
    paths comes to the driver; when all files share one layout, there is nothing to join.
    """
    accepted = report.where(F.col("problem").isNull() & (F.col("extension") == "csv"))
    layouts = accepted.groupBy("header", "encoding", "old_breaks").count().collect()
    if not layouts:
        raise FileAccessError("no readable source file")
    everything = report.count() == sum(layout["count"] for layout in layouts)
    lines = source_lines(spark, path) if lines is None else lines
    records = _records(lines, materialize(_splits(lines if sums is None else sums)))
    frame = None
    for layout in layouts:
        only = None
        if len(layouts) > 1 or not everything:
            only = accepted.where(
                (F.col("header") == F.array(*[F.lit(name) for name in layout["header"]]))
                & (F.col("encoding") == layout["encoding"])
                & (F.col("old_breaks") == layout["old_breaks"])
            ).select("file")
        if layout["old_breaks"]:
            part = _read(spark, path, layout["header"], layout["encoding"], only)
        else:
            own = records if only is None else records.join(only, "file", "left_semi")
            part = _with_cells(_parsed(own, layout["header"], layout["encoding"]), layout["header"])
        frame = part if frame is None else frame.unionByName(part)
    return frame.withColumn("ord", F.struct("file", "row"))


def _counted_rows(lines: DataFrame) -> DataFrame:
    """Data rows per file (file, rows) by the sums over its splits."""
    return _splits(lines).groupBy("file").agg(F.greatest(F.sum("own") - 1, F.lit(0)).alias("rows"))


def _require_all_rows(frame: DataFrame, report: DataFrame, sums: DataFrame) -> None:
    """Raise unless all rows that were counted in the files were read; files must not change while they are read."""
    plain = report.where("NOT old_breaks").select("file")
    counted = _counted_rows(sums).join(plain, "file", "left_semi").agg(F.sum("rows")).first()[0]
    if not report.where("old_breaks").isEmpty():
        frame = frame.join(F.broadcast(plain), "file", "left_semi")
    if frame.count() != (counted or 0):
        raise FileAccessError("the source files changed while they were read")


def data_rows(spark: SparkSession, path: str | list[str], report: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Data rows per inspected file (file, rows), from the sums that also number the records; no row is parsed.

    Only files whose lines end by carriage returns alone are read as rows. lines: those of `source_lines`, or their
    `_split_sums`, if they are there already.
    """
    accepted = report.where(F.col("problem").isNull() & (F.col("extension") == "csv"))
    lines = _numbered_lines(spark, path) if lines is None else lines
    own = _counted_rows(lines)
    counted = accepted.where("NOT old_breaks").select("file").join(own, "file", "left")
    old = accepted.where("old_breaks").select("file", "header", "encoding")
    for layout in old.select("header", "encoding").distinct().collect():  # orders of eight names in two encodings
        same = (F.col("header") == F.array(*[F.lit(name) for name in layout["header"]])) & (F.col("encoding") == layout["encoding"])
        only = old.where(same).select("file")
        part = _read(spark, path, layout["header"], layout["encoding"], only)
        per_file = part.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
        counted = counted.unionByName(only.join(per_file, "file", "left"))
    return counted.select("file", F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows"))


def check_row_cap(rows: DataFrame, max_rows: int | None) -> None:
    """Raise if the files have more data rows together than the cap; no cap by default."""
    if max_rows is None:
        return
    if max_rows < 1:
        raise ValueError("the row cap must be above zero")
    if (rows.agg(F.sum("rows")).first()[0] or 0) > max_rows:
        raise FileTooLargeError(f"more than {max_rows:,} data rows")


def formula_issues(
    frame: DataFrame, columns: list[str] | None = None, row_columns: tuple[str, ...] = ("file", "row")
) -> DataFrame:
    """One row per cell that a spreadsheet would run as a formula."""
    columns = list(columns or schema.RAW_COLUMNS)
    cells = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("column"),
                is_formula(F.col(name)).alias("unsafe"),
            )
            for position, name in enumerate(columns, start=1)
        ]
    )
    unsafe = F.filter(cells, lambda cell: cell["unsafe"])
    keys = [name for name in row_columns if name in frame.columns]
    # Nearly all rows have no such cell; only the others are taken apart.
    suspects = frame.where(reduce(or_, [is_formula(F.col(name)) for name in columns]))
    return suspects.select(*keys, F.inline(unsafe)).select(
        *keys,
        "position",
        "column",
        F.lit("FORMULA_INJECTION").alias("code"),
        F.lit("error").alias("severity"),
        F.format_string(
            "a spreadsheet would run this cell of column %s", F.col("column")
        ).alias("message"),
    )


def require_no_formulas(issues: DataFrame) -> None:
    """Raise for the first issue by column, then row."""
    keys = [name for name in ("file", "row") if name in issues.columns]
    first = issues.orderBy("position", *keys).limit(1).collect()
    if first:
        place = ", ".join(f"{name}={first[0][name]}" for name in ("row",) if name in keys)
        raise FormulaInjectionError(f"{first[0]['message']} {place}".strip())


def quality_report(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, rows without an error, error and warning counts, has_errors."""
    columns = list(columns or schema.RAW_COLUMNS)
    errors = sum((is_formula(F.col(name)).cast("bigint") for name in columns), F.lit(0))
    return frame.select(errors.alias("errors")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("errors") == 0).alias("accepted_rows"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"),
        F.lit(0).cast("bigint").alias("warning_count"),
        F.coalesce(F.max("errors") > 0, F.lit(False)).alias("has_errors"),
    )


def ingest(
    spark: SparkSession,
    path: str | list[str],
    strict: bool = True,
    max_file_bytes: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Check, read and screen source files. Strict mode raises at the first formula cell.

    The source order `ord` is the number of the file, by its path, and the row.

    A row cap is held against the counted records first, so nothing is written past it.
    """
    with _splits_kept(spark):
        text = _text_lines(spark, path, max_file_bytes)
        sums = materialize(_split_sums(_numbered_lines(spark, path, text=text, whole=False)))
        report = inspect_files(spark, path, max_file_bytes, sums)
        require_clean_files(report)
        if max_rows is not None:
            check_row_cap(data_rows(spark, path, report, sums), max_rows)
        # Files by number in the source order: rows are sorted by it and paths are long. One small row per file.
        numbers = F.broadcast(with_ordinals(report.select("file"), ["file"], "_number"))
        # Parsed and screened once; all later steps read the columnar copy.
        unsafe = reduce(or_, [is_formula(F.col(name)) for name in schema.RAW_COLUMNS]) if strict else F.lit(False)
        lines = _numbered_lines(spark, path, text=text)
        screened = scan_files(spark, path, report, lines, sums).drop("ord").withColumn("_unsafe", unsafe).join(numbers, "file")
        frame = stored(screened, "raw-lines")
    _require_all_rows(frame, report, sums)
    if strict:
        require_no_formulas(formula_issues(frame.where("_unsafe")))
    order = F.struct(F.col("_number").alias("number"), "row")
    return frame.select(*schema.RAW_COLUMNS, "file", "row", order.alias("ord"))
