"""The registered queries: every operator run over the whole given tables.

Each takes (spark, folder) and returns a DataFrame. Dates are given out as text and computed
doubles rounded, so that results compare across engines.
"""

import datetime
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.errors import AuditIntegrityError, FileTooLargeError, StorageError
from basketline.operators import audit, cleaning, filters, metrics, pairing, privacy
from basketline.operators import segments, silhouette
from basketline.operators.ordinals import with_ordinals
from basketline.plans import bootstrap, dashboard
from basketline.schema import ORD, RAW_COLUMNS
from basketline.session import configure, materialize, scratch_path, shuffles_deleted, written
from basketline.sources import audit_seals, audit_store, intake, snapshots
from basketline.sources.tables import raw_lines, table, typed_lines, untidy_lines
from basketline.streaming import continuous

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Settings of the registered runs; the oracle SQL uses the same values.
KEY = bytes.fromhex("ab" * 32)
CHAIN_ROWS = 1_000
BLOCK_ROWS = 2
# Sets of orders whose lines are joined and written one after the other, so that only one's shuffles are there at a time.
FILE_SHARES = 4
FROM_DAY, TO_DAY = datetime.date(1996, 1, 1), datetime.date(1998, 12, 31)
MIDDLE = "2024-01-08T12:00:00+00:00"
CUTOFF = "2024-01-15T00:00:00+00:00"


def query(function: Query) -> Query:
    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder)

    QUERIES[function.__name__] = run
    return run


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def _minute(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm").alias(name)


# Metrics


@query
def revenue_summary(spark, folder):
    return metrics.revenue_summary(typed_lines(spark, folder, country=False))


@query
def top_products_by_revenue(spark, folder):
    top = metrics.top_products(typed_lines(spark, folder, country=False), "Revenue")
    return top.withColumn("Revenue", F.round("Revenue", 2))


@query
def top_products_by_quantity(spark, folder):
    top = metrics.top_products(typed_lines(spark, folder, country=False), "Quantity")
    return top.withColumn("Revenue", F.round("Revenue", 2))


@query
def product_return_rates(spark, folder):
    rates = metrics.return_rates(typed_lines(spark, folder, country=False))
    return rates.withColumn("return_rate", F.round("return_rate", 9))


@query
def monthly_revenue(spark, folder):
    monthly = metrics.monthly_revenue(typed_lines(spark, folder, country=False))
    return monthly.select(_day("month"), "revenue", "orders")


@query
def weekday_revenue(spark, folder):
    return metrics.weekday_revenue(typed_lines(spark, folder, country=False))


@query
def country_metrics(spark, folder):
    return metrics.country_metrics(typed_lines(spark, folder))


@query
def repeat_rate(spark, folder):
    return metrics.repeat_rate(typed_lines(spark, folder, part=False, country=False))


# Cleaning and pairing


@query
def type_coercion(spark, folder):
    coerced = cleaning.coerce_types(untidy_lines(spark, folder))
    return coerced.select(
        "InvoiceNo", "StockCode", "Description", "Quantity", _minute("InvoiceDate"), "UnitPrice",
        "CustomerID", "Country", ORD,
    )


@query
def cleaned_lines(spark, folder):
    cleaned = cleaning.clean(raw_lines(spark, folder))
    return cleaned.withColumn("InvoiceDate", _minute("InvoiceDate"))


@query
def stage_metrics(spark, folder):
    # Joined once, for the counts of the raw cells and for the cleaning.
    raw = written(untidy_lines(spark, folder), "untidy-lines")
    return cleaning.stage_metrics(raw, cleaning.clean(raw))


def _pairs(paired: DataFrame) -> DataFrame:
    return paired.where("IsReturn").select(
        "InvoiceNo", "StockCode", "Quantity", "UnitPrice", "CustomerID", ORD, "PairedInvoiceNo"
    )


@query
def return_pairs(spark, folder):
    return _pairs(pairing.pair_returns(typed_lines(spark, folder, country=False)))


@query
def return_pairs_in_blocks(spark, folder):
    """The path for large keys, for every key of more than BLOCK_ROWS rows."""
    lines = typed_lines(spark, folder, country=False)
    return _pairs(pairing.pair_returns(lines, hot_rows=BLOCK_ROWS))


@query
def untidy_return_pairs(spark, folder):
    return _pairs(cleaning.clean(untidy_lines(spark, folder)))


@query
def row_numbers(spark, folder):
    lines = table(spark, folder, "events").select("event_id", "ts")
    return with_ordinals(lines, ["ts", "event_id"], name="row").select("event_id", "row")


# Filters and option lists


@query
def filtered_lines(spark, folder):
    kept = filters.filter_lines(
        typed_lines(spark, folder),
        start=FROM_DAY,
        end=TO_DAY,
        countries=["NATION_1", "NATION_2", "NATION_3", ""],
        stock_codes=["POST", "1", "12", "123"],
    )
    return kept.select("InvoiceNo", "StockCode", "Country", _day("InvoiceDate"), "Revenue")


@query
def lines_of_members(spark, folder):
    lines = typed_lines(spark, folder, country=False)
    totals = segments.customer_totals(lines)
    members = totals.where(F.col("frequency") >= 12)
    return filters.filter_lines(lines, segments=members).select("InvoiceNo", "CustomerID", ORD)


@query
def country_options(spark, folder):
    return filters.country_options(typed_lines(spark, folder, part=False))


@query
def stock_code_options(spark, folder):
    return filters.stock_code_options(typed_lines(spark, folder, part=False, country=False))


@query
def date_bounds(spark, folder):
    bounds = filters.date_bounds(typed_lines(spark, folder, part=False, country=False))
    return bounds.select(_day("first_day"), _day("last_day"))


# Segments


@query
def rfm_table(spark, folder):
    rfm = segments.rfm_table(typed_lines(spark, folder, country=False))
    return rfm.withColumn("monetary", F.round("monetary", 2))


@query
def rfm_standardized(spark, folder):
    rfm = segments.rfm_table(typed_lines(spark, folder, country=False))
    scaled = segments.standardize(materialize(rfm))
    axes = [F.round(F.col("scaled")[n], 6).alias(a) for n, a in enumerate(segments.AXES)]
    return scaled.select("CustomerID", *axes)


@query
def rfm_segments(spark, folder):
    found = segments.rfm_segments(typed_lines(spark, folder, country=False)).table
    rounded = {"monetary": F.round("monetary", 2), "stability_score": F.round("stability_score", 9)}
    return found.withColumns(rounded)


@query
def segment_facts(spark, folder):
    """What does not depend on how K-Means labels: customers, holdout, threshold, and consistency."""
    found = segments.rfm_segments(typed_lines(spark, folder, country=False))
    stability = F.struct(
        "stability_score", "stability_holdout_size", "stability_threshold", "stability_flag",
        "stability_reason",
    )
    sizes = found.table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(
        F.min("n").alias("least"), F.sum("n").alias("kept")
    )
    return found.table.agg(
        F.count_distinct(stability).alias("stability_rows"),
        F.max("stability_holdout_size").alias("holdout"),
        F.max("stability_threshold").alias("threshold"),
        F.bool_and(F.abs("stability_score") <= 1).alias("score_in_range"),
    ).withColumns(
        {
            "customers": F.lit(found.details["customers"]).cast("long"),
            "small_clusters_gone": sizes.select(F.col("least") >= 5).scalar(),
            "kept_as_reported": sizes.select(F.col("kept") == found.details["kept_customers"]).scalar(),
        }
    )


@query
def customer_silhouettes(spark, folder):
    """The silhouette of a fixed labelling of the standardized customers."""
    rfm = segments.rfm_table(typed_lines(spark, folder, country=False))
    band = F.when(F.col("recency") < 50, 0).when(F.col("recency") < 150, 1).otherwise(2)
    points = materialize(
        segments.standardize(materialize(rfm))
        .withColumn("features", segments.array_to_vector("scaled"))
        .withColumn("band", band)
    )
    squared = segments.silhouette_squared(points, "band")
    return points.groupBy().agg(F.round(F.lit(squared), 6).alias("silhouette_squared"))


@query
def silhouette_euclidean(spark, folder):
    """The Euclidean silhouette of a fixed labelling of the standardized customers."""
    rfm = segments.rfm_table(typed_lines(spark, folder, country=False))
    band = F.when(F.col("recency") < 50, 0).when(F.col("recency") < 150, 1).otherwise(2)
    points = materialize(segments.standardize(materialize(rfm)).withColumn("band", band))
    found = silhouette.silhouette_euclidean(points, "band")
    return found.select(F.round("silhouette", 4).alias("silhouette"))


@query
def adjusted_rand(spark, folder):
    """Agreement of market segment and region as labelings of the customers."""
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    cells = customers.groupBy("c_mktsegment", "n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    score = segments.rand_index(cells, "c_mktsegment", "n_regionkey")
    return score.select(F.round("adjusted_rand", 9).alias("adjusted_rand"))


# Privacy and access


@query
def pseudonymized_lines(spark, folder):
    lines = typed_lines(spark, folder, part=False, country=False)
    return privacy.pseudonymize_customers(lines, KEY.hex()).select("InvoiceNo", "CustomerID", ORD)


@query
def pseudonymized_customers(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return privacy.pseudonymize_column(
        customers, KEY, "c_custkey", output_column="pseudonym", drop_source=True
    )


def _requests(spark, folder):
    role = F.element_at(
        F.array(*[F.lit(r) for r in ("viewer", "analyst", "admin", "guest")]),
        (F.col("user_id") % 4 + 1).cast("int"),
    )
    views = {"view": "revenue", "click": "products", "purchase": "customers", "signup": "time"}
    view = F.create_map(*[F.lit(x) for pair in views.items() for x in pair])[F.col("event_type")]
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("actor"), role.alias("role"),
        F.coalesce(view, F.lit("ledger")).alias("view"),
    )


@query
def access_decisions(spark, folder):
    return privacy.decide_access(_requests(spark, folder)).drop("ts")


@query
def access_audit_events(spark, folder):
    events = privacy.access_events(privacy.decide_access(_requests(spark, folder)))
    return events.select("event_id", "actor", "action", "outcome", "resource", "details_json")


@query
def viewer_products_view(spark, folder):
    return privacy.scope_view(typed_lines(spark, folder, country=False), "viewer", "products")


@query
def small_groups(spark, folder):
    lines = typed_lines(spark, folder, part=False, country=False)
    return privacy.group_sizes(lines, ["StockCode", "IsReturn"], 7)


@query
def lines_of_large_groups(spark, folder):
    lines = typed_lines(spark, folder, part=False, country=False)
    kept = privacy.suppress_small_groups(lines, ["StockCode", "IsReturn"], 7)
    return kept.select("InvoiceNo", "StockCode", "IsReturn", "CustomerID", ORD)


@query
def suppression_events(spark, folder):
    lines = typed_lines(spark, folder, part=False, country=False)
    sizes = privacy.group_sizes(lines, ["StockCode", "IsReturn"], 7)
    label = F.concat(F.lit("stock_"), F.col("StockCode"))
    return privacy.suppression_events(sizes, label, "viewer", 7)


# Snapshots


def _pseudonymized(spark, folder):
    return privacy.pseudonymize_column(typed_lines(spark, folder), KEY)


@query
def snapshot_round_trip(spark, folder):
    store = scratch_path(spark, "snapshots")
    snapshots.write_snapshot(_pseudonymized(spark, folder), store, KEY, "20260101T000000Z")
    restored = snapshots.read_snapshot(spark, store, KEY)
    return restored.withColumn("InvoiceDate", _minute("InvoiceDate"))


@query
def snapshot_time_view(spark, folder):
    store = scratch_path(spark, "snapshots")
    snapshots.write_snapshot(_pseudonymized(spark, folder), store, KEY, "20260101T000000Z")
    seen = snapshots.read_view(spark, store, KEY, "time", "viewer")
    return seen.withColumn("InvoiceDate", _minute("InvoiceDate"))


@query
def snapshot_list(spark, folder):
    """Two snapshots, sales and returns: ids in order, and what the newest holds."""
    store = scratch_path(spark, "snapshots")
    lines = typed_lines(spark, folder, part=False, country=False)
    snapshots.write_snapshot(lines.where(~F.col("IsReturn")), store, KEY, "20260101T000000Z")
    snapshots.write_snapshot(lines.where("IsReturn"), store, KEY, "20260102T000000Z")
    newest = snapshots.read_snapshot(spark, store, KEY, columns=["InvoiceNo"])
    ids = ",".join(snapshots.list_snapshots(spark, store))
    return newest.agg(F.count(F.lit(1)).alias("lines")).withColumn("ids", F.lit(ids))


@query
def bootstrap_country_metrics(spark, folder):
    """Files to snapshot to metric, all in one. The files go once they are read, so that they are not there beside the snapshot."""
    files, store = scratch_path(spark, "files"), scratch_path(spark, "snapshots")
    with shuffles_deleted(spark):
        for number in range(FILE_SHARES):
            _write_files(raw_lines(spark, folder, share=(number, FILE_SHARES)).drop(ORD), files, "append")
    bootstrap.ensure_snapshot(spark, files, store, KEY, keep_source=False)
    return metrics.country_metrics(snapshots.read_view(spark, store, KEY, "revenue", "viewer"))


# Audit


def _events(spark, folder):
    kind = F.col("event_type")
    actions = {
        "signup": "login_success", "error": "login_failure", "view": "protected_store_read",
        "purchase": "protected_store_write", "click": "audit_log_verified",
    }
    return table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        F.col("user_id").cast("string").alias("actor"),
        F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])[kind].alias("action"),
        F.when(kind == "error", "failure").otherwise("success").alias("outcome"),
        F.nullif(kind, F.lit("click")).alias("resource"),
        F.to_json(F.from_json("props", "k bigint")).alias("details_json"),
    )


def _audit_table(spark, folder):
    events = audit.event_problems(_events(spark, folder)).where("problem is null")
    return audit.append_events(events, ["timestamp", "event_id"], chain_rows=CHAIN_ROWS)


@query
def audit_chain(spark, folder):
    return _audit_table(spark, folder)


@query
def audit_appended(spark, folder):
    """Two batches, the second linked to the last event of the first."""
    events = _events(spark, folder)
    early = F.col("timestamp") < CUTOFF
    order = ["timestamp", "event_id"]
    first = materialize(audit.append_events(events.where(early), order, chain_rows=CHAIN_ROWS))
    second = audit.append_events(events.where(~early), order, first, CHAIN_ROWS)
    return first.unionByName(second).select("id", "chain", "event_hash")


@query
def audit_problems(spark, folder):
    """Tampered fields and removed events are found; each names its row."""
    chained = materialize(_audit_table(spark, folder))
    tampered = chained.withColumn(
        "actor", F.when(F.col("actor") == "7", "8").otherwise(F.col("actor"))
    ).where(~F.col("details_json").isin('{"k":13}'))
    return audit.chain_problems(tampered)


@query
def audit_lost_chain(spark, folder):
    """A chain taken out whole, and the last event of another, are found by the manifest."""
    chained = materialize(_audit_table(spark, folder))
    manifest = materialize(audit.chain_manifest(chained))
    gone = chained.where("chain <> 1 AND id <> 1000")
    return audit.manifest_problems(gone, manifest)


@query
def audit_bad_times(spark, folder):
    """Times of events in several spellings: normalized to UTC, or refused."""
    spelled = F.element_at(
        F.array(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+00:00'"),
        ),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    events = table(spark, folder, "events").select(
        "event_id", spelled.alias("timestamp"), F.lit("a").alias("actor"),
        F.lit("login_success").alias("action"), F.lit("success").alias("outcome"),
    )
    return audit.event_problems(events).select("event_id", "timestamp", "problem")


@query
def audit_seal(spark, folder):
    return audit.chain_seal(materialize(_audit_table(spark, folder)))


@query
def audit_purged(spark, folder):
    kept = audit.purge_before(_audit_table(spark, folder), CUTOFF)
    return kept.select("id", "chain", "previous_hash", "event_hash")


@query
def audit_recent(spark, folder):
    return audit.read_events(_audit_table(spark, folder), limit=500, since=CUTOFF)


@query
def audit_stored(spark, folder):
    """Linked events stored per day in two appends, read back from a day on, and checked."""
    path = scratch_path(spark, "audit")
    chained = materialize(_audit_table(spark, folder))
    audit.store_events(chained.where(F.col("timestamp") < CUTOFF), path)
    audit.store_events(chained.where(F.col("timestamp") >= CUTOFF), path)
    stored = audit.load_events(spark, path)
    audit.verify_events(stored)
    return audit.read_events(stored, since=CUTOFF)


def _stored_log(spark, folder) -> str:
    """A log of three batches, by time; the second is appended again, as after a lost answer."""
    path = scratch_path(spark, "audit")
    events = materialize(_events(spark, folder))
    order, when = ["timestamp", "event_id"], F.col("timestamp")
    parts = {"early": when < MIDDLE, "middle": (when >= MIDDLE) & (when < CUTOFF), "late": when >= CUTOFF}
    for batch, rows in parts.items():
        audit_store.append(events.where(rows), path, batch, order, CHAIN_ROWS)
    audit_store.append(events.where(parts["middle"]), path, "middle", order, CHAIN_ROWS)
    return path


@query
def audit_store_appended(spark, folder):
    """Batches of a stored log, one of them sent twice; checked against its manifest."""
    path = _stored_log(spark, folder)
    audit_store.verify(spark, path)
    return audit_store.load(spark, path).select("id", "chain", "actor", "previous_hash", "event_hash")


@query
def audit_store_purged(spark, folder):
    """The stored log after a purge, read back and checked; what was purged is no longer in any file."""
    path = _stored_log(spark, folder)
    audit_store.purge(spark, path, CUTOFF)
    audit_store.purge(spark, path, CUTOFF)
    audit_store.verify(spark, path)
    on_disk = spark.read.parquet(f"{path}/events").agg(F.min("timestamp").alias("first_on_disk"))
    rows = audit_store.load(spark, path).select("id", "chain", "previous_hash", "event_hash")
    return rows.withColumn("first_on_disk", on_disk.scalar())


@query
def audit_store_manifest(spark, folder):
    """The manifest of the purged log, after one more batch."""
    path = _stored_log(spark, folder)
    audit_store.purge(spark, path, CUTOFF)
    again = _events(spark, folder).where(F.col("timestamp") >= CUTOFF)
    audit_store.append(again, path, "again", ["timestamp", "event_id"], CHAIN_ROWS)
    audit_store.verify(spark, path)
    return audit_store.manifest(spark, path).drop("first_time", "last_time")


def _sealed_log(spark, events):
    """A log of two batches, sealed after each, with passes of two levels: its path and both seals."""
    path, order, early = scratch_path(spark, "audit"), ["timestamp", "event_id"], F.col("timestamp") < CUTOFF
    audit_store.append(events.where(early), path, "early", order, CHAIN_ROWS)
    first = audit_seals.seal(spark, path, span=2)
    audit_store.append(events.where(~early), path, "late", order, CHAIN_ROWS)
    return path, first, audit_seals.seal(spark, path, span=2)


@query
def audit_nodes(spark, folder):
    """Every node over the heads of the closed chains, made in two seals."""
    path, _, _ = _sealed_log(spark, materialize(_events(spark, folder)))
    return audit_seals.nodes(spark, path)


@query
def audit_seals_compared(spark, folder):
    """A seal that was kept, against the log that goes on from it and one whose past was rewritten and sealed anew."""
    events = materialize(_events(spark, folder))
    other = F.when(F.col("actor") == "7", "8").otherwise(F.col("actor"))
    logs = {"kept": events, "rewritten": events.withColumn("actor", other)}
    kept, rows = None, []
    for name, content in logs.items():
        path, first, newest = _sealed_log(spark, content)
        kept = kept or first
        try:
            audit_seals.verify_since(spark, path, kept)
            adds = True
        except AuditIntegrityError:
            adds = False
        rows.append((name, kept.size, kept.root, newest.size, newest.root, adds))
    return spark.createDataFrame(rows, "log string, kept_size long, kept_root string, size long, root string, adds boolean")


@query
def audit_of_operators(spark, folder):
    """What operators put into the log by themselves: writes, reads and refusals of a store, small groups, segments."""
    path, store = scratch_path(spark, "audit"), scratch_path(spark, "snapshots")
    lines = materialize(typed_lines(spark, folder, country=False))
    pipeline, viewer = audit_store.AuditSink(spark, path), audit_store.AuditSink(spark, path, "alice", "viewer")
    sold = privacy.pseudonymize_column(lines, KEY)
    snapshots.write_snapshot(sold, store, KEY, "20260101T000000Z", sink=pipeline)
    snapshots.read_view(spark, store, KEY, "time", "viewer", sink=viewer)
    try:
        snapshots.read_view(spark, store, KEY, "customers", "viewer", sink=viewer)
    except StorageError:
        pass  # the refusal is what goes on record
    privacy.suppress_small_groups(lines, ["StockCode", "IsReturn"], 7, sink=viewer)
    segments.rfm_segments(lines, threshold=200, sink=pipeline)
    pipeline.verify()
    stored = audit_store.load(spark, path)
    # Figures of the segments have queries of their own.
    details = F.when(F.col("resource") == "rfm_segments", F.get_json_object("details_json", "$.customers"))
    return stored.select("id", "actor", "action", "outcome", "resource", F.coalesce(details, "details_json").alias("details"))


@query
def metric_use_event(spark, folder):
    result = metrics.repeat_rate(typed_lines(spark, folder, part=False, country=False))
    return audit.metric_events(result, "repeat_rate")


# Files


def _write_files(raw: DataFrame, folder: str, mode: str = "error", **partition) -> None:
    writer = raw.write.mode(mode).option("header", True).option("escape", '"')
    if partition:
        writer = writer.partitionBy(partition["by"])
    writer.csv(folder)


@query
def ingested_files(spark, folder):
    files = scratch_path(spark, "files")
    _write_files(raw_lines(spark, folder).drop(ORD), files)
    return intake.ingest(spark, files).select(*RAW_COLUMNS)


@query
def capped_files(spark, folder):
    """Data rows of files with line breaks in cells, counted without parsing, and the row cap one below and at their sum."""
    files = scratch_path(spark, "files")
    broken = F.when(F.col("Country") < "NATION_2", F.replace("Description", F.lit(" "), F.lit("\n"))).otherwise(F.col("Description"))
    lines = raw_lines(spark, folder).drop(ORD).withColumns({"Description": broken, "home": F.col("Country")})
    _write_files(lines, files, by="home")
    rows = materialize(intake.data_rows(spark, files, intake.inspect_files(spark, files)))
    total = rows.agg(F.sum("rows")).first()[0]
    verdicts = {}
    for name, cap in {"below": total - 1, "at": total}.items():
        try:
            intake.check_row_cap(rows, cap)
            verdicts[name] = F.lit("accepted")
        except FileTooLargeError:
            verdicts[name] = F.lit("too_large")
    place = F.regexp_extract("file", r"/home=([^/]+)/", 1).alias("place")
    return rows.groupBy(place).agg(F.sum("rows").alias("rows")).withColumns(verdicts)


@query
def file_verdicts(spark, folder):
    """Line files per country, plus tables that are no line files at all."""
    files = scratch_path(spark, "files")
    lines = raw_lines(spark, folder).drop(ORD).withColumn("home", F.col("Country"))
    _write_files(lines, f"{files}/lines", by="home")
    _write_files(table(spark, folder, "nation"), f"{files}/nation")
    table(spark, folder, "part").write.parquet(f"{files}/part")
    report = intake.inspect_files(spark, files)
    place = F.regexp_extract("file", r"/(home=[^/]+|nation|part)/", 1)
    return report.select(
        place.alias("place"), F.coalesce("problem", F.lit("accepted")).alias("verdict"), "encoding"
    ).distinct()


# Headers of the files of header_verdicts, by the number in the country's name.
HEADERS = [
    ",".join(RAW_COLUMNS),
    ",".join(f'"{name}"' for name in reversed(RAW_COLUMNS)),
    ",".join([RAW_COLUMNS[0], "", *RAW_COLUMNS[1:]]),
    ",".join([*RAW_COLUMNS, ""]),
    ",".join([*RAW_COLUMNS[:-1], RAW_COLUMNS[0]]),
    ",".join([*RAW_COLUMNS, *["Extra"] * 40]),
]


@query
def header_verdicts(spark, folder):
    """Line files per country, each with one of the headers, and a file of zero bytes."""
    files = scratch_path(spark, "files")
    lines = raw_lines(spark, folder)
    number = F.regexp_extract("Country", "([0-9]+)$", 1).cast("int") % len(HEADERS)
    header = F.element_at(F.array(*[F.lit(text) for text in HEADERS]), number + 1)
    rows = lines.select("Country", ORD, F.to_csv(F.struct(*RAW_COLUMNS)).alias("value"))
    heads = rows.select("Country").distinct().select("Country", F.lit("").alias(ORD), header.alias("value"))
    placed = heads.unionByName(rows).repartition("Country").sortWithinPartitions("Country", ORD)
    plain = {"sep": "\x01", "quote": "\x00", "escape": "\x00", "escapeQuotes": "false"}
    placed.select("Country", "value").write.partitionBy("Country").options(**plain).csv(f"{files}/lines")
    rows.limit(0).select("value").coalesce(1).write.csv(f"{files}/none")
    report = intake.inspect_files(spark, files)
    place = F.regexp_extract("file", r"/(Country=[^/]+|none)/", 1)
    return report.select(
        place.alias("place"), F.coalesce("problem", F.lit("accepted")).alias("verdict")
    ).distinct()


@query
def formula_issues(spark, folder):
    untidy = untidy_lines(spark, folder)
    return intake.formula_issues(untidy, row_columns=(ORD,)).select(
        ORD, "position", "column", "code", "severity"
    )


@query
def quality_report(spark, folder):
    return intake.quality_report(untidy_lines(spark, folder))


@query
def streamed_lines(spark, folder):
    """Row-local cleaning over a stream of the line files, compared as a table."""
    files, target = scratch_path(spark, "files"), scratch_path(spark, "stream")
    _write_files(raw_lines(spark, folder).drop(ORD), files)
    raw = continuous.stream_raw_lines(spark, files)
    continuous.stream_clean_lines(raw, target, scratch_path(spark, "stream-state")).awaitTermination()
    lines = spark.read.parquet(target)
    return lines.select("InvoiceNo", "StockCode", "Quantity", "CustomerID", "Revenue", "IsReturn")


# Charts


def _chart(spark, folder, analysis):
    lines = typed_lines(spark, folder, guests=analysis == "repeat_rate")
    return dashboard.run_analysis(analysis, lines)


@query
def chart_month(spark, folder):
    return _chart(spark, folder, "revenue_by_month").data.select(
        _day("month"), "revenue", "orders"
    )


@query
def chart_weekday(spark, folder):
    return _chart(spark, folder, "revenue_by_weekday").data


@query
def chart_products(spark, folder):
    data = _chart(spark, folder, "top_products").data
    return data.withColumn("Revenue", F.round("Revenue", 2))


@query
def chart_countries(spark, folder):
    return _chart(spark, folder, "country_revenue").data


@query
def chart_repeat_rate(spark, folder):
    return _chart(spark, folder, "repeat_rate").data


@query
def chart_explanations(spark, folder):
    """The explanation rows of the five metric charts, which all read the lines joined once."""
    lines = written(typed_lines(spark, folder, guests=True).drop("UnitPrice"), "chart-lines")
    known = cleaning.drop_unidentified(lines)
    parts = [
        dashboard.run_analysis(analysis, lines if analysis == "repeat_rate" else known).explanation
        for analysis in (
            "revenue_by_month", "revenue_by_weekday", "top_products", "country_revenue",
            "repeat_rate",
        )
    ]
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.select("kind", "exclusions", "row_count")


@query
def chart_segments(spark, folder):
    return _chart(spark, folder, "customer_segments").explanation


@query
def dashboard_request(spark, folder):
    """A viewer's request: revenue view, one country and period, country chart."""
    chart = dashboard.answer(
        typed_lines(spark, folder), "viewer", "revenue", "country_revenue",
        start=FROM_DAY, end=TO_DAY, countries=["NATION_1", "NATION_4"],
    )
    return chart.data

