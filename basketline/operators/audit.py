"""Append-only audit table with hash chains.

An event's hash covers its fields and the hash of the event before it. That is sequential by
nature, so the log is cut into chains of a bounded number of consecutive ids; chains are built
in parallel, and one digest over all chain heads shows whether a whole chain went missing. A log
that fits in one chain is linked from its first to its last event.
"""

import datetime
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basketline import schema
from basketline.errors import AuditIntegrityError
from basketline.functions.crypto import canonical_json
from basketline.operators.ordinals import with_ordinals

CHAIN_ROWS = 100_000
_SEPARATOR = "\0"
FIELDS = ["timestamp", "actor", "action", "outcome", "resource", "details_json"]
_TABLE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("chain", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in FIELDS],
        T.StructField("previous_hash", T.StringType()),
        T.StructField("event_hash", T.StringType()),
    ]
)


def utc_text(instant: Column) -> Column:
    """ISO-8601 UTC text to the second of a timestamp column."""
    shifted = F.to_utc_timestamp(instant, F.current_timezone())
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def utc_time(text: str) -> str:
    """A time with an offset, as UTC text to the second; a time without one is refused."""
    moment = datetime.datetime.fromisoformat(text)
    if moment.tzinfo is None:
        raise ValueError(f"{text!r} has no time zone")
    return moment.astimezone(datetime.timezone.utc).isoformat(timespec="seconds")


def normalized_time(text: Column) -> Column:
    """ISO-8601 text with an offset as UTC text to the second; null for any other text."""
    stamp = F.when(
        text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"),
        F.try_to_timestamp(text),
    )
    return utc_text(stamp)


def event_problems(events: DataFrame) -> DataFrame:
    """Normalize `timestamp` to UTC; add `problem`: null for a valid event, else what is wrong."""
    events = events.withColumn("timestamp", normalized_time(F.col("timestamp")))
    return events.withColumn(
        "problem",
        F.when(F.coalesce(F.col("actor"), F.lit("")) == "", "empty actor")
        .when(~F.coalesce(F.col("action").isin(*schema.AUDIT_ACTIONS), F.lit(False)), "bad action")
        .when(
            ~F.coalesce(F.col("outcome").isin(*schema.AUDIT_OUTCOMES), F.lit(False)), "bad outcome"
        )
        .when(F.col("timestamp").isNull(), "no time zone or no time"),
    )


def metric_events(result: DataFrame, resource: str, actor: str = "pipeline", role: str = "pipeline"):
    """One read event per row of a metric result, with its scalar columns as details."""
    details = {name: F.col(name) for name in result.columns}
    return result.select(
        F.lit(actor).alias("actor"),
        F.lit("protected_store_read").alias("action"),
        F.lit("success").alias("outcome"),
        F.lit(resource).alias("resource"),
        canonical_json({**details, "actor_role": F.lit(role)}).alias("details_json"),
    )


def event_row(
    spark: SparkSession,
    action: str,
    resource: str | None,
    details: dict[str, object],
    outcome: str = "success",
    actor: str = "pipeline",
    role: str = "pipeline",
) -> DataFrame:
    """One event of now, for a single call such as a snapshot write or an access decision."""
    values = {name: F.lit(value) for name, value in {"actor_role": role, **details}.items()}
    return spark.range(1).select(
        utc_text(F.current_timestamp()).alias("timestamp"),
        F.lit(actor).alias("actor"),
        F.lit(action).alias("action"),
        F.lit(outcome).alias("outcome"),
        F.lit(resource).cast("string").alias("resource"),
        canonical_json(values).alias("details_json"),
    )


def stamped(events: DataFrame) -> DataFrame:
    """Add the time of now to events that have none."""
    return events.withColumn("timestamp", utc_text(F.current_timestamp()))


def store_events(rows: DataFrame, path: str) -> None:
    """Append linked events to the audit table, one folder per day."""
    day = F.substring("timestamp", 1, 10)
    rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """The audit table, with its `day` column for pruning."""
    fields = T.StructType([*_TABLE.fields, T.StructField("day", T.StringType())])
    return spark.read.schema(fields).parquet(path)


def _payload() -> Column:
    fields = [F.coalesce(F.col(name), F.lit("")) for name in FIELDS]
    return F.concat_ws(_SEPARATOR, *fields)


def event_hash(previous: Column) -> Column:
    """Hash of an event row given the hash before it."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit(_SEPARATOR), _payload()), 256)


def link_chains(numbered: DataFrame, head: tuple[int, str] | None = None) -> DataFrame:
    """Fill previous_hash and event_hash within every chain, in id order.

    A task sees one chain, at most CHAIN_ROWS events; `head` is the (chain, hash) to continue.
    """
    start_chain, start_hash = head or (None, None)

    def link(events: pa.Table) -> pa.Table:
        events = events.sort_by("id")
        previous = start_hash if events.column("chain")[0].as_py() == start_chain else None
        links, hashes = [], []
        for payload in events.column("payload").to_pylist():
            links.append(previous)
            text = (previous or "") + _SEPARATOR + payload
            previous = hashlib.sha256(text.encode("utf-8")).hexdigest()
            hashes.append(previous)
        # Only the payload becomes Python values; the other columns pass through as they are.
        events = events.append_column("previous_hash", pa.array(links, pa.string()))
        return events.append_column("event_hash", pa.array(hashes, pa.string())).select(_TABLE.names)

    rows = numbered.select("id", "chain", *FIELDS, _payload().alias("payload"))
    return rows.groupBy("chain").applyInArrow(link, _TABLE)


def append_events(
    events: DataFrame,
    order_by: list[str],
    table: DataFrame | None = None,
    chain_rows: int = CHAIN_ROWS,
) -> DataFrame:
    """Number valid events in order, after those of `table`, and link them. Returns new rows."""
    last_id, head = 0, None
    if table is not None:
        last = table.agg(
            F.max(F.struct("id", "chain", "event_hash")).alias("last")
        ).first()["last"]
        if last is not None:
            last_id, head = last["id"], (last["chain"], last["event_hash"])
    return continue_chains(events, order_by, last_id, head, chain_rows)


def continue_chains(
    events: DataFrame,
    order_by: list[str],
    last_id: int,
    head: tuple[int, str] | None,
    chain_rows: int = CHAIN_ROWS,
) -> DataFrame:
    """Number valid events in order after last_id, and link them to the head (its chain and hash)."""
    numbered = with_ordinals(events, order_by, start=last_id + 1)
    chain = F.floor((F.col("id") - 1) / F.lit(chain_rows)).cast("bigint")
    return link_chains(numbered.withColumn("chain", chain), head)


def read_events(table: DataFrame, limit: int | None = None, since: str | None = None) -> DataFrame:
    """Events by id, optionally from a time on (inclusive), and only the first `limit` of them."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    since = None if since is None else utc_time(since)
    kept = table if since is None else table.where(F.col("timestamp") >= since)
    if since is not None and "day" in table.columns:
        kept = kept.where(F.col("day") >= since[:10])
    ordered = kept.select("id", *FIELDS).orderBy("id")
    return ordered if limit is None else ordered.limit(limit)


def chain_problems(table: DataFrame) -> DataFrame:
    """Rows that break their chain: (id, problem). Every row is checked on its own.

    Recomputing uses the stored previous hash, so only the link test needs a window, and that
    window is bounded by the chain length.
    """
    before = F.lag("event_hash").over(Window.partitionBy("chain").orderBy("id"))
    return (
        table.withColumn("expected", before)
        .select(
            "id",
            F.when(~F.col("previous_hash").eqNullSafe(F.col("expected")), "previous_hash mismatch")
            .when(event_hash(F.col("previous_hash")) != F.col("event_hash"), "event_hash mismatch")
            .alias("problem"),
        )
        .where(F.col("problem").isNotNull())
    )


def manifest_columns() -> list[Column]:
    """Aggregates over the events of a chain: first and last id, rows, and the hash of its last event."""
    return [
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.count(F.lit(1)).alias("rows"),
        F.max(F.struct("id", "event_hash"))["event_hash"].alias("head"),
    ]


def chain_manifest(table: DataFrame) -> DataFrame:
    """One row per chain: first and last id, rows, and the hash of its last event.

    Kept apart from the log, it shows chains that are gone or cut short, which hashes inside the
    log cannot show.
    """
    return table.groupBy("chain").agg(*manifest_columns())


def manifest_problems(table: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chains that differ from their manifest row: (id of the manifest's first event, problem)."""
    found = chain_manifest(table).select("chain", F.struct("first_id", "last_id", "rows", "head").alias("found"))
    kept = manifest.select("chain", F.struct("first_id", "last_id", "rows", "head").alias("kept"))
    both = found.join(kept, "chain", "full")
    problem = (
        F.when(F.col("found").isNull(), "chain is missing")
        .when(F.col("kept").isNull(), "chain is not in the manifest")
        .when(F.col("found") != F.col("kept"), "chain differs from the manifest")
    )
    first = F.coalesce("kept.first_id", "found.first_id")
    return both.select(first.alias("id"), problem.alias("problem")).where("problem IS NOT NULL")


def verify_events(table: DataFrame, manifest: DataFrame | None = None) -> None:
    """Raise, naming the first broken event or, with a manifest, the first event of a broken chain."""
    problems = chain_problems(table)
    if manifest is not None:
        problems = problems.unionByName(manifest_problems(table, manifest))
    first = problems.agg(F.min(F.struct("id", "problem")).alias("first")).first()
    if first["first"] is not None:
        found = first["first"]
        raise AuditIntegrityError(f"audit event id={found['id']}: {found['problem']}")


def chain_seal(table: DataFrame, fan_in: int = 10_000) -> DataFrame:
    """One row: a digest over the last hash of every chain.

    Heads are hashed in groups of fan_in consecutive chains, group by group, until one is left.
    """
    heads = table.groupBy("chain").agg(F.max(F.struct("id", "event_hash"))["event_hash"].alias("h"))
    top = table.agg(F.max("chain")).first()[0] or 0
    while True:
        heads = heads.groupBy(F.floor(F.col("chain") / fan_in).cast("bigint").alias("chain")).agg(
            F.sha2(
                F.concat_ws(_SEPARATOR, F.sort_array(F.collect_list(F.struct("chain", "h")))["h"]),
                256,
            ).alias("h")
        )
        top //= fan_in
        if top == 0:
            return heads.select(F.col("h").alias("seal"))


def purge_before(table: DataFrame, cutoff: str) -> DataFrame:
    """Drop events before a time; ids and chains stay. Only chains across the cutoff are linked anew."""
    kept = F.col("timestamp") >= utc_time(cutoff)
    cut = table.groupBy("chain").agg(F.bool_and(kept).alias("whole"))
    left = table.where(kept).join(cut, "chain")
    relinked = link_chains(left.where("NOT whole"))
    return left.where("whole").select(*_TABLE.names).unionByName(relinked.select(*_TABLE.names))
