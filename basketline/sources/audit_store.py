"""The stored audit log: batches that are appended once, purged in place, and checked by a manifest.

A batch has three folders: `events`, its linked events by day; `chains`, what it adds to each chain; and, written
last, `commits`, one row with its number and the head that the next batch goes on from. What has no commit is not
there: an append that failed leaves no rows, and the next attempt writes over them. A batch that has a commit is not
appended again. There is one writer at a time.

A purge is a batch too. It holds the kept events of the days that it cuts into, those of chains across the cutoff
linked anew; its commit hides these days, and all before, in earlier batches. Hidden days are deleted afterwards.
"""

import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from basketline.errors import AuditIntegrityError
from basketline.functions.crypto import canonical_json
from basketline.operators import audit
from basketline.session import written

_EVENTS = f"id long, chain long, {', '.join(f'{name} string' for name in audit.FIELDS)}, previous_hash string, event_hash string, batch string, day string"
_CHAINS = "chain long, first_id long, last_id long, rows long, head string, first_time string, last_time string, whole boolean, batch string"
_COMMITS = "seq long, kind string, last_id long, last_chain long, head string, cut_day string, days array<string>, batch string"


def _read(spark: SparkSession, path: str, part: str, fields: str) -> DataFrame:
    try:
        return spark.read.schema(fields).parquet(f"{path}/{part}")
    except AnalysisException:
        return spark.createDataFrame([], fields)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch."""
    return _read(spark, path, "commits", _COMMITS)


def _committed(spark: SparkSession, path: str, batch: str) -> bool:
    return bool(commits(spark, path).where(F.col("batch") == batch).head(1))


def _last(spark: SparkSession, path: str) -> Row:
    row = F.struct("seq", "last_id", "last_chain", "head")
    found = commits(spark, path).agg(F.max(row).alias("last")).first()["last"]
    return found or Row(seq=0, last_id=0, last_chain=None, head=None)


def _chain_rows(rows: DataFrame, whole: bool) -> DataFrame:
    """What some events are of their chains; whole: they are all that is left of them."""
    times = F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")
    return rows.groupBy("chain").agg(*audit.manifest_columns(), *times).withColumn("whole", F.lit(whole))


def _commit(spark: SparkSession, path: str, batch: str, last: Row, kind: str, head: Row, cut_day: str | None = None, days: list[str] | None = None) -> None:
    row = (last["seq"] + 1, kind, head["last_id"], head["last_chain"], head["head"], cut_day, days)
    fields = _COMMITS.removesuffix(", batch string")
    frame = spark.createDataFrame([row], fields).coalesce(1)
    frame.write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")


def append(events: DataFrame, path: str, batch: str, order_by: list[str], chain_rows: int = audit.CHAIN_ROWS) -> bool:
    """Append events as a batch, unless a batch of that name has been; says whether it did.

    Events with a wrong actor, action, outcome or time refuse the whole batch.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"{batch!r} cannot name a batch")
    spark = events.sparkSession
    if _committed(spark, path, batch):
        return False
    # Checked once; the refusal and the numbering, which reads its rows twice, read the copy.
    checked = written(audit.event_problems(events), "checked-events")
    bad = checked.where("problem IS NOT NULL").agg(F.min("problem")).first()[0]
    if bad is not None:
        raise ValueError(f"event with {bad}")
    last = _last(spark, path)
    head = None if last["head"] is None else (last["last_chain"], last["head"])
    linked = audit.continue_chains(checked.drop("problem"), order_by, last["last_id"], head, chain_rows)
    target = f"{path}/events/batch={batch}"
    linked.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("overwrite").partitionBy("day").parquet(target)
    rows = spark.read.schema(_EVENTS).parquet(target).drop("batch", "day")
    _chain_rows(rows, False).write.mode("overwrite").parquet(f"{path}/chains/batch={batch}")
    chains = spark.read.schema(_CHAINS).parquet(f"{path}/chains/batch={batch}")
    end = chains.agg(F.max(F.struct("last_id", "chain", "head")).alias("end")).first()["end"]
    if end is not None:
        last_row = Row(last_id=end["last_id"], last_chain=end["chain"], head=end["head"])
    else:
        last_row = last
    _commit(spark, path, batch, last, "append", last_row)
    return True


def load(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """The events that are there, with their day; without: a batch whose files are not even looked at."""
    done = commits(spark, path)
    rows = _read(spark, path, "events", _EVENTS).where(F.lit(without).isNull() | (F.col("batch") != F.lit(without)))
    rows = rows.join(done.select("batch", "seq"), "batch")
    for purge in done.where("kind = 'purge'").collect():  # a row per purge
        hidden = (F.col("day") < purge["cut_day"]) | F.col("day").isin(*purge["days"])
        rows = rows.where(~((F.col("seq") < purge["seq"]) & hidden))
    return rows.drop("batch", "seq")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per chain: first and last id, rows, the hash of its last event, and its first and last time.

    Of batches before the last that had all of a chain nothing counts.
    """
    rows = _read(spark, path, "chains", _CHAINS).join(commits(spark, path).select("batch", "seq"), "batch")
    reset = rows.where("whole").groupBy("chain").agg(F.max("seq").alias("reset"))
    rows = rows.join(reset, "chain", "left").where("seq >= coalesce(reset, 0) AND rows > 0")
    return rows.groupBy("chain").agg(
        F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"),
        F.sum("rows").alias("rows"),
        F.max(F.struct("last_id", "head"))["head"].alias("head"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


def verify(spark: SparkSession, path: str) -> None:
    """Raise, naming the first broken event, or the first event of a chain that differs from the manifest."""
    kept = manifest(spark, path).drop("first_time", "last_time")
    audit.verify_events(load(spark, path), kept)


def purge(spark: SparkSession, path: str, cutoff: str) -> bool:
    """Delete events before a time; says whether there was anything to do.

    Ids and chains stay. Only the cut day and the days of chains across the cutoff are written again. A purge that
    failed is done again from the start, or from the deletion of what it had hidden.
    """
    cutoff = audit.utc_time(cutoff)
    batch = "purge-" + re.sub(r"[^0-9]", "", cutoff[:19])
    if _committed(spark, path, batch):
        _delete_hidden(spark, path)
        return False
    known = manifest(spark, path)
    gone = known.where(F.col("last_time") < cutoff)
    cut = known.where((F.col("first_time") < cutoff) & (F.col("last_time") >= cutoff)).select("chain")
    if not gone.head(1) and not cut.head(1):
        return False
    last = _last(spark, path)
    rows = load(spark, path, batch).where((F.col("day") >= cutoff[:10]) & (F.col("timestamp") >= cutoff))
    touched = rows.join(F.broadcast(cut), "chain", "left_semi") if cut.count() < 1000 else rows.join(cut, "chain", "left_semi")
    days = sorted({cutoff[:10], *(r["day"] for r in touched.select("day").distinct().collect())})  # a row per day
    affected = rows.where(F.col("day").isin(*days))
    anew = audit.link_chains(affected.join(cut, "chain", "left_semi"))
    kept = affected.join(cut, "chain", "left_anti").select(anew.columns).unionByName(anew)
    target = f"{path}/events/batch={batch}"
    kept.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("overwrite").partitionBy("day").parquet(target)

    new = spark.read.schema(_EVENTS).parquet(target).drop("batch", "day").join(cut, "chain", "left_semi")
    nothing = gone.select("chain", "first_id", "last_id", F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("head"), "first_time", "last_time", F.lit(True).alias("whole"))
    chains = _chain_rows(new, True).unionByName(nothing)
    chains.write.mode("overwrite").parquet(f"{path}/chains/batch={batch}")
    # The next batch goes on from the last chain as it is now, if there is anything left of it.
    of_last = F.col("chain") == F.lit(last["last_chain"])
    renewed = spark.read.schema(_CHAINS).parquet(f"{path}/chains/batch={batch}").where(of_last).first()
    head = Row(last_id=last["last_id"], last_chain=last["last_chain"], head=renewed["head"] if renewed else last["head"])
    _commit(spark, path, batch, last, "purge", head, cutoff[:10], days)
    _delete_hidden(spark, path)
    return True


def _delete_hidden(spark: SparkSession, path: str) -> None:
    """Delete the folders of days that purges have hidden."""
    jvm = spark.sparkContext._jvm
    folders = jvm.org.apache.hadoop.fs.Path(f"{path}/events/batch=*/day=*")
    system = folders.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = {r["batch"]: r["seq"] for r in commits(spark, path).select("batch", "seq").collect()}
    purges = commits(spark, path).where("kind = 'purge'").collect()
    for status in system.globStatus(folders):
        folder = status.getPath()
        day, batch = folder.getName().removeprefix("day="), folder.getParent().getName().removeprefix("batch=")
        if batch in numbers and any(numbers[batch] < p["seq"] and (day < p["cut_day"] or day in p["days"]) for p in purges):
            system.delete(folder, True)


@dataclass(frozen=True)
class AuditSink:
    """Where operators put their events, and who they act for."""

    spark: SparkSession
    path: str
    actor: str = "pipeline"
    role: str = "pipeline"

    def put(self, events: DataFrame) -> None:
        """Append events (action, outcome, resource, details_json) of now in a commit of their own."""
        whole = audit.stamped(events).withColumn("actor", F.lit(self.actor))
        order = ["timestamp", "action", "resource", "details_json"]
        append(whole, self.path, f"call-{uuid.uuid4().hex}", order)

    def put_one(self, action: str, resource: str, details: dict[str, object], outcome: str = "success") -> None:
        """Append one event of now."""
        values = {name: F.lit(value) for name, value in {"actor_role": self.role, **details}.items()}
        row = self.spark.range(1).select(
            F.lit(action).alias("action"), F.lit(outcome).alias("outcome"), F.lit(resource).alias("resource"), canonical_json(values).alias("details_json")
        )
        self.put(row)

    def verify(self) -> None:
        """Check the whole log, and put that on record, either way."""
        try:
            verify(self.spark, self.path)
        except AuditIntegrityError as problem:
            self.put_one("audit_log_verified", "audit", {"problem": str(problem)}, "failure")
            raise
        self.put_one("audit_log_verified", "audit", {})
