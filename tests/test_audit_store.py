import datetime

import pytest
from pyspark.sql import functions as F

from basketline.errors import AuditIntegrityError, StorageError
from basketline.operators import audit, privacy, segments
from basketline.sources import audit_store, snapshots
from tests.frames import CLEAN, line

KEY = bytes(32)
ORDER = ["timestamp", "resource"]


def events(spark, first, last, hour=0):
    """Events of days first to last of a month, four a day."""
    rows = [
        (f"2024-03-{day:02}T{hour + part:02}:00:00+00:00", "ann", "login_success", "success", f"r{day:02}{part}", "{}")
        for day in range(first, last + 1)
        for part in range(4)
    ]
    return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in audit.FIELDS))


@pytest.fixture
def log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    audit_store.append(events(spark, 1, 3), path, "one", ORDER, 10)
    audit_store.append(events(spark, 4, 6), path, "two", ORDER, 10)
    return path


def ids(spark, path):
    return [r["id"] for r in audit_store.load(spark, path).orderBy("id").collect()]


def test_a_batch_is_there_once(spark, log):
    assert ids(spark, log) == list(range(1, 25))
    assert audit_store.append(events(spark, 4, 6), log, "two", ORDER, 10) is False
    assert ids(spark, log) == list(range(1, 25))
    audit_store.verify(spark, log)
    whole = audit.append_events(events(spark, 1, 6), ORDER, chain_rows=10).orderBy("id").collect()
    stored = audit_store.load(spark, log).orderBy("id").collect()
    assert [r["event_hash"] for r in stored] == [r["event_hash"] for r in whole]
    # The head is in the commit, so nothing reads the log to go on from it.
    assert audit_store._last(spark, log)["head"] == whole[-1]["event_hash"]


def test_an_append_that_failed_leaves_nothing(spark, log, monkeypatch):
    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(audit_store, "_commit", broken)
        with pytest.raises(RuntimeError):
            audit_store.append(events(spark, 7, 9), log, "three", ORDER, 10)
    assert ids(spark, log) == list(range(1, 25))
    audit_store.verify(spark, log)
    # The same batch with other events: what the first attempt wrote is gone.
    assert audit_store.append(events(spark, 7, 7), log, "three", ORDER, 10)
    assert ids(spark, log) == list(range(1, 29))
    audit_store.verify(spark, log)


def test_odd_batches(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert audit_store.load(spark, path).count() == 0
    assert audit_store.manifest(spark, path).count() == 0
    assert audit_store.purge(spark, path, "2024-03-02T00:00:00+00:00") is False
    assert audit_store.append(events(spark, 1, 1).limit(0), path, "7", ORDER)
    assert audit_store.append(events(spark, 1, 1), path, "8", ORDER)
    assert ids(spark, path) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="cannot name"):
        audit_store.append(events(spark, 1, 1), path, "a/b", ORDER)
    with pytest.raises(ValueError, match="bad action"):
        audit_store.append(events(spark, 1, 1).withColumn("action", F.lit("other")), path, "9", ORDER)
    assert ids(spark, path) == [1, 2, 3, 4]


@pytest.mark.parametrize("cutoff, first", [("2024-03-03T02:00:00+00:00", 11), ("2024-03-05T04:00:00+02:00", 19), ("2024-04-01T00:00:00+00:00", None)])
def test_purge(spark, log, cutoff, first):
    before = {r["id"]: r for r in audit_store.load(spark, log).collect()}
    assert audit_store.purge(spark, log, cutoff)
    left = audit_store.load(spark, log).orderBy("id").collect()
    assert [r["id"] for r in left] == ([] if first is None else list(range(first, 25)))
    audit_store.verify(spark, log)
    # What went is in no file, and chains that were not cut have their hashes.
    on_disk = spark.read.parquet(f"{log}/events").agg(F.min("timestamp")).first()[0] if left else None
    assert on_disk is None or on_disk >= audit.utc_time(cutoff)
    cut = min((r["chain"] for r in left), default=None)
    assert all(r["event_hash"] == before[r["id"]]["event_hash"] for r in left if r["chain"] != cut)
    assert audit_store.purge(spark, log, cutoff) is False
    assert audit_store.append(events(spark, 7, 7), log, "three", ORDER, 10)
    assert [r["id"] for r in audit_store.load(spark, log).orderBy("id").collect()][-4:] == [25, 26, 27, 28]
    audit_store.verify(spark, log)


def test_a_purge_that_failed_is_done_again(spark, log, monkeypatch):
    cutoff = "2024-03-03T02:00:00+00:00"

    def broken(*_, **__):
        raise RuntimeError("lost")

    for name in ("_commit", "_delete_hidden"):
        with monkeypatch.context() as patch:
            patch.setattr(audit_store, name, broken)
            with pytest.raises(RuntimeError):
                audit_store.purge(spark, log, cutoff)
        audit_store.verify(spark, log)
        assert ids(spark, log) == list(range(1 if name == "_commit" else 11, 25))
    audit_store.purge(spark, log, cutoff)
    assert spark.read.parquet(f"{log}/events").agg(F.min("timestamp")).first()[0] >= cutoff
    # A second purge cuts what the first one left.
    assert audit_store.purge(spark, log, "2024-03-04T01:00:00+00:00")
    assert ids(spark, log) == list(range(14, 25))
    audit_store.verify(spark, log)


def test_changed_events_are_found(spark, log):
    rows = audit_store.load(spark, log).where("day = '2024-03-05'").drop("day").collect()
    frame = spark.createDataFrame(rows, audit._TABLE).withColumn("actor", F.lit("eve"))
    frame.write.mode("overwrite").parquet(f"{log}/events/batch=two/day=2024-03-05")
    with pytest.raises(AuditIntegrityError, match="id=17"):
        audit_store.verify(spark, log)
    sink = audit_store.AuditSink(spark, log)
    with pytest.raises(AuditIntegrityError):
        sink.verify()
    last = audit_store.load(spark, log).orderBy(F.desc("id")).first()
    assert (last["action"], last["outcome"]) == ("audit_log_verified", "failure")


def test_operators_put_their_events(spark, tmp_path):
    path, store = f"file://{tmp_path}/log", f"{tmp_path}/store"
    when = datetime.datetime(2024, 5, 1)
    lines = spark.createDataFrame([line(f"{i}", f"c{i}", when, 1, 2.0) for i in range(4)], CLEAN)
    pipeline, bob = audit_store.AuditSink(spark, path), audit_store.AuditSink(spark, path, "bob", "analyst")
    alice = audit_store.AuditSink(spark, path, "alice", "viewer")
    snapshots.write_snapshot(lines, store, KEY, "20260101T000000Z", sink=pipeline)
    snapshots.read_view(spark, store, KEY, "customers", "analyst", sink=bob)
    with pytest.raises(StorageError):
        snapshots.read_view(spark, store, KEY, "customers", "viewer", sink=alice)
    privacy.suppress_small_groups(lines, ["Country"], 5, sink=alice)
    segments.rfm_segments(lines, sink=pipeline)
    pipeline.put(audit.metric_events(spark.range(1).select(F.lit(4).alias("customers")), "repeat_rate").drop("actor"))
    pipeline.verify()
    stored = audit_store.load(spark, path).orderBy("id").collect()
    assert [(r["actor"], r["action"], r["outcome"], r["resource"]) for r in stored] == [
        ("pipeline", "protected_store_write", "success", "20260101T000000Z"),
        ("bob", "protected_store_read", "success", "customers"),
        ("alice", "access_denied", "failure", "customers"),
        ("alice", "access_denied", "failure", lines.first()["Country"]),
        ("pipeline", "protected_store_read", "success", "rfm_segments"),
        ("pipeline", "protected_store_read", "success", "repeat_rate"),
        ("pipeline", "audit_log_verified", "success", "audit"),
    ]
    assert '"rows":4' in stored[0]["details_json"] and '"suppressed_reason":"too_few_customers"' in stored[4]["details_json"]
    audit_store.verify(spark, path)


def test_an_append_computes_its_events_once(spark, tmp_path):
    """The check, the sampling of the order and the numbering read one copy."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    given = events(spark, 1, 20)
    assert audit_store.append(given.mapInArrow(told, given.schema), str(tmp_path / "log"), "a", ["timestamp", "resource"], 4)
    assert seen.value == given.count()
    found = audit_store.manifest(spark, str(tmp_path / "log"))
    assert found.agg(F.sum("rows")).first()[0] == given.count()
    end = audit_store.load(spark, str(tmp_path / "log")).orderBy(F.desc("id")).first()
    last = audit_store.commits(spark, str(tmp_path / "log")).first()
    assert (last["last_id"], last["last_chain"], last["head"]) == (end["id"], end["chain"], end["event_hash"])
