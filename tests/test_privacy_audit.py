import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from basketline.errors import AccessError, AuditIntegrityError, PseudonymizationError, StorageError
from basketline.functions.crypto import derive_key
from basketline.operators import audit, privacy
from basketline.operators.ordinals import with_ordinals
from tests.frames import sample_lines

KEY = bytes.fromhex("ab" * 32)


def customers(spark):
    return spark.createDataFrame(
        [("12345",), ("67890",), ("12345",), (None,)], "CustomerID string"
    )


@pytest.mark.parametrize("key", [KEY, b"k", b"long" * 40])
def test_pseudonyms_are_hmacs(spark, key):
    rows = privacy.pseudonymize_column(customers(spark), key, output_column="p").collect()
    for row in rows:
        expected = None
        if row["CustomerID"] is not None:
            expected = hmac.new(key, row["CustomerID"].encode(), hashlib.sha256).hexdigest()
        assert row["p"] == expected


def test_pseudonym_contract(spark):
    frame = customers(spark)
    with pytest.raises(ValueError):
        privacy.pseudonymize_column(frame, b"")
    with pytest.raises(PseudonymizationError):
        privacy.pseudonymize_column(frame, KEY, column="Name")
    replaced = privacy.pseudonymize_column(frame, KEY, drop_source=True)
    assert replaced.columns == ["CustomerID"]
    assert replaced.where("CustomerID = '12345'").count() == 0
    moved = privacy.pseudonymize_column(frame, KEY, output_column="p", drop_source=True)
    assert moved.columns == ["p"]
    by_hex = privacy.pseudonymize_customers(frame, KEY.hex())
    assert by_hex.collect() == privacy.pseudonymize_column(frame, KEY).collect()


def test_key_is_not_in_the_plan(spark):
    key = b"very secret key bytes"
    frame = privacy.pseudonymize_column(customers(spark), key)
    plan = frame._jdf.queryExecution().toString()
    inner = bytes(b ^ 0x36 for b in key.ljust(64, b"\0"))
    assert "very secret" not in plan and inner[:8].hex().upper() not in plan.upper()


def test_derived_key_is_hkdf():
    pseudo_random = hmac.new(b"\0" * 32, KEY, hashlib.sha256).digest()
    expected = hmac.new(pseudo_random, b"context\x01", hashlib.sha256).digest()
    assert derive_key(KEY, b"context") == expected


@pytest.mark.parametrize("role", ["viewer", "analyst", "admin"])
@pytest.mark.parametrize("minimum", ["viewer", "analyst", "admin"])
def test_roles(role, minimum):
    order = ["viewer", "analyst", "admin"]
    assert privacy.check(role, minimum) == (order.index(role) >= order.index(minimum))


def test_authorize():
    assert privacy.authorize("viewer", "revenue") == (True, "role_ok")
    assert privacy.authorize("viewer", "customers") == (False, "role_insufficient")
    with pytest.raises(AccessError):
        privacy.authorize("viewer", "secrets")
    with pytest.raises(AccessError):
        privacy.check("guest", "viewer")


def test_decisions_equal_single_calls(spark):
    requests = spark.createDataFrame(
        [(r, v) for r in ("viewer", "analyst", "admin", "guest")
         for v in ("revenue", "products", "time", "customers", "secrets")],
        "role string, view string",
    )
    for row in privacy.decide_access(requests).collect():
        if row["role"] == "guest" or row["view"] == "secrets":
            assert row["allowed"] is None
        else:
            assert (row["allowed"], row["reason"]) == privacy.authorize(row["role"], row["view"])


def test_views(spark):
    lines = sample_lines(spark)
    assert "CustomerID" not in privacy.scope_view(lines, "viewer", "revenue").columns
    assert "CustomerID" in privacy.scope_view(lines, "analyst", "revenue").columns
    assert privacy.scope_view(lines, "admin", "customers").columns == lines.columns
    assert privacy.scope_view(lines.select("Country"), "viewer", "products").columns == []
    with pytest.raises(StorageError):
        privacy.scope_view(lines, "viewer", "customers")
    with pytest.raises(StorageError):
        privacy.scoped_columns(lines.columns, "viewer", "secrets")


def test_small_groups(spark):
    assert not privacy.enforce_small_group(4) and privacy.enforce_small_group(5)
    for size, threshold in ((1, 0), (-1, 5)):
        with pytest.raises(AccessError):
            privacy.enforce_small_group(size, threshold)
    lines = sample_lines(spark)
    kept = privacy.suppress_small_groups(lines, ["StockCode"], 1)
    assert kept.where("StockCode = 'FEE'").count() == 0 and kept.count() == 5
    sizes = privacy.group_sizes(lines, ["StockCode"], 2)
    events = privacy.suppression_events(sizes, F.col("StockCode"), "viewer", 2).collect()
    assert len(events) == 3 and all(e["action"] == "access_denied" for e in events)


def events(spark, count=25):
    rows = [
        (f"2026-01-{1 + n // 5:02}T00:00:{n % 5:02}+00:00", f"u{n % 3}", "login_success", "success",
         None if n % 4 else f"r{n}", '{"n":%d}' % n, n)
        for n in range(count)
    ]
    return spark.createDataFrame(
        rows,
        "timestamp string, actor string, action string, outcome string, resource string, "
        "details_json string, n int",
    )


def chain_by_hand(rows, previous=None):
    hashes = []
    for row in rows:
        parts = [previous or "", row["timestamp"], row["actor"], row["action"], row["outcome"],
                 row["resource"] or "", row["details_json"]]
        previous = hashlib.sha256("\0".join(parts).encode()).hexdigest()
        hashes.append(previous)
    return hashes


def test_one_chain_links_all_events(spark):
    rows = audit.append_events(events(spark), ["timestamp", "n"]).orderBy("id").collect()
    assert [row["id"] for row in rows] == list(range(1, 26))
    assert [row["event_hash"] for row in rows] == chain_by_hand(rows)
    assert [row["previous_hash"] for row in rows] == [None, *chain_by_hand(rows)[:-1]]


def test_appending_continues_the_chain(spark):
    whole = audit.append_events(events(spark), ["timestamp", "n"], chain_rows=10)
    early = events(spark).where("n < 13")
    first = audit.append_events(early, ["timestamp", "n"], chain_rows=10).cache()
    second = audit.append_events(
        events(spark).where("n >= 13"), ["timestamp", "n"], first, chain_rows=10
    )
    joined = first.unionByName(second)
    assert joined.orderBy("id").collect() == whole.orderBy("id").collect()
    audit.verify_events(joined)


def test_tampering_is_found(spark):
    table = audit.append_events(events(spark), ["timestamp", "n"], chain_rows=10).cache()
    audit.verify_events(table)
    audit.verify_events(table.limit(0))
    edited = table.withColumn("actor", F.when(F.col("id") == 7, "x").otherwise(F.col("actor")))
    with pytest.raises(AuditIntegrityError, match="id=7: event_hash"):
        audit.verify_events(edited)
    with pytest.raises(AuditIntegrityError, match="id=8: previous_hash"):
        audit.verify_events(table.where("id <> 7"))
    manifest = audit.chain_manifest(table).cache()
    audit.verify_events(table, manifest)
    gone = table.where("chain <> 1")
    audit.verify_events(gone)
    with pytest.raises(AuditIntegrityError, match="id=11: chain is missing"):
        audit.verify_events(gone, manifest)
    with pytest.raises(AuditIntegrityError, match="id=21: chain differs"):
        audit.verify_events(table.where("id < 25"), manifest)
    assert audit.chain_seal(gone).first() != audit.chain_seal(table).first()
    assert audit.chain_seal(table, fan_in=2).count() == 1


def test_purge_and_read(spark):
    table = audit.append_events(events(spark), ["timestamp", "n"], chain_rows=10).cache()
    kept = audit.purge_before(table, "2026-01-03T00:00:00+00:00").cache()
    assert kept.agg(F.min("id")).first()[0] == 11
    audit.verify_events(kept)
    untouched = audit.purge_before(table, "2025-01-01T00:00:00+00:00")
    assert untouched.orderBy("id").collect() == table.orderBy("id").collect()
    recent = audit.read_events(table, limit=3, since="2026-01-02T00:00:00+00:00").collect()
    assert [row["id"] for row in recent] == [6, 7, 8]
    with pytest.raises(ValueError):
        audit.read_events(table, limit=0)
    assert audit.read_events(table, since="2026-01-02T01:00:00+01:00").count() == 20
    for refuse in (lambda t: audit.read_events(table, since=t), lambda t: audit.purge_before(table, t)):
        with pytest.raises(ValueError, match="time zone"):
            refuse("2026-01-02T00:00:00")


def test_stored_events(spark, tmp_path):
    path = str(tmp_path / "audit")
    audit.store_events(audit.append_events(events(spark), ["timestamp", "n"]), path)
    stored = audit.load_events(spark, path)
    written = audit.event_row(
        spark, "protected_store_write", "20260101T000000Z", {"rows": 5, "columns": 3}
    )
    assert written.first()["details_json"] == '{"actor_role":"pipeline","columns":3,"rows":5}'
    assert audit.event_problems(written).first()["problem"] is None
    audit.store_events(audit.append_events(written, ["timestamp"], stored), path)
    again = audit.load_events(spark, path)
    audit.verify_events(again)
    assert again.count() == 26
    recent = audit.read_events(again, since="2026-01-05T00:00:00+00:00")
    assert [row["id"] for row in recent.collect()] == [21, 22, 23, 24, 25, 26]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_event_rules(spark):
    good = events(spark, 1)
    bad = good.withColumn("actor", F.lit("")).unionByName(
        good.withColumn("action", F.lit("dance"))
    ).unionByName(good.withColumn("outcome", F.lit("maybe"))).unionByName(
        good.withColumn("timestamp", F.lit(None).cast("string"))
    )
    assert audit.event_problems(good).where("problem is not null").count() == 0
    assert audit.event_problems(bad).where("problem is not null").count() == 4
    times = ("garbage", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "2024-01-01T02:00:00+02:00")
    spelled = audit.event_problems(good.withColumn("timestamp", F.explode(F.array(*map(F.lit, times)))))
    assert [row["timestamp"] for row in spelled.where("problem IS NULL").collect()] == ["2024-01-01T00:00:00+00:00"]
    instant = spark.sql("select timestamp'2026-07-11 15:28:09.7 UTC' as t")
    assert instant.select(audit.utc_text(F.col("t"))).first()[0] == "2026-07-11T15:28:09+00:00"


def test_ordinals(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), "id")
    rows = with_ordinals(frame, ["v", "id"], name="place", start=5).orderBy("v", "id").collect()
    assert [row["place"] for row in rows] == list(range(5, 1005))
