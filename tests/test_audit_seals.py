import pytest
from pyspark.sql import functions as F

from basketline.errors import AuditIntegrityError
from basketline.sources import audit_seals, audit_store
from basketline.sources.audit_seals import EMPTY, Seal, only_adds, root_of, tops
from tests.test_audit_store import ORDER, events


def subtree(leaves):
    """The hash over a power of two of leaves, by halves."""
    if len(leaves) == 1:
        return leaves[0]
    half = len(leaves) // 2
    return audit_seals._hash("node", subtree(leaves[:half]), subtree(leaves[half:]))


def node(leaves, level, place):
    return subtree(leaves[place << level : (place + 1) << level])


def seal_of(leaves, size):
    return Seal(size, root_of(size, [node(leaves, *top) for top in tops(0, size)]))


def test_tops_cover_each_leaf_once():
    for first in range(20):
        for last in range(first, 40):
            covered = [leaf for level, place in tops(first, last) for leaf in range(place << level, (place + 1) << level)]
            assert covered == list(range(first, last))
            assert len(tops(first, last)) <= 2 * max(1, (last - first).bit_length())


def test_a_proof_leads_to_both_seals_only_if_nothing_before_changed():
    leaves = [audit_seals._hash("leaf", str(i)) for i in range(21)]
    for old in range(22):
        for new in range(old, 22):
            places = [*tops(0, old), *tops(old, new)]
            proof = [node(leaves, *place) for place in places]
            assert only_adds(seal_of(leaves, old), seal_of(leaves, new), proof)
            for changed in {0, old // 2, old - 1} if old else ():
                other = [*leaves]
                other[changed] = audit_seals._hash("leaf", "other")
                assert not only_adds(seal_of(leaves, old), seal_of(other, new), proof)
                forged = [node(other, *place) for place in places]
                assert not only_adds(seal_of(leaves, old), seal_of(other, new), forged)
            assert not only_adds(seal_of(leaves, old), seal_of(leaves, new), [*proof, "x"])
            if old < new:
                assert not only_adds(seal_of(leaves, new), seal_of(leaves, old), proof)


@pytest.mark.parametrize("span", [1, 2, 10])
def test_nodes_made_in_several_seals_are_those_made_at_once(spark, tmp_path, span):
    leaves = [audit_seals._hash("leaf", str(i)) for i in range(13)]
    known = {}
    for start, size in [(0, 3), (3, 4), (4, 13)]:
        rows = spark.createDataFrame([(0, i, leaves[i]) for i in range(start, size)], "level int, place long, hash string")
        old = [(*top, known[top]) for top in tops(0, start)]
        target = f"{tmp_path}/{size}"
        audit_seals.write_nodes(rows, old, size, target, span)
        made = spark.read.parquet(target).collect()
        assert len(made) == len({(r["level"], r["place"]) for r in made})
        known |= {(r["level"], r["place"]): r["hash"] for r in made}
    expected = {(level, place): node(leaves, level, place) for level in range(4) for place in range(13 >> level)}
    assert known == expected


def test_seals_of_a_log(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    audit_store.append(events(spark, 1, 1), log, "one", ORDER, 10)
    assert audit_seals.seal(spark, log) == EMPTY == audit_seals.latest_seal(spark, log)
    audit_seals.verify_since(spark, log, EMPTY)
    audit_store.append(events(spark, 2, 9), log, "two", ORDER, 5)
    first = audit_seals.seal(spark, log)
    assert first.size == audit_store._last(spark, log)["last_chain"] > 0
    assert audit_seals.seal(spark, log) == first
    audit_store.append(events(spark, 10, 15), log, "three", ORDER, 5)
    second = audit_seals.seal(spark, log)
    for kept in (EMPTY, first, second):
        audit_seals.verify_since(spark, log, kept)
    with pytest.raises(AuditIntegrityError, match="does not add"):
        audit_seals.verify_since(spark, log, Seal(first.size, second.root))

    # A changed event of a chain after the kept seal is found without reading those before it.
    stored = f"{log}/events/batch=three"
    rows = spark.read.parquet(stored).withColumn("actor", F.when(F.col("id") == 41, "eve").otherwise(F.col("actor")))
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    kept.write.mode("overwrite").partitionBy("day").parquet(stored)
    with pytest.raises(AuditIntegrityError, match="id=41"):
        audit_seals.verify_since(spark, log, first)
    audit_seals.verify_since(spark, log, Seal(second.size, second.root))


def test_a_head_that_was_changed_after_sealing_is_found(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    audit_store.append(events(spark, 1, 6), log, "one", ORDER, 5)
    first = audit_seals.seal(spark, log)
    chains = f"{log}/chains/batch=one"
    rows = spark.read.parquet(chains).withColumn("head", F.when(F.col("chain") == 2, "0").otherwise(F.col("head")))
    spark.createDataFrame(rows.collect(), rows.schema).write.mode("overwrite").parquet(chains)
    with pytest.raises(AuditIntegrityError, match="chain 2 is not"):
        audit_seals.verify_since(spark, log, first)


def test_a_purge_ends_the_seals_before_it(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    audit_store.append(events(spark, 1, 6), log, "one", ORDER, 5)
    first = audit_seals.seal(spark, log)
    audit_store.purge(spark, log, "2024-03-03T00:00:00+00:00")
    assert audit_seals.latest_seal(spark, log) == EMPTY
    with pytest.raises(AuditIntegrityError, match="since the last purge"):
        audit_seals.verify_since(spark, log, first)
    anew = audit_seals.seal(spark, log)
    assert anew.size == first.size and anew.root != first.root
    audit_seals.verify_since(spark, log, anew)
    audit_seals.verify_since(spark, log, EMPTY)
