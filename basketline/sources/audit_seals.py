"""Seals of the stored audit log: a Merkle mountain range over the heads of its closed chains.

Leaf i is the head of chain i; a node is the hash of two neighbours of the level below. Nodes never change when chains
are added, so a seal (how many chains, and a hash over the tops of the range) can be renewed from the new chains and
the few tops of the one before. Whoever kept an old seal can check that a newer one only adds to it: the nodes of
both, some two per level, are enough. Only the chains after the kept seal have to be read event by event.

The last chain may still grow, so it is in no seal. A purge links chains anew; seals from before it end there, and the
first one after it covers all chains again. What a purge has taken out whole is a leaf without a head.
"""

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.errors import AuditIntegrityError
from basketline.operators import audit
from basketline.sources import audit_store

# Levels that one pass builds: a task sees the nodes below one node, at most 2 to this power.
SPAN = 10

_NODES = "level int, place long, hash string"
_SEALS = "size long, root string, epoch long"


@dataclass(frozen=True)
class Seal:
    """How many chains are sealed, and the hash over the tops of their range."""

    size: int
    root: str


def tops(first: int, last: int) -> list[tuple[int, int]]:
    """The largest whole nodes, as (level, place), that cover the leaves from first up to, not including, last."""
    found = []
    while first < last:
        level = (last - first).bit_length() - 1
        if first:
            level = min(level, (first & -first).bit_length() - 1)
        found.append((level, first >> level))
        first += 1 << level
    return found


def _hash(kind: str, *parts: str) -> str:
    return hashlib.sha256("\0".join((kind, *parts)).encode("utf-8")).hexdigest()


def root_of(size: int, hashes: list[str]) -> str:
    """The hash of a seal from those of its tops."""
    return _hash("root", str(size), *hashes)


# What a log without closed chains is sealed with; every log adds to it.
EMPTY = Seal(0, root_of(0, []))


def _leaf(chain: Column, head: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit("leaf"), chain.cast("string"), F.coalesce(head, F.lit(""))), 256)


def _builder(span: int):
    """Group function: all nodes above those given, up to `span` levels above the lowest."""

    def build(nodes: pd.DataFrame) -> pd.DataFrame:
        base = int(nodes["base"].iloc[0])
        levels = [{} for _ in range(span + 1)]
        for level, place, value in zip(nodes["level"], nodes["place"], nodes["hash"]):
            levels[level - base][place] = value
        made = []
        for step in range(span):
            below, above = levels[step], levels[step + 1]
            for place, left in below.items():
                if place % 2 == 0 and place + 1 in below:
                    text = "\0".join(("node", left, below[place + 1]))
                    value = hashlib.sha256(text.encode("utf-8")).hexdigest()
                    above[place // 2] = value
                    made.append((base + step + 1, place // 2, value))
        return pd.DataFrame(made, columns=["level", "place", "hash"]).astype({"level": "int32", "place": "int64"})

    return build


def write_nodes(leaves: DataFrame, old_tops: list[tuple[int, int, str]], size: int, target: str, span: int = SPAN) -> None:
    """Write new leaves (level 0) and every node above them, with the tops of the range before: a folder per pass.

    Each pass builds `span` levels and shuffles only the nodes of its lowest one.
    """
    spark = leaves.sparkSession
    leaves.write.mode("overwrite").parquet(f"{target}/above=-1")
    base = 0
    while size >> base > 1:
        lowest = spark.read.schema(_NODES).parquet(target).where(F.col("level") == base).drop("above")
        beside = [top for top in old_tops if base <= top[0] < base + span]
        given = lowest.unionByName(spark.createDataFrame(beside, _NODES))  # at most a row per level
        over = F.expr(f"shiftright(place, {base + span} - level)")
        grouped = given.withColumns({"base": F.lit(base), "over": over}).groupBy("over")
        grouped.applyInPandas(_builder(span), _NODES).write.mode("overwrite").parquet(f"{target}/above={base}")
        base += span


def _epoch(spark: SparkSession, path: str) -> int:
    """The number of the last purge, 0 without one."""
    done = audit_store.commits(spark, path).where("kind = 'purge'")
    return done.agg(F.max("seq")).first()[0] or 0


def _latest(spark: SparkSession, path: str, epoch: int) -> Seal:
    stored = audit_store._read(spark, path, "seals", _SEALS).where(F.col("epoch") == epoch)
    found = stored.agg(F.max(F.struct("size", "root")).alias("last")).first()["last"]
    return Seal(found["size"], found["root"]) if found else EMPTY


def latest_seal(spark: SparkSession, path: str) -> Seal:
    """The newest seal since the last purge; the empty one if there is none."""
    return _latest(spark, path, _epoch(spark, path))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Every node of the current range: level, place, hash."""
    epoch = _epoch(spark, path)
    sealed = audit_store._read(spark, path, "seals", _SEALS).where(F.col("epoch") == epoch).select("size")
    stored = audit_store._read(spark, path, "nodes", f"{_NODES}, epoch long, sealed long").where(F.col("epoch") == epoch)
    return stored.join(sealed, F.col("sealed") == F.col("size"), "left_semi").select("level", "place", "hash")


def _hashes(stored: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """Some nodes by (level, place): two per level at most."""
    if not wanted:
        return {}
    some = F.struct("level", "place").isin(*[F.struct(F.lit(lv).cast("int"), F.lit(at).cast("long")) for lv, at in wanted])
    return {(r["level"], r["place"]): r["hash"] for r in stored.where(some).collect()}


def seal(spark: SparkSession, path: str, span: int = SPAN) -> Seal:
    """Seal all closed chains, from the heads of those added since the last seal and the nodes of that.

    Nodes are written before their seal; those of a call that failed do not count and are written over.
    """
    epoch = _epoch(spark, path)
    size = audit_store._last(spark, path)["last_chain"] or 0
    before = _latest(spark, path, epoch)
    start = before.size
    if size <= start:
        return before
    old = _hashes(nodes(spark, path), tops(0, start))
    heads = audit_store.manifest(spark, path).where((F.col("chain") >= start) & (F.col("chain") < size))
    chains = spark.range(start, size).withColumnRenamed("id", "chain")
    leaves = chains.join(heads.select("chain", "head"), "chain", "left").select(
        F.lit(0).alias("level"), F.col("chain").alias("place"), _leaf(F.col("chain"), F.col("head")).alias("hash")
    )
    target = f"{path}/nodes/epoch={epoch}/sealed={size}"
    write_nodes(leaves, [(*top, value) for top, value in old.items()], size, target, span)
    known = old | _hashes(spark.read.schema(_NODES).parquet(target), tops(0, size))
    made = Seal(size, root_of(size, [known[top] for top in tops(0, size)]))
    row = spark.createDataFrame([(size, made.root)], "size long, root string").coalesce(1)
    row.write.mode("overwrite").parquet(f"{path}/seals/epoch={epoch}/of={size}")
    return made


def proof(spark: SparkSession, path: str, old: int, new: int) -> list[str]:
    """Hashes that show that a seal over `new` chains only adds to one over `old`: two per level at most."""
    wanted = [*tops(0, old), *tops(old, new)]
    found = _hashes(nodes(spark, path), wanted)
    missing = [place for place in wanted if place not in found]
    if missing:
        raise AuditIntegrityError(f"the range of {new} chains has no node {missing[0]}")
    return [found[place] for place in wanted]


def only_adds(old: Seal, new: Seal, hashes: list[str]) -> bool:
    """Whether a proof leads to both seals. Needs nothing but the seals, so whoever kept one can tell."""
    places = [*tops(0, old.size), *tops(old.size, new.size)]
    if old.size > new.size or len(places) != len(hashes):
        return False
    if root_of(old.size, hashes[: len(tops(0, old.size))]) != old.root:
        return False
    merged: list[tuple[int, int, str]] = []
    for (level, place), value in zip(places, hashes):
        while merged and place % 2 and merged[-1][:2] == (level, place - 1):
            value = _hash("node", merged.pop()[2], value)
            level, place = level + 1, place // 2
        merged.append((level, place, value))
    return root_of(new.size, [value for _, _, value in merged]) == new.root


def verify_since(spark: SparkSession, path: str, kept: Seal) -> None:
    """Raise unless the log only adds to a seal that was kept, and all that it adds is sound.

    Three things are checked: the newest seal leads back to the kept one, the heads in the manifest are the sealed
    leaves (a row per chain), and the events of chains after the kept seal hash and link up. Events of older chains are
    not read: one that was changed without its head is found by `audit_store.verify` only. After a purge, seals from
    before it are refused.
    """
    newest = latest_seal(spark, path)
    if newest.size < kept.size:
        raise AuditIntegrityError(f"no seal since the last purge covers {kept.size} chains")
    if not only_adds(kept, newest, proof(spark, path, kept.size, newest.size)):
        raise AuditIntegrityError(f"the seal of {newest.size} chains does not add to that of {kept.size}")
    manifest = audit_store.manifest(spark, path)
    leaves = nodes(spark, path).where("level = 0").select(F.col("place").alias("chain"), "hash")
    both = leaves.join(manifest.select("chain", "head"), "chain", "left")
    changed = both.where(_leaf(F.col("chain"), F.col("head")) != F.col("hash")).agg(F.min("chain")).first()[0]
    if changed is not None:
        raise AuditIntegrityError(f"chain {changed} is not the one that was sealed")
    added = manifest.where(F.col("chain") >= kept.size)
    since = added.agg(F.min("first_time")).first()[0]
    rows = audit_store.load(spark, path).where(F.col("chain") >= kept.size)
    if since is not None:  # Only the folders of days from the first added event on are opened.
        rows = rows.where(F.col("day") >= since[:10])
    audit.verify_events(rows, added.drop("first_time", "last_time"))
