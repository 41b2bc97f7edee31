"""Helpers that several operators share."""

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.session import written

#: Words are runs of anything but these ASCII white space characters; bytes.split() cuts alike.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than this share of all rows is hot. There are at most so many hot keys.
HOT_KEYS = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def cell_count(docs: DataFrame, column: str, cell_bytes: int) -> int:
    """Cells of about cell_bytes bytes of text each; one at least."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, -(-total // cell_bytes))


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, how: str = "left", stored: bool = False) -> DataFrame:
    """Join rows with facts (one row per key, count: the rows that have it); how: left or inner.

    Keys with more than one row in HOT_KEYS of the total are joined by broadcast; as their
    counts add up to the total at most, there are fewer than HOT_KEYS of them. So no task of
    the shuffled join gets more than that share of the rows by one key. The count is dropped.
    facts are written first unless they are a stored table; a kind of key that there is none of
    needs no join.
    """
    facts = facts if stored else written(facts, "facts")
    facts = facts.withColumn("_hot", F.coalesce(F.col(count) * HOT_KEYS > total, F.lit(False)))
    kinds = {r["_hot"] for r in facts.select("_hot").distinct().collect()}
    hot = F.broadcast(facts.filter("_hot").drop(count, "_hot"))
    cold = facts.filter("NOT _hot").drop(count, "_hot")
    if True not in kinds:
        return rows.join(cold, key, how)
    if False not in kinds:
        return rows.join(hot, key, how)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rows.join(hot, key).unionByName(rest)


def checksum(frame: DataFrame) -> tuple:
    """Rows and a sum over their hashes: equal for equal tables, whatever their order."""
    return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Every node of the edges (columns a and b) but the roots, with its root: the least node it is connected to.

    Alternates large stars (a node's larger neighbours move to its least one) and small stars
    (its smaller ones do), which ends in stars after some log^2 n rounds. Each round is written, so
    lineage stays short; nodes with very many neighbours are joined by broadcast.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = written(edges, "edges")
    state = None

    def stars(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        return join_by_key(pairs, least, "u", "n", pairs.count())

    while (now := checksum(edges)) != state:
        state = now
        both = written(edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v")), "edges")
        large = stars(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = stars(written(large.filter("a != b").selectExpr("a AS u", "b AS v"), "edges"))
        moved = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(moved.filter("a != b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """What make() returned on first use in this Python worker; it outlives a task.

    For memories of pure functions only, which never change a result.
    """
    module = sys.modules.setdefault("_basketline_memory", types.ModuleType("_basketline_memory"))
    if name not in module.__dict__:
        module.__dict__[name] = make()
    return module.__dict__[name]
