"""A corpus pipeline: five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns documents with the same columns; the last one
adds what the mix takes. Names of columns are those of the documents table.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.llm import decontaminate, jaccard, mixing, quality, suffixes
from basketline.llm.common import table
from basketline.session import written

WEIGHTS = (5, 2, 1)


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under names that no operator adds, and the name for each column."""
    names = {column: f"field{i}" for i, column in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of the documents under their own names again."""
    return rows.select(*[F.col(name).alias(column) for column, name in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source.

    Rows equal in id, language, source and text have one verdict. An empty table stays empty. Further
    columns, whatever their names, come back unchanged.
    """
    rows, name = _renamed(docs)
    keyed = rows.withColumn("row", F.xxhash64(name["doc_id"], name["lang"], name["source"], F.xxhash64(name["text"])))
    verdicts = quality.judge(keyed, name["text"], name["lang"], name["source"], ["row"])
    kept = written(verdicts.filter("kept").select("row").distinct(), "pipeline-quality")
    return _named(keyed.join(kept, "row", "left_semi"), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id (null last), then row hash.

    Rows equal in id and text count as one document. Further columns, whatever their names, come
    back unchanged.
    """
    rows, name = _renamed(docs)
    found = written(jaccard.classes(rows, name["doc_id"], name["text"]), "pipeline-classes")
    alone = F.when(F.col("node").isNull(), F.col("row"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    kept = found.groupBy("node", alone.alias("alone")).agg(F.min(order)["row"].alias("row"))
    kept = written(kept.select("row").distinct(), "pipeline-classes")
    keyed = rows.withColumn("row", jaccard.row_key(name["doc_id"], name["text"]))
    rows = keyed.join(kept, "row", "left_semi")
    if found.count() > found.select("row").distinct().count():
        rows = rows.dropDuplicates(["row"])
    return _named(rows, name)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; n_chars follows.

    A character goes only if all of its bytes do, so texts stay valid. A document that nothing is
    left of goes; one that was empty before stays. Further columns, whatever their names, come
    back unchanged.
    """
    rows, name = _renamed(docs)
    cut = suffixes.dedup(rows, name["doc_id"], name["text"], whole_characters=True)
    text = F.decode("kept", "UTF-8")
    changed = F.col("n_removed") > 0
    null = F.lit(None).cast("string")
    rows = cut.filter((F.octet_length("kept") > 0) | ~changed).withColumn(name["text"], F.when(F.col("was_null"), null).otherwise(text))
    chars = name["n_chars"]
    kind = docs.schema["n_chars"].dataType
    rows = rows.withColumn(chars, F.when(changed, F.length(name["text"]).cast(kind)).otherwise(F.col(chars)))
    return _named(rows, name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, under other numbers and names neither."""
    return decontaminate.clean(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, copies, part and taken.

    Where the documents have a column of such a name, theirs stays, and that of the mix is called mix_size
    and so on.
    """
    rows, name = _renamed(docs)
    mixed = mixing.mix(rows, name["doc_id"], name["text"], name["source"], WEIGHTS).filter("taken > 0")
    added = []
    for column in ("size", "source_size", "target", "copies", "part", "taken"):
        free = column
        while free in docs.columns:
            free = f"mix_{free}"
        added.append(F.col(column).alias(free))
    return mixed.select(*[F.col(n).alias(c) for c, n in name.items()], *added)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
]

#: Outlier estimates, similarity classes and random ranks have no SQL; the stages are tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if stage is STAGES[-1][1] else written(out, name.replace(" ", "-"))
    return docs
