"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most max_copies times what it has; the
excess is shared again by weight. A document is expected target / source size times in the mix.
The whole part of that is certain; its fraction is the inclusion probability of one more copy.
Documents are ranked by their random odds divided by their inclusion odds, and the sample of a
source is filled in that order up to what is left of its target, counted in words.

No source is brought together: the end of its sample is found by counts over ranges of the ranks,
each time in the range that holds the end. Near the end single documents are taken in order
where they still fit, so that whole documents meet the target closely. Where they miss it by more
than SLACK of it (a source may be one long document), the next document is taken in part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm.common import WORD, join_by_key
from basketline.session import written

RANKS = 1 << 48
RANGES = 1024
LEVELS = 3
#: Documents near the end of a sample that are tried one by one.
LAST_ONES = 64
#: The share of a target that whole documents may leave open.
SLACK = 0.01


def word_count(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_number(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the seed and the columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def targets(sources: DataFrame, weights: tuple[float, ...], max_copies: float) -> DataFrame:
    """Add weight and target to a table of source and source_size, one row per source.

    Weights repeat over the sources in code point order, null last. Where a target would pass
    max_copies times the size, the source gets that, and the rest is shared by weight again until
    none is above; in the order of limit per weight this is one running sum.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight.cast("double")).withColumn("_limit", F.col("source_size") * F.lit(float(max_copies)))
    order = Window.orderBy(F.col("_limit") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("weight").over(after))
    rows = rows.withColumn("_open", F.col("_level") * F.col("weight") <= F.col("_limit"))
    rows = rows.withColumn("_place", F.row_number().over(order))
    level = F.min(F.when(F.col("_open"), F.struct("_place", "_level"))).over(everything)["_level"]
    target = F.least("_limit", F.coalesce(level * F.col("weight"), F.col("_limit")))
    return rows.withColumn("target", target).drop("_limit", "_level", "_open", "_place")


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Certain copies and rank, from expected copies."""
    chance = F.col("expected") - F.floor("expected")
    number = F.col("_random")
    odds = F.try_divide(number / (1 - number), chance / (1 - chance))
    rank = F.floor(odds / (1 + odds) * F.lit(float(RANKS))).cast("long")
    rank = F.when(chance > 0, F.least(rank, F.lit(RANKS - 1)))
    return rows.withColumn("certain", F.floor("expected").cast("long")).withColumn("rank", rank)


def samples(rows: DataFrame) -> DataFrame:
    """Per source (key _source) where its sample ends: every rank below `low` is in, as are the ranks
    `last`; of the rank `part` only part_words words are, for each row.

    rows: _source, size, rank, `rest`, the words that the sample of the source is to hold, and `slack`, those
    that may be left open.
    """
    rows = rows.filter("rank IS NOT NULL AND size > 0")
    ends = rows.groupBy("_source").agg(F.first("rest").alias("rest"), F.first("slack").alias("slack"), F.count("*").alias("n"))
    ends = ends.select("_source", "rest", "slack", "n", F.lit(0).cast("long").alias("low"), F.lit(RANKS).cast("long").alias("high"), F.lit(0).cast("long").alias("taken"))
    total = rows.count()
    for _ in range(LEVELS):
        ends = written(ends, "mix-ends")
        inside = join_by_key(rows.select("_source", "size", "rank"), ends, "_source", "n", total, stored=True)
        step = F.ceil((F.col("high") - F.col("low")) / RANGES).cast("long")
        inside = inside.filter("rank >= low AND rank < high").withColumn("range", F.floor((F.col("rank") - F.col("low")) / step).cast("long"))
        counts = inside.groupBy("_source", "range").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        counts = counts.join(ends, "_source")
        so_far = Window.partitionBy("_source").orderBy("range")
        counts = counts.withColumn("until", F.col("taken") + F.sum("words").over(so_far))
        counts = counts.withColumn("over", (F.col("until") > F.col("rest")).cast("long"))
        counts = counts.withColumn("tried", F.sum(F.col("over") * F.col("rows")).over(so_far))
        low = F.min(F.when(F.col("over") == 1, F.col("low") + F.col("range") * step))
        high = F.min(F.when(F.col("tried") > LAST_ONES, F.least("high", F.col("low") + (F.col("range") + 1) * step)))
        words = F.coalesce(F.max(F.when(F.col("over") == 0, F.col("until"))), F.first("taken"))
        found = counts.groupBy("_source").agg(low.alias("_low"), high.alias("_high"), words.alias("_taken"))
        # Where all fit, the sample ends behind the last; the range stays empty from there on.
        ends = ends.join(found, "_source", "left").select(
            "_source",
            "rest",
            "slack",
            "n",
            F.coalesce("_low", "high").alias("low"),
            F.coalesce("_high", "high").alias("high"),
            F.coalesce("_taken", "taken").alias("taken"),
        )
    ends = written(ends, "mix-ends")
    inside = join_by_key(rows.select("_source", "size", "rank"), ends, "_source", "n", total, stored=True)
    units = inside.filter("rank >= low AND rank < high").groupBy("_source", "rank").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    order = Window.partitionBy("_source").orderBy("rank")
    units = units.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LAST_ONES + 1)
    near = units.groupBy("_source").agg(F.array_sort(F.collect_list(F.struct("rank", "words", "rows"))).alias("units"))
    ends = ends.join(near, "_source", "left").withColumn("units", F.coalesce("units", F.expr("CAST(array() AS array<struct<rank: bigint, words: bigint, rows: bigint>>)")))
    start = F.struct((F.col("rest") - F.col("taken")).cast("double").alias("left"), F.expr("CAST(array() AS array<bigint>)").alias("last"))

    def fill(state: Column, unit: Column) -> Column:
        fits = unit["words"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] - unit["words"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.concat(state["last"], F.array(unit["rank"]))).otherwise(state["last"]).alias("last"),
        )

    ends = ends.withColumn("filled", F.aggregate("units", start, fill))
    # One more, the smallest, where the target is nearer with it than without.
    spare = F.filter("units", lambda u: ~F.array_contains(F.col("filled.last"), u["rank"]))
    small = F.array_min(F.transform(spare, lambda u: F.struct(u["words"].alias("words"), u["rank"].alias("rank"))))
    ends = ends.withColumn("small", small)
    nearer = F.coalesce(F.col("small.words") - F.col("filled.left") < F.col("filled.left"), F.lit(False))
    last = F.concat("filled.last", F.when(nearer, F.array("small.rank")).otherwise(F.expr("CAST(array() AS array<bigint>)")))
    open_ = ~nearer & (F.col("filled.left") > F.col("slack"))
    next_one = F.when(open_, F.get(F.filter("units", lambda u: ~F.array_contains(F.col("filled.last"), u["rank"])), F.lit(0)))
    ends = ends.withColumn("next", next_one)
    words = F.floor(F.col("filled.left") / F.col("next.rows")).cast("long")
    return ends.select("_source", "low", last.alias("last"), F.col("next.rank").alias("part"), words.alias("part_words"))


def mix(docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], max_copies: int = 3, seed: int = 1, preference: str | None = None) -> DataFrame:
    """All rows and columns of docs, and size, source_size, target, copies, part (words of one more,
    incomplete copy) and taken (words in all).

    preference: a column of numbers above 0; a document's expected copies follow it within its
    source (max_copies at most), which makes inclusion probabilities unequal there too.

    The choice depends on seed, key and text alone, so reruns agree; rows equal in both are taken
    or left together. A null text has size 0 and no copies; a null source is a source, the last
    one; null keys are told apart by text. A source with no words has target 0. Columns of docs
    named like an added one are replaced; names with a leading underscore are reserved.
    """
    added = ("size", "source_size", "target", "copies", "part", "taken")
    sized = docs.drop(*[c for c in docs.columns if c in added and c not in (key, text, source)])
    wanted = F.lit(1.0) if preference is None else F.greatest(F.col(preference).cast("double"), F.lit(1e-9))
    keyed = sized.withColumns(
        {
            "size": word_count(text),
            "_source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")),
            "_random": random_number(seed, key, text),
            "_wanted": F.coalesce(wanted, F.lit(1.0)),
        }
    )
    narrow = written(keyed.select("_source", F.col(source).alias("source"), "size", "_random", "_wanted"), "mix-sizes")
    sources = narrow.groupBy("_source").agg(
        F.first("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.sum(F.col("size") * F.col("_wanted")).alias("_weighed"),
        F.count("*").alias("n"),
    )
    sources = written(targets(sources, weights, max_copies).drop("source", "weight"), "mix-targets")
    total = narrow.count()

    def expected(rows: DataFrame) -> DataFrame:
        rows = join_by_key(rows, sources, "_source", "n", total, stored=True)
        share = F.try_divide(F.col("target") * F.col("_wanted"), F.col("_weighed"))
        return _ranked(rows.withColumn("expected", F.coalesce(F.least(share, F.lit(float(max_copies))), F.lit(0.0))), seed)

    ranked = written(expected(narrow).select("_source", "size", "certain", "rank", "target"), "mix-ranks")
    certain = ranked.groupBy("_source").agg(F.sum(F.col("size") * F.col("certain")).alias("certain_words"), F.count("*").alias("n"))
    rest = join_by_key(ranked.drop("certain"), certain, "_source", "n", total)
    rest = rest.withColumns({"rest": F.col("target") - F.col("certain_words"), "slack": F.col("target") * SLACK})
    ends = written(samples(rest.select("_source", "size", "rank", "rest", "slack")), "mix-samples")
    facts = sources.select("_source", "n").join(ends.withColumnRenamed("part", "_part"), "_source", "left")
    rows = join_by_key(expected(keyed), facts, "_source", "n", total)
    one_more = F.coalesce((F.col("rank") < F.col("low")) | F.array_contains("last", F.col("rank")), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("certain") + one_more.cast("long")).otherwise(0)
    part = F.when(F.col("rank") == F.col("_part"), F.least("part_words", "size"))
    rows = rows.withColumns({"copies": copies, "part": F.coalesce(part, F.lit(0)).cast("long")})
    rows = rows.withColumn("taken", F.col("size") * F.col("copies") + F.col("part"))
    return rows.select(*[c for c in sized.columns], *added)
