"""Pair each return with the most recent earlier sale that it can undo.

A return matches a sale of the same customer, stock code, unit count and unit price (to four
decimals). Sales are used last-in-first-out, each at most once. Seen as brackets, a sale opens
and a return closes, so the nesting level of a row, from running sums, tells which rows belong
together: within one key and level, sales and returns alternate.

The usual path hash-partitions on the key once and sorts: whole returns, and of sales what returns ask of them. All
rows but the returns stay where they are, as nothing is added to them. Of many rows, a share of the keys is paired at a
time and its returns are written, so that the shuffle of one share is there at a time. A key that holds a large part of all
rows would land in one task that way, so such keys are found first (exact counts of a hash of
the key, one narrow aggregation) and take a second path: their rows are range-partitioned in time order into
blocks, levels are computed per block from block totals, and only rows still open at a block
edge are matched across blocks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.schema import ORD
from basketline.session import stored, written

# Above this many rows a key is spread over several blocks of about this size.
HOT_KEY_ROWS = 4_000_000
# Groups that keys are counted in before single keys are.
KEY_GROUPS = 1 << 20
# Above this many rows to pair, keys are paired in so many shares, one after the other.
SHARED_ROWS = 4_000_000
KEY_SHARES = 4
# Rows of large keys in a range partition, which may be cut into several blocks.
PARTITION_ROWS = 1_000_000
_POSITION_BITS = 33

_KEY = ["CustomerID", "StockCode", "_units", "_price"]
_TIME = ["InvoiceDate", ORD]
_HELPERS = ["_units", "_price", "_delta", "_alone"]


def _to_four_decimals(price: Column) -> Column:
    """bround(price, 4), which goes by way of a big decimal; a price that has no more decimals is taken as it is."""
    near = F.rint(price * 10_000) / 10_000
    same = (near == price) & (price != 0) & (F.abs(price) < 10_000_000)
    return F.when(same, price).otherwise(F.bround(price, 4))


def _with_pair_key(lines: DataFrame) -> DataFrame:
    """Add the pair key, +1 for a usable sale, -1 for a usable return, 0 for any other row."""
    usable = (
        F.col("InvoiceDate").isNotNull()
        & F.col("CustomerID").isNotNull()
        & F.col("StockCode").isNotNull()
        & F.col("InvoiceNo").isNotNull()
        & F.col("UnitPrice").isNotNull()
        & F.coalesce(F.col("Quantity") != 0, F.lit(False))
    )
    sale = (F.col("Quantity") > 0) & ~F.col("IsCancellation") & ~F.col("IsAdjustment")
    delta = (
        F.when(usable & F.col("IsReturn"), F.lit(-1)).when(usable & sale, F.lit(1)).otherwise(0)
    )
    return lines.withColumns(
        {
            "_units": F.abs(F.col("Quantity")),
            "_price": _to_four_decimals(F.col("UnitPrice")),
            "_delta": delta,
        }
    )


def _key_hash() -> Column:
    return F.xxhash64(*_KEY)


def hot_pair_keys(keyed: DataFrame, hot_rows: int) -> DataFrame | None:
    """The pair keys with more than hot_rows rows, exactly counted: `_key` (a hash) and `_rows`; None if there are none.

    Rows are counted by groups of keys first, which combine before they are shuffled. Only keys of groups with more
    than hot_rows rows can have as many, so single keys are counted in those alone, and mostly there are none.
    """
    hashed = keyed.where(F.col("_delta") != 0).select(_key_hash().alias("_key"))
    grouped = hashed.withColumn("_group", F.pmod("_key", F.lit(KEY_GROUPS)))
    sums = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    large = stored(sums.select("_group"), "key-groups")
    if not large.head(1):
        return None
    counts = grouped.join(large, "_group", "left_semi").groupBy("_key")
    return counts.agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)


def pair_returns(lines: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Add PairedInvoiceNo: the sale a return undoes, null for every other row."""
    # Written once, so that the lines are cleaned once for the counts and the pairs.
    keyed = stored(_with_pair_key(lines), "keyed-lines")
    found = hot_pair_keys(keyed, hot_rows)
    hot = None if found is None else stored(found, "hot-keys")
    rows = None if hot is None else hot.agg(F.sum("_rows")).first()[0]
    if rows is None:
        return _pair_by_key(keyed)
    # The hot keys are at most rows / hot_rows; Spark broadcasts them below its threshold and
    # splits skew above it.
    marked = keyed.withColumn("_key", F.when(F.col("_delta") != 0, _key_hash())).join(
        hot.select("_key", F.lit(True).alias("_hot")), "_key", "left"
    )
    flagged = stored(marked.drop("_key"), "keyed-lines")
    cold = _pair_by_key(flagged.where("_hot IS NULL").drop("_hot"))
    return cold.unionByName(_pair_by_block(flagged.where("_hot").drop("_hot"), -(-rows // hot_rows)))


def _level(depth: Column, before: Column) -> Column:
    """Nesting level of a row: after a sale, before a return; null where nothing is open."""
    return F.when(F.col("_delta") > 0, depth).when((F.col("_delta") < 0) & (before > 0), before)


def _match(previous: Column) -> Column:
    return F.when((F.col("_delta") < 0) & F.col("_level").isNotNull(), previous)


def _pair_by_key(keyed: DataFrame) -> DataFrame:
    """One shuffle on the key; both windows and all running sums reuse it.

    Sales take along only what decides a pair, other rows nothing. Many rows are shuffled in shares of the keys.
    """
    names = [name for name in keyed.columns if name not in _HELPERS]
    own = [*_TIME, "InvoiceNo"]
    whole = F.struct(*[name for name in names if name not in (*_KEY, *own)])
    moved = keyed.where("_delta <> 0").select(*_KEY, *own, "_delta", F.when(F.col("_delta") < 0, whole).alias("_row"))
    kept = keyed.where("_delta >= 0").select(*names, F.lit(None).cast("string").alias("PairedInvoiceNo"))
    cells = [F.col(name) if name in (*_KEY, *own) else F.col("_row")[name].alias(name) for name in names]
    if moved.count() <= SHARED_ROWS:
        return kept.unionByName(_paired(moved).select(*cells, "PairedInvoiceNo"))
    for number in range(KEY_SHARES):
        share = moved.where(F.pmod(_key_hash(), F.lit(KEY_SHARES)) == number)
        kept = kept.unionByName(stored(_paired(share).select(*cells, "PairedInvoiceNo"), "paired-returns"))
    return kept


def _paired(moved: DataFrame) -> DataFrame:
    """The returns among whole keys, with the sale that each undoes."""
    ordered = Window.partitionBy(*_KEY).orderBy(*_TIME)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nested = Window.partitionBy(*_KEY, "_level").orderBy(*_TIME)
    return (
        moved.withColumn("_sum", F.sum("_delta").over(running))
        .withColumn("_low", F.least(F.lit(0), F.min("_sum").over(running)))
        .withColumn("_depth", F.col("_sum") - F.col("_low"))
        .withColumn("_before", F.lag("_depth", 1, 0).over(ordered))
        .withColumn("_level", _level(F.col("_depth"), F.col("_before")))
        .withColumn("PairedInvoiceNo", _match(F.lag("InvoiceNo").over(nested)))
        .where("_delta < 0")
    )


def _pair_by_block(hot: DataFrame, blocks: int) -> DataFrame:
    """Match rows of large keys block by block, then across block edges.

    A block is a stretch of as many rows of a range partition as there are per block on the whole; a partition holds many blocks if they are
    small, so tasks grow with the rows and not with the blocks. The partitions are written out before
    blocks are used, so their numbers stay the same however often a lost task is run again.
    """
    rows = hot.count()
    size, parts = -(-rows // blocks), max(1, min(blocks, -(-rows // PARTITION_ROWS)))
    ranged = hot.repartitionByRange(parts, *_KEY, *_TIME).sortWithinPartitions(*_KEY, *_TIME)
    # The number of a row in its partition is in the low bits, that of the partition in the high ones.
    number = F.monotonically_increasing_id()
    place = number.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    block = (number - place) + F.floor(place / F.lit(size)).cast("bigint")
    ranged = written(ranged.withColumn("_block", block), "pair-blocks")
    group = [*_KEY, "_block"]
    ordered = Window.partitionBy(*group).orderBy(*_TIME)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_sum", F.sum("_delta").over(running)).withColumn(
        "_low", F.min("_sum").over(running)
    )

    # One row per key and block: at most hot keys + blocks rows, whatever the data size.
    earlier = Window.partitionBy(*_KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        local.groupBy(*group)
        .agg(F.sum("_delta").alias("_total"), F.min("_sum").alias("_block_low"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_reached", F.col("_offset") + F.col("_block_low"))
        .withColumn("_floor", F.least(F.lit(0), F.min("_reached").over(earlier)))
        .select(*group, "_offset", "_floor")
    )

    levelled = (
        local.join(F.broadcast(edges), group)
        .withColumn("_sum", F.col("_offset") + F.col("_sum"))
        .withColumn("_low", F.least(F.col("_floor"), F.col("_offset") + F.col("_low")))
        .withColumn("_depth", F.col("_sum") - F.col("_low"))
        .withColumn(
            "_before",
            F.coalesce(F.lag("_depth").over(ordered), F.col("_offset") - F.col("_floor")),
        )
        .withColumn("_level", _level(F.col("_depth"), F.col("_before")))
    )

    # Inside a block each level alternates, so only the first return and the last sale of a
    # (key, level, block) can belong to another block.
    nested = Window.partitionBy(*group, "_level").orderBy(*_TIME)
    inside = (
        levelled.withColumn("_inner", _match(F.lag("InvoiceNo").over(nested)))
        .withColumn("_last", F.lead("_delta").over(nested).isNull())
        .withColumn(
            "_open",
            F.col("_level").isNotNull()
            & (
                ((F.col("_delta") < 0) & F.col("_inner").isNull())
                | ((F.col("_delta") > 0) & F.col("_last"))
            ),
        )
        .withColumn("_alone", F.when(~F.col("_open"), F.col(ORD)))
    )
    across = Window.partitionBy(*_KEY, "_level", "_alone").orderBy(*_TIME)
    return inside.withColumn(
        "PairedInvoiceNo",
        F.coalesce(
            F.col("_inner"), F.when(F.col("_open"), _match(F.lag("InvoiceNo").over(across)))
        ),
    ).drop(
        *_HELPERS, "_block", "_sum", "_low", "_depth", "_before", "_level", "_offset", "_floor",
        "_inner", "_last", "_open",
    )
