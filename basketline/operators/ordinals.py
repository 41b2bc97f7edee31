"""Exact 1..n row numbers without a global window."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.session import written

_POSITION_BITS = 33


def with_ordinals(
    frame: DataFrame, order_by: list[str | Column], name: str = "id", start: int = 1
) -> DataFrame:
    """Number all rows in the given order, from `start`.

    Rows are range-partitioned and sorted, so every partition holds one stretch of the order.
    They are written once with their partition and position; the counts before each partition
    (one small row per partition) then turn positions into numbers. `order_by` should be unique.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    placed = written(
        frame.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumns({"_part": F.spark_partition_id(), "_position": position}),
        "ordinals",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_position") + F.lit(start))
        .drop("_part", "_position", "_offset")
    )
