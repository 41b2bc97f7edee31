"""Row conditions used by every metric; a null flag counts as false."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def is_counted() -> Column:
    """Not an adjustment line."""
    return ~flag("IsAdjustment")


def is_sale() -> Column:
    return is_counted() & ~flag("IsReturn")


def is_refund() -> Column:
    return is_counted() & flag("IsReturn")


def exact(value: Column) -> Column:
    """A money value as a decimal, whose sums do not depend on the order of addition."""
    return value.cast("decimal(38,6)")


def total(value: Column) -> Column:
    """Exact sum that gives zero for a group without values."""
    return F.coalesce(F.sum(exact(value)).cast("double"), F.lit(0.0))


def money(value: Column) -> Column:
    """Round to cents, ties to even."""
    return F.bround(value, 2)
