"""Row filters and option lists of the dashboard."""

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _require(lines: DataFrame, column: str, filter_name: str) -> None:
    if column not in lines.columns:
        raise ValueError(f"cannot filter by {filter_name}: no column {column}")


def filter_dates(
    lines: DataFrame, start: datetime.date | None = None, end: datetime.date | None = None
) -> DataFrame:
    """Keep lines from the start day to the end day, both whole. Undated lines fail."""
    if start is None and end is None:
        return lines
    _require(lines, "InvoiceDate", "date")
    if start is not None:
        lines = lines.where(F.col("InvoiceDate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        after = end + datetime.timedelta(days=1)
        lines = lines.where(F.col("InvoiceDate") < F.lit(after).cast("timestamp_ntz"))
    return lines


def filter_values(
    lines: DataFrame, column: str, values: Iterable[str] | None, filter_name: str
) -> DataFrame:
    """Keep lines whose column is one of the non-empty values; no values means no filter."""
    wanted = [value for value in (values or ()) if value]
    if not wanted:
        return lines
    _require(lines, column, filter_name)
    return lines.where(F.col(column).cast("string").isin(*wanted))


def filter_members(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Keep lines of the customers in a membership table (one CustomerID column is read)."""
    _require(lines, "CustomerID", "segment")
    return lines.join(members.select("CustomerID"), "CustomerID", "left_semi")


def cluster_members(segments: DataFrame, clusters: Iterable[int]) -> DataFrame:
    """Customers of the chosen clusters."""
    return segments.where(F.col("cluster").isin(*clusters)).select("CustomerID")


def filter_lines(
    lines: DataFrame,
    start: datetime.date | None = None,
    end: datetime.date | None = None,
    countries: Iterable[str] | None = None,
    stock_codes: Iterable[str] | None = None,
    segments: Iterable[str] | DataFrame | None = None,
) -> DataFrame:
    """Apply all filter axes. `segments` is a list of customer ids or a membership table."""
    kept = filter_dates(lines, start, end)
    kept = filter_values(kept, "Country", countries, "country")
    kept = filter_values(kept, "StockCode", stock_codes, "stock_code")
    if isinstance(segments, DataFrame):
        return filter_members(kept, segments)
    return filter_values(kept, "CustomerID", segments, "segment")


def country_options(lines: DataFrame) -> DataFrame:
    """Distinct countries in order."""
    if "Country" not in lines.columns:
        return lines.sparkSession.createDataFrame([], "Country string")
    return lines.where("Country is not null").select("Country").distinct().orderBy("Country")


def stock_code_options(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct stock codes in order; a short filter list may ask for the first ones only."""
    if "StockCode" not in lines.columns:
        return lines.sparkSession.createDataFrame([], "StockCode string")
    codes = lines.where("StockCode is not null").select("StockCode").distinct()
    codes = codes.orderBy("StockCode")
    return codes if limit is None else codes.limit(limit)


def date_bounds(lines: DataFrame) -> DataFrame:
    """One row with the first and last invoice day, null if no line is dated."""
    return lines.agg(
        F.to_date(F.min("InvoiceDate")).alias("first_day"),
        F.to_date(F.max("InvoiceDate")).alias("last_day"),
    )
