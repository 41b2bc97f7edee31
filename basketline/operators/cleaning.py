"""Cleaning stages: text to typed columns, invoice tags, revenue, product flag, and counters.

Every stage is a DataFrame -> DataFrame function, so a custom pipeline is a tuple of such
functions. All of them are row-local except the pairing of returns, which shuffles once.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline import schema
from basketline.errors import CleaningError
from basketline.functions import text
from basketline.operators.pairing import pair_returns

Stage = Callable[[DataFrame], DataFrame]

_CONVERSIONS = {
    "Quantity": text.to_whole_number,
    "UnitPrice": text.to_finite_number,
    "CustomerID": text.to_customer_id,
    "InvoiceDate": text.to_timestamp_any,
}
_COUNTER_NAMES = {
    "Quantity": "quantity",
    "UnitPrice": "unit_price",
    "CustomerID": "customer_id",
    "InvoiceDate": "invoice_date",
}


def require_raw_columns(frame: DataFrame) -> None:
    """Raise unless every raw column is present exactly once; other columns may pass."""
    if not isinstance(frame, DataFrame):
        raise CleaningError("cleaning needs a Spark DataFrame")
    names = frame.columns
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise CleaningError(f"duplicate columns: {', '.join(repeated)}")
    missing = [name for name in schema.RAW_COLUMNS if name not in names]
    if missing:
        raise CleaningError(f"missing columns: {', '.join(missing)}")


def coerce_types(raw: DataFrame) -> DataFrame:
    """Convert the eight text columns to typed ones; unusable text becomes null."""
    tidy = {name: text.normalized(F.col(name)) for name in schema.RAW_COLUMNS}
    # One short expression of the cell itself: the filter on it moves down to the source.
    tidy["CustomerID"] = F.col("CustomerID")
    return raw.withColumns(tidy).withColumns(
        {name: convert(F.col(name)) for name, convert in _CONVERSIONS.items()}
    )


def drop_unidentified(lines: DataFrame) -> DataFrame:
    """Keep rows that have a customer id."""
    return lines.where(F.col("CustomerID").isNotNull())


def tag_invoices(lines: DataFrame) -> DataFrame:
    """Flag cancellations, adjustments, and returns (negative lines that are no adjustment)."""
    number = F.col("InvoiceNo")
    plain = text.starts_between(number, "0", "9")  # as nearly all do; neither kind starts so

    def tagged(pattern: str) -> F.Column:
        return F.when(plain, F.lit(False)).otherwise(F.coalesce(number.rlike(pattern), F.lit(False)))

    cancellation, adjustment = tagged(schema.CANCELLATION_PATTERN), tagged(schema.ADJUSTMENT_PATTERN)
    negative = F.coalesce(F.col("Quantity") < 0, F.lit(False))
    return lines.withColumns(
        {
            "IsCancellation": cancellation,
            "IsAdjustment": adjustment,
        }
    ).withColumn("IsReturn", negative & ~F.col("IsAdjustment"))


def derive_revenue(lines: DataFrame) -> DataFrame:
    """Quantity times unit price."""
    return lines.withColumn("Revenue", F.col("Quantity").cast("double") * F.col("UnitPrice"))


def tag_non_products(
    lines: DataFrame, codes: Sequence[str] = schema.NON_PRODUCT_CODES
) -> DataFrame:
    """Flag charges and manual adjustments; the rows stay."""
    return lines.withColumn(
        "IsNonProduct", F.coalesce(F.col("StockCode"), F.lit("")).isin(*codes)
    )


# The stages of a metric that does not look at PairedInvoiceNo: no shuffle at all.
ROW_LOCAL_STAGES: tuple[Stage, ...] = (
    coerce_types,
    drop_unidentified,
    tag_invoices,
    derive_revenue,
    tag_non_products,
)
DEFAULT_STAGES: tuple[Stage, ...] = (
    coerce_types,
    drop_unidentified,
    tag_invoices,
    pair_returns,
    derive_revenue,
    tag_non_products,
)


def clean(raw: DataFrame, stages: Sequence[Stage] | None = None) -> DataFrame:
    """Run the stages in order. An empty sequence runs none."""
    require_raw_columns(raw)
    frame = raw
    for stage in DEFAULT_STAGES if stages is None else stages:
        frame = frame.transform(stage)
    return frame


def _count(condition) -> F.Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def coercion_counters() -> dict[str, F.Column]:
    """Aggregates over a raw frame: empty and unusable cells per converted column."""
    counters = {}
    for name, convert in _CONVERSIONS.items():
        cell = text.normalized(F.col(name))
        label = _COUNTER_NAMES[name]
        counters[f"{label}_missing"] = F.count_if(cell.isNull())
        counters[f"{label}_uncoerced"] = F.count_if(cell.isNotNull() & convert(cell).isNull())
    return counters


def pairing_counters() -> dict[str, F.Column]:
    """Aggregates over a paired frame: tags, matches, and rows that could not take part."""
    cancellation, adjustment = F.col("IsCancellation"), F.col("IsAdjustment")
    refund, paired = F.col("IsReturn"), F.col("PairedInvoiceNo").isNotNull()
    undated = F.col("InvoiceDate").isNull()
    keyless = (
        F.col("CustomerID").isNull()
        | F.col("StockCode").isNull()
        | F.col("InvoiceNo").isNull()
        | F.col("UnitPrice").isNull()
        | F.coalesce(F.col("Quantity") == 0, F.lit(True))
    )
    plain_sale = ~refund & ~cancellation & ~adjustment
    return {
        "cancellations": _count(cancellation),
        "adjustments": _count(adjustment),
        "returns": _count(refund),
        "paired_cancellations": _count(cancellation & paired),
        "unpaired_cancellations": _count(cancellation & ~paired),
        "paired_returns": _count(refund & paired),
        "unpaired_returns": _count(refund & ~paired),
        "pairing_ineligible_returns": _count(refund & (undated | keyless)),
        "pairing_ineligible_originals": _count(
            plain_sale & (undated | (keyless & (F.col("Quantity") > 0)))
        ),
        "cancellations_without_negative_quantity": _count(
            cancellation & ~F.coalesce(F.col("Quantity") < 0, F.lit(False))
        ),
    }


def value_counters() -> dict[str, F.Column]:
    """Aggregates over a finished frame: revenue signs and non-product lines."""
    return {
        "negative_revenue_rows": _count(F.col("Revenue") < 0),
        "zero_revenue_rows": _count(F.col("Revenue") == 0),
        "non_product_rows": _count(F.col("IsNonProduct")),
    }


_STAGE_OF = {
    "negative_revenue_rows": "revenue_derivation",
    "zero_revenue_rows": "revenue_derivation",
    "non_product_rows": "non_product_tagging",
}


def stage_metrics(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Quality report of a cleaning run as rows of (stage, metric, value).

    One aggregation runs over the raw rows and one over the cleaned rows; each gives one row.
    """
    before = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        *[column.alias(name) for name, column in coercion_counters().items()],
    )
    after = cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            column.alias(name)
            for name, column in {**pairing_counters(), **value_counters()}.items()
        ],
    )

    def entry(stage: str, metric: str, value: F.Column) -> F.Column:
        return F.struct(
            F.lit(stage).alias("stage"), F.lit(metric).alias("metric"), value.alias("value")
        )

    first = [
        entry("type_coercion", "rows_in", F.col("rows")),
        entry("type_coercion", "rows_out", F.col("rows")),
        *[entry("type_coercion", name, F.col(name)) for name in coercion_counters()],
        entry("null_customer_drop", "rows_in", F.col("rows")),
        entry(
            "null_customer_drop",
            "customer_id_rows_dropped",
            F.col("customer_id_missing") + F.col("customer_id_uncoerced"),
        ),
    ]
    second = [entry("null_customer_drop", "rows_out", F.col("rows"))]
    for stage in ("cancellation_tagging", "revenue_derivation", "non_product_tagging"):
        second.append(entry(stage, "rows_in", F.col("rows")))
        second.append(entry(stage, "rows_out", F.col("rows")))
    for name in (*pairing_counters(), *value_counters()):
        second.append(entry(_STAGE_OF.get(name, "cancellation_tagging"), name, F.col(name)))

    return before.select(F.inline(F.array(*first))).unionByName(
        after.select(F.inline(F.array(*second)))
    )
