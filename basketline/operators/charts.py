"""Chart-ready datasets, each with an explanation: formula, filters, exclusions, row count."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline import schema
from basketline.errors import VisualizationError
from basketline.functions.crypto import canonical_json, lookup
from basketline.operators import metrics
from basketline.session import written

STABILITY_COLUMNS = (
    "stability_score",
    "stability_holdout_size",
    "stability_threshold",
    "stability_flag",
    "stability_reason",
)


@dataclass(frozen=True)
class Chart:
    """The rows to draw, and one row that explains them."""

    kind: str
    data: DataFrame
    explanation: DataFrame


def require_columns(frame: DataFrame, columns: set[str], source: str) -> None:
    if not isinstance(frame, DataFrame):
        raise VisualizationError(f"{source} must be a Spark DataFrame")
    missing = sorted(columns - set(frame.columns))
    if missing:
        raise VisualizationError(f"{source} is missing columns: {', '.join(missing)}")


def _explain(
    counts: DataFrame,
    kind: str,
    formula: str | Column,
    filters: dict[str, str],
    exclusions: dict[str, Column],
    row_count: Column,
) -> DataFrame:
    """Turn a one-row frame of counts into the explanation row."""
    text = F.lit(formula) if isinstance(formula, str) else formula
    return counts.select(
        F.lit(kind).alias("kind"),
        text.alias("formula"),
        canonical_json({name: F.lit(value) for name, value in filters.items()}).alias("filters"),
        (canonical_json(exclusions) if exclusions else F.lit("{}")).alias("exclusions"),
        row_count.cast("bigint").alias("row_count"),
    )


def _revenue_exclusions(summary: DataFrame | None) -> tuple[dict[str, Column], DataFrame | None]:
    if summary is None:
        return {}, None
    require_columns(summary, {"adjustments", "returns_value"}, "revenue summary")
    return {
        "adjustments": F.col("adjustments"),
        "returns_value": F.bround("returns_value", 0).cast("bigint"),
    }, summary.select("adjustments", "returns_value")


def _with_summary(counts: DataFrame, summary: DataFrame | None) -> DataFrame:
    """Put the two one-row frames side by side."""
    if summary is None:
        return counts
    return counts.withColumns(
        {name: summary.select(name).scalar() for name in ("adjustments", "returns_value")}
    )


def revenue_by_month(monthly: DataFrame, summary: DataFrame | None = None) -> Chart:
    """Line of net revenue per month."""
    require_columns(monthly, {"month", "revenue", "orders"}, "monthly table")
    exclusions, summary = _revenue_exclusions(summary)
    counts = _with_summary(monthly.agg(F.count(F.lit(1)).alias("n")), summary)
    explanation = _explain(
        counts,
        "revenue_by_month",
        "Net revenue of a month: Revenue of all lines but adjustments, returns subtracted.",
        {"lines": "all dated lines but adjustments", "returns": "subtract from the month of their date"},
        exclusions,
        F.col("n"),
    )
    return Chart("revenue_by_month", monthly, explanation)


def revenue_by_weekday(weekday: DataFrame, summary: DataFrame | None = None) -> Chart:
    """Bars of net revenue per weekday, with day names."""
    require_columns(weekday, {"weekday", "revenue"}, "weekday table")
    exclusions, summary = _revenue_exclusions(summary)
    names = F.array(*[F.lit(day) for day in schema.WEEKDAYS])
    labelled = weekday.withColumn("day", F.get(names, F.col("weekday").cast("int")))
    counts = _with_summary(weekday.agg(F.count(F.lit(1)).alias("n")), summary)
    explanation = _explain(
        counts,
        "revenue_by_weekday",
        "Net revenue of a weekday: Revenue of all lines but adjustments, returns subtracted.",
        {"lines": "all dated lines but adjustments", "returns": "subtract from the weekday of their date"},
        exclusions,
        F.col("n"),
    )
    return Chart("revenue_by_weekday", labelled, explanation)


def top_products_bar(ranking: DataFrame, metric: str = "revenue") -> Chart:
    """Horizontal bars of a product ranking, smallest first so the largest is on top."""
    if metric not in ("revenue", "quantity"):
        raise VisualizationError(f"no product ranking by {metric!r}")
    value = metric.capitalize()
    require_columns(ranking, {"StockCode", value}, "product ranking")
    explanation = _explain(
        ranking.agg(F.count(F.lit(1)).alias("n")),
        "top_products_bar",
        f"Products ranked by {metric} of their sale lines; returns and adjustments do not count.",
        {"lines": "sale lines only"},
        {},
        F.col("n"),
    )
    return Chart(
        "top_products_bar", ranking.orderBy(F.asc(value), F.desc("StockCode")), explanation
    )


def country_bar(countries: DataFrame, max_bars: int = schema.MAX_COUNTRY_BARS) -> Chart:
    """Bars of the countries with most revenue; the others are counted as hidden."""
    require_columns(countries, {"Country", "revenue", "orders"}, "country table")
    top = countries.orderBy(F.desc("revenue"), F.asc("Country")).limit(max_bars)
    counts = countries.agg(F.count(F.lit(1)).alias("n"))
    explanation = _explain(
        counts,
        "country_bar",
        "Net revenue of a country: Revenue of its lines but adjustments, returns subtracted. "
        "Lines without a country do not count.",
        {"lines": "lines with a country, but no adjustments", "returns": "subtract from their country"},
        {"lower_ranked_countries": F.greatest(F.col("n") - max_bars, F.lit(0))},
        F.least(F.col("n"), F.lit(max_bars)),
    )
    return Chart("country_bar", top.orderBy(F.asc("revenue"), F.desc("Country")), explanation)


def repeat_rate_gauge(repeat: DataFrame, unidentified: DataFrame | None = None) -> Chart:
    """Share of repeat customers in percent; no customers show as zero."""
    require_columns(repeat, {"customers", "repeat_customers", "repeat_rate"}, "repeat rate")
    percent = F.bround(F.coalesce("repeat_rate", F.lit(0.0)) * 100, 2)
    guests = (
        F.lit(0) if unidentified is None else unidentified.select("unidentified_orders").scalar()
    )
    explanation = _explain(
        repeat.withColumn("guests", guests),
        "repeat_rate_gauge",
        "Share of identified customers with at least two sale invoices.",
        {"invoices": "sale invoices", "customers": "those with an id"},
        {"unidentified_customers": F.col("guests")},
        F.col("customers"),
    )
    return Chart("repeat_rate_gauge", repeat.select(percent.alias("percent")), explanation)


def _stability_sentence() -> Column:
    """Wording of the stability check; `n` is the number of segmented customers."""
    skipped = lookup(
        {
            "too_few_customers": "Stability was not checked: too few identified customers.",
            "degenerate_single_cluster": "Stability was not checked: only one cluster was found.",
            "insufficient_customers_for_holdout":
                "Stability was not checked: too few customers to hold some out.",
        },
        F.col("stability_reason"),
    )
    adjective = F.when(F.col("stability_flag"), "stable").otherwise("unstable")
    return (
        F.when(F.col("n") == 0, "Stability was not checked: no customers were segmented.")
        .when(
            F.col("stability_score").isNotNull(),
            F.format_string(
                "Adjusted Rand index %.2f against a refit without %d customers (%s).",
                F.col("stability_score"), F.col("stability_holdout_size"), adjective,
            ),
        )
        .otherwise(F.coalesce(skipped, F.lit("Stability was not checked for this result.")))
    )


def rfm_scatter(segments: DataFrame, suppressed: int = 0) -> Chart:
    """Recency against monetary value, sized by frequency, coloured by cluster."""
    require_columns(
        segments,
        {"CustomerID", "recency", "frequency", "monetary", "cluster", *STABILITY_COLUMNS},
        "segment table",
    )
    counts = segments.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("cluster").alias("clusters"),
        *[F.any_value(name, True).alias(name) for name in STABILITY_COLUMNS],
    )
    explanation = _explain(
        counts,
        "rfm_scatter",
        F.concat_ws(
            " ",
            F.lit("Customers grouped by recency, frequency and monetary value."),
            _stability_sentence(),
        ),
        {"customers": "those with an id and a dated sale", "monetary": "sales less returns, no adjustments"},
        {
            "small_group_clusters": F.lit(suppressed),
            "clusters_rendered": F.col("clusters"),
            "stability_score": F.col("stability_score"),
            "stability_flag": F.col("stability_flag"),
            "stability_holdout_size": F.col("stability_holdout_size"),
            "stability_reason": F.nullif(F.col("stability_reason"), F.lit("")),
        },
        F.col("n"),
    )
    points = segments.select("CustomerID", "recency", "frequency", "monetary", "cluster")
    return Chart("rfm_scatter", points, explanation)


def chart_from_lines(kind: str, lines: DataFrame) -> Chart:
    """A metric chart straight from cleaned lines.

    The lines are read once, here: a row per month, weekday, country or ranked product is written, and both the data
    and the explanation come from it. The repeat rate counts guests, so it takes lines that still have those without a
    customer id.
    """
    if kind in ("revenue_by_month", "revenue_by_weekday"):
        unit, draw = ("month", revenue_by_month) if kind == "revenue_by_month" else ("weekday", revenue_by_weekday)
        totals = written(metrics.dated_totals(lines, unit), "chart")
        return draw(metrics.revenue_of_totals(totals, unit), metrics.exclusions_of_totals(totals))
    if kind == "top_products_bar":
        return top_products_bar(written(metrics.top_products(lines), "chart"))
    if kind == "country_bar":
        return country_bar(written(metrics.country_metrics(lines), "chart"))
    if kind == "repeat_rate_gauge":
        counts = written(metrics.sale_customers(lines), "chart")
        return repeat_rate_gauge(counts, counts)
    raise VisualizationError(f"unknown chart: {kind!r}")
