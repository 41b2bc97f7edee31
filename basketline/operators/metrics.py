"""KPI metrics over cleaned lines. Each is one pass of partial aggregates.

Adjustment lines are left out everywhere. Sales rank products and count orders; returns net
against revenue. Distinct counts group by (key, invoice) first, so a large key is spread over
all tasks before its counts come together.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline import schema
from basketline.errors import AnalyticsError
from basketline.functions.conditions import exact, is_counted, is_refund, is_sale, money, total
from basketline.schema import ORD


def require_metric_columns(frame: DataFrame, metric: str) -> None:
    """Raise unless the frame has the columns the metric reads."""
    if not isinstance(frame, DataFrame):
        raise AnalyticsError("metrics need a Spark DataFrame")
    if metric not in schema.METRIC_COLUMNS:
        raise AnalyticsError(f"no metric named {metric!r}")
    missing = sorted(schema.METRIC_COLUMNS[metric] - set(frame.columns))
    if missing:
        raise AnalyticsError(f"{metric} lacks columns: {', '.join(missing)}")


def revenue_summary(lines: DataFrame) -> DataFrame:
    """One row: gross, net and returned revenue, orders, average order value, line counts."""
    require_metric_columns(lines, "revenue_summary")
    sums = lines.agg(
        total(F.when(is_sale(), F.col("Revenue"))).alias("gross"),
        total(F.when(is_refund(), F.col("Revenue"))).alias("refunded"),
        F.count_distinct(F.when(is_sale(), F.col("InvoiceNo"))).alias("orders"),
        F.count_if(is_counted()).alias("line_items"),
        F.count_if(~is_counted()).alias("adjustments"),
    )
    return sums.select(
        money(F.col("gross")).alias("gross_revenue"),
        money(F.col("gross") + F.col("refunded")).alias("net_revenue"),
        money(F.col("refunded")).alias("returns_value"),
        "orders",
        money(F.try_divide(F.col("gross"), F.col("orders"))).alias("aov"),
        "line_items",
        "adjustments",
    )


def product_totals(lines: DataFrame) -> DataFrame:
    """Sold revenue, sold and returned units, and first description of every sold product.

    Grouping by (code, description) first keeps all buffers fixed-width; what is left for the
    second grouping is a few rows per product. The source order `ord` tells which comes first;
    in a view without it, it is the first by name.
    """
    require_metric_columns(lines, "product_metrics")
    order = F.col(ORD) if ORD in lines.columns else F.lit(0)
    sale, units = is_sale(), F.col("Quantity")
    spelled = (
        lines.where(is_counted() & F.col("StockCode").isNotNull())
        .withColumn("_order", F.when(sale, order))
        .groupBy("StockCode", "Description")
        .agg(
            F.sum(F.when(sale, exact(F.col("Revenue")))).alias("revenue"),
            F.sum(F.when(sale, units)).alias("sold"),
            F.sum(F.when(is_refund(), units)).alias("returned"),
            F.count_if(sale).alias("sales"),
            F.min("_order").alias("first_seen"),
        )
    )
    named = (F.col("Description") != "") & (F.col("sales") > 0)
    return (
        spelled.groupBy("StockCode")
        .agg(
            F.min(F.when(named, F.struct("first_seen", "Description"))).alias("first"),
            total(F.col("revenue")).alias("Revenue"),
            F.coalesce(F.sum("sold"), F.lit(0)).alias("Quantity"),
            F.coalesce(F.sum("returned"), F.lit(0)).alias("Returned"),
            F.sum("sales").alias("sales"),
        )
        .where(F.col("sales") > 0)
        .select(
            "StockCode",
            F.coalesce("first.Description", F.lit("")).alias("Description"),
            "Revenue",
            "Quantity",
            "Returned",
        )
    )


def top_products(lines: DataFrame, by: str = "Revenue", top_n: int = schema.DEFAULT_TOP_N):
    """The top_n products by Revenue or Quantity, ties by stock code."""
    if top_n <= 0:
        raise AnalyticsError("top_n must be above zero")
    return (
        product_totals(lines)
        .select("StockCode", "Description", "Revenue", "Quantity")
        .orderBy(F.desc(by), F.asc("StockCode"))
        .limit(top_n)
    )


def return_rates(lines: DataFrame) -> DataFrame:
    """Returned units over sold units for every sold product; null where nothing was sold."""
    rate = F.abs(F.col("Returned")).cast("double") / F.col("Quantity")
    return (
        product_totals(lines)
        .select("StockCode", F.when(F.col("Quantity") > 0, rate).alias("return_rate"))
        .orderBy("StockCode")
    )


def product_metrics(lines: DataFrame, top_n: int = schema.DEFAULT_TOP_N) -> dict[str, DataFrame]:
    """Both rankings and the return rates."""
    return {
        "top_by_revenue": top_products(lines, "Revenue", top_n),
        "top_by_quantity": top_products(lines, "Quantity", top_n),
        "return_rate": return_rates(lines),
    }


def monthly_revenue(lines: DataFrame) -> DataFrame:
    """Net revenue and sale invoices per calendar month that has lines."""
    require_metric_columns(lines, "time_series")
    return (
        lines.where(is_counted() & F.col("InvoiceDate").isNotNull())
        .groupBy(F.trunc("InvoiceDate", "month").alias("month"))
        .agg(
            money(total(F.col("Revenue"))).alias("revenue"),
            F.count_distinct(F.when(is_sale(), F.col("InvoiceNo"))).alias("orders"),
        )
        .orderBy("month")
    )


def weekday_revenue(lines: DataFrame) -> DataFrame:
    """Net revenue per weekday, Monday is 0. All seven days appear if any line is dated."""
    require_metric_columns(lines, "time_series")
    day = F.weekday("InvoiceDate")
    dated = lines.where(is_counted() & F.col("InvoiceDate").isNotNull())
    sums = dated.agg(
        F.count(F.lit(1)).alias("lines"),
        *[total(F.when(day == n, F.col("Revenue"))).alias(f"day{n}") for n in range(7)],
    )
    days = [
        F.struct(F.lit(n).cast("bigint").alias("weekday"), money(F.col(f"day{n}")).alias("revenue"))
        for n in range(7)
    ]
    return sums.where(F.col("lines") > 0).select(F.inline(F.array(*days))).orderBy("weekday")


def time_series(lines: DataFrame) -> dict[str, DataFrame]:
    """The monthly and the weekday table."""
    return {"monthly": monthly_revenue(lines), "weekday": weekday_revenue(lines)}


def dated_totals(lines: DataFrame, unit: str) -> DataFrame:
    """Exact partial sums per month or weekday, with a row for undated lines: enough for a time chart and its
    explanation in one pass. Months also count their sale invoices."""
    require_metric_columns(lines, "time_series")
    place = F.trunc("InvoiceDate", "month") if unit == "month" else F.weekday("InvoiceDate").cast("bigint")
    sums = [
        F.count_if(is_counted()).alias("lines"),
        F.count_if(~is_counted()).alias("adjustments"),
        F.sum(exact(F.when(is_counted(), F.col("Revenue")))).alias("revenue"),
        F.sum(exact(F.when(is_refund(), F.col("Revenue")))).alias("refunded"),
    ]
    if unit == "month":
        sums.append(F.count_distinct(F.when(is_sale(), F.col("InvoiceNo"))).alias("orders"))
    return lines.groupBy(place.alias(unit)).agg(*sums)


def revenue_of_totals(totals: DataFrame, unit: str) -> DataFrame:
    """The monthly or weekday table from its partial sums; all seven days appear if any line is dated."""
    revenue = money(F.coalesce(F.col("revenue").cast("double"), F.lit(0.0))).alias("revenue")
    dated = totals.where(F.col(unit).isNotNull() & (F.col("lines") > 0))
    if unit == "month":
        return dated.select("month", revenue, "orders").orderBy("month")
    days = dated.agg(F.count(F.lit(1)).alias("days")).where("days > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint"))).alias("weekday"))
    return days.join(dated, "weekday", "left").select("weekday", revenue).orderBy("weekday")


def exclusions_of_totals(totals: DataFrame) -> DataFrame:
    """One row: adjustments and the value of returns, undated lines included."""
    return totals.agg(
        F.coalesce(F.sum("adjustments"), F.lit(0)).alias("adjustments"),
        money(F.coalesce(F.sum("refunded").cast("double"), F.lit(0.0))).alias("returns_value"),
    )


def country_metrics(lines: DataFrame) -> DataFrame:
    """Net revenue and sale invoices per country, highest revenue first."""
    require_metric_columns(lines, "country_metrics")
    return (
        lines.where(is_counted() & F.col("Country").isNotNull())
        .groupBy("Country")
        .agg(
            money(total(F.col("Revenue"))).alias("revenue"),
            F.count_distinct(F.when(is_sale(), F.col("InvoiceNo"))).alias("orders"),
        )
        .orderBy(F.desc("revenue"), F.asc("Country"))
    )


def sale_customers(lines: DataFrame) -> DataFrame:
    """One row, in one pass: customers with a sale, repeat customers, their share, and sale invoices without a customer."""
    require_metric_columns(lines, "repeat_rate")
    per_customer = lines.where(is_sale()).groupBy("CustomerID").agg(F.count_distinct("InvoiceNo").alias("orders"))
    known = F.col("CustomerID").isNotNull()
    counts = per_customer.agg(
        F.count_if(known).alias("customers"),
        F.count_if(known & (F.col("orders") >= 2)).alias("repeat_customers"),
        F.coalesce(F.max(F.when(~known, F.col("orders"))), F.lit(0)).alias("unidentified_orders"),
    )
    share = F.try_divide(F.col("repeat_customers"), F.col("customers"))
    return counts.withColumn("repeat_rate", F.bround(share, 4))


def repeat_rate(lines: DataFrame) -> DataFrame:
    """One row: customers with a sale, those with two or more sale invoices, and their share."""
    require_metric_columns(lines, "repeat_rate")
    per_customer = (
        lines.where(is_sale() & F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(F.count_distinct("InvoiceNo").alias("orders"))
    )
    counts = per_customer.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("orders") >= 2).alias("repeat_customers"),
    )
    share = F.try_divide(F.col("repeat_customers"), F.col("customers"))
    return counts.withColumn("repeat_rate", F.bround(share, 4))


def unidentified_orders(lines: DataFrame) -> DataFrame:
    """One row: sale invoices without a customer id, left out of the repeat rate."""
    return lines.where(is_sale() & F.col("CustomerID").isNull()).agg(
        F.count_distinct("InvoiceNo").alias("unidentified_orders")
    )
