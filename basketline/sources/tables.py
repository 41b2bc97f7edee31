"""Retail invoice lines derived from star-schema tables (lineitem, orders, customer, part, nation).

Every lineitem gives a sale line; one with return flag R gives a second, negative line dated by
its shipping date. The text form exercises the same cleaning as delimited files do.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.operators.cleaning import (
    derive_revenue,
    drop_unidentified,
    tag_invoices,
    tag_non_products,
)
from basketline.schema import ORD, RAW_COLUMNS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined_lines(
    spark: SparkSession, folder: str, part: bool = True, country: bool = True, share: tuple[int, int] | None = None
) -> DataFrame:
    """Line items with their order and, when asked for, part and country; one row per leg.

    A caller that needs no price or no country leaves that join out. Spark picks the join
    strategy: small dimensions are broadcast below its size threshold, large ones are not.
    A share (k, n) is the k-th, from 0, of n sets of about as many orders, which are all lines together.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
        "l_shipdate",
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if share is not None:
        number, shares = share

        def of_share(key: str) -> Column:
            return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(shares)) == number

        lines, orders = lines.where(of_share("l_orderkey")), orders.where(of_share("o_orderkey"))
    if country:
        homes = (
            table(spark, folder, "customer")
            .select("c_custkey", "c_nationkey")
            .join(
                table(spark, folder, "nation").select("n_nationkey", "n_name"),
                F.col("c_nationkey") == F.col("n_nationkey"),
            )
        )
        # Orders get their country before the lines do, as there are fewer of them to move.
        orders = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if part:
        parts = table(spark, folder, "part").select(
            "p_partkey", "p_name", F.col("p_retailprice").cast("decimal(18,2)").alias("p_price")
        )
        joined = joined.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    legs = F.when(F.col("l_returnflag") == "R", F.array(F.lit(0), F.lit(1)))
    return joined.withColumn("leg", F.explode(F.coalesce(legs, F.array(F.lit(0)))))


def _is_return() -> Column:
    return F.col("leg") == 1


def _invoice_no() -> Column:
    prefix = F.when(_is_return(), "C").when(F.col("l_linenumber") == 7, "A").otherwise("")
    return F.concat(prefix, F.col("l_orderkey").cast("string"))


def _stock_code() -> Column:
    code = F.col("l_partkey")
    return F.when(code % 97 == 0, "POST").otherwise(code.cast("string"))


def _quantity() -> Column:
    sold = F.col("l_quantity").cast("bigint")
    return F.when(_is_return(), -sold).otherwise(sold)


def _invoice_date() -> Column:
    return F.when(_is_return(), F.col("l_shipdate")).otherwise(F.col("o_orderdate"))


def _ord() -> Column:
    """Source order: order, line, part, supplier, shipping day and leg as fixed-width text.

    Unique per row: order and line alone are not, nor are they with part and supplier.
    """
    widths = {"l_orderkey": 12, "l_linenumber": 2, "l_partkey": 11, "l_suppkey": 10}
    keys = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in widths.items()]
    return F.concat(*keys, F.date_format("l_shipdate", "yyyyMMdd"), F.col("leg").cast("string"))


def raw_lines(
    spark: SparkSession, folder: str, part: bool = True, country: bool = True, share: tuple[int, int] | None = None
) -> DataFrame:
    """The eight text columns plus the source order."""
    customer = F.col("o_custkey")
    nothing = F.lit(None).cast("string")
    columns: dict[str, Column] = {
        "InvoiceNo": _invoice_no(),
        "StockCode": _stock_code(),
        "Description": F.col("p_name") if part else nothing,
        "Quantity": _quantity().cast("string"),
        "InvoiceDate": F.date_format(_invoice_date(), "M/d/yyyy H:mm"),
        "UnitPrice": F.col("p_price").cast("string") if part else nothing,
        "CustomerID": F.when(customer % 20 == 0, None)
        .when(customer % 20 == 1, F.concat(F.lit("x"), customer.cast("string")))
        .otherwise(customer.cast("string")),
        "Country": F.col("n_name") if country else nothing,
        ORD: _ord(),
    }
    frame = joined_lines(spark, folder, part=part, country=country, share=share)
    return frame.select(*[columns[name].alias(name) for name in (*RAW_COLUMNS, ORD)])


def typed_lines(
    spark: SparkSession, folder: str, part: bool = True, country: bool = True, guests: bool = False
) -> DataFrame:
    """The same lines read straight into typed columns, tagged and with revenue.

    Equal to cleaning `raw_lines`, without the way through text, so filters on dates and keys
    reach the scans. Lines without a usable customer id are dropped by the cleaning stage, unless
    guests are asked for.
    """
    customer = F.col("o_custkey")
    nothing = F.lit(None)
    columns: dict[str, Column] = {
        "InvoiceNo": _invoice_no(),
        "StockCode": _stock_code(),
        "Description": F.col("p_name") if part else nothing.cast("string"),
        "Quantity": _quantity(),
        "InvoiceDate": _invoice_date().cast("timestamp_ntz"),
        "UnitPrice": F.col("p_price").cast("double") if part else nothing.cast("double"),
        "CustomerID": F.when(customer % 20 > 1, customer.cast("string")),
        "Country": F.col("n_name") if country else nothing.cast("string"),
        ORD: _ord(),
    }
    frame = joined_lines(spark, folder, part=part, country=country)
    lines = frame.select(*[columns[name].alias(name) for name in (*RAW_COLUMNS, ORD)])
    if not guests:
        lines = drop_unidentified(lines)
    for stage in (tag_invoices, derive_revenue, tag_non_products):
        lines = lines.transform(stage)
    return lines


def untidy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Text lines in the spellings that files really have, chosen by line number.

    Padding, decimal and exponent forms, other date layouts, unusable numbers and dates, empty
    cells, and descriptions that look like formulas.
    """
    quantity = _quantity().cast("string")
    price = F.col("p_price").cast("string")
    day = _invoice_date()
    customer = F.col("o_custkey").cast("string")
    name = F.col("p_name")

    def by_line(*cells: Column) -> Column:
        chosen = cells[-1]
        for number, cell in enumerate(cells[:-1], start=1):
            chosen = F.when(F.col("l_linenumber") == number, cell).otherwise(chosen)
        return chosen

    def dated(layout: str) -> Column:
        return F.date_format(day, layout)

    def text(value: str) -> Column:
        return F.lit(value)

    columns = {
        "InvoiceNo": _invoice_no(),
        "StockCode": by_line(
            _stock_code(), F.concat(text("\u3000"), _stock_code()), *[_stock_code()] * 5
        ),
        "Description": by_line(
            F.concat(text("="), name), F.concat(text("  @"), name), F.concat(text("-"), name),
            text("-5.5"), F.concat(text("\uff1d"), name), text("   "), name,
        ),
        "Quantity": by_line(
            quantity, F.concat(text("  "), quantity, text("\t")), F.concat(quantity, text(".0")),
            F.concat(quantity, text("e0")), F.concat(quantity, text(".5")), text(""),
            F.concat(quantity, text("d")),
        ),
        "InvoiceDate": by_line(
            dated("M/d/yyyy H:mm"), dated("yyyy-MM-dd HH:mm:ss"), dated("yyyy-MM-dd"),
            dated("dd MMM yyyy"), text("not a date"), F.lit(None).cast("string"),
            dated("d/M/yyyy"),
        ),
        "UnitPrice": by_line(
            price, F.concat(text("\u00a0"), price), F.concat(price, text("f")), text("inf"),
            text("   "), F.concat(text("+"), price), price,
        ),
        "CustomerID": by_line(
            customer, F.concat(customer, text(".0")), F.concat(text(" "), customer, text(" ")),
            F.concat(customer, text(".5")), text("1e3"), customer, customer,
        ),
        "Country": F.col("n_name"),
        ORD: _ord(),
    }
    frame = joined_lines(spark, folder)
    return frame.select(*[columns[name].alias(name) for name in (*RAW_COLUMNS, ORD)])
