"""Handmade frames with hand-computed results."""

import datetime

RAW = (
    "InvoiceNo string, StockCode string, Description string, Quantity string, "
    "InvoiceDate string, UnitPrice string, CustomerID string, Country string, ord long"
)
CLEAN = (
    "InvoiceNo string, StockCode string, Description string, Quantity long, "
    "InvoiceDate timestamp_ntz, UnitPrice double, CustomerID string, Country string, "
    "IsReturn boolean, IsAdjustment boolean, Revenue double, ord long"
)


def raw_frame(spark, rows):
    """Raw lines; each row overrides fields of an ordinary line."""
    plain = {
        "InvoiceNo": "7001", "StockCode": "LOAF", "Description": "Rye loaf", "Quantity": "4",
        "InvoiceDate": "5/6/2025 7:40", "UnitPrice": "2.50", "CustomerID": "311",
        "Country": "Norway",
    }
    data = [(*{**plain, **row}.values(), number) for number, row in enumerate(rows, start=1)]
    return spark.createDataFrame(data, RAW)


def day(text):
    return datetime.datetime.fromisoformat(text)


def sample_lines(spark):
    """Three orders of a bakery, one loaf brought back, and a fee without a customer."""
    rows = [
        ("7001", "LOAF", "Rye loaf", 4, day("2025-05-06"), 2.5, "k1", "Norway", False, False, 10.0, 1),
        ("7001", "BUN", "Bun", 10, day("2025-05-06"), 0.5, "k1", "Norway", False, False, 5.0, 2),
        ("7002", "LOAF", "Rye loaf", 2, day("2025-06-14"), 2.5, "k2", "Chile", False, False, 5.0, 3),
        ("7003", "CAKE", "Cake", 1, day("2025-06-16"), 24.0, "k1", "Norway", False, False, 24.0, 4),
        ("C7004", "LOAF", "Rye loaf", -1, day("2025-06-20"), 2.5, "k1", "Norway", True, False, -2.5, 5),
        ("A7005", "FEE", "", 1, day("2025-06-21"), 9.0, None, "Norway", False, True, 9.0, 6),
    ]
    return spark.createDataFrame(rows, CLEAN)


def empty_lines(spark):
    return spark.createDataFrame([], CLEAN)


def line(invoice, customer, when, quantity=1, price=10.0, **other):
    """One cleaned line as a tuple for CLEAN."""
    values = {
        "InvoiceNo": invoice, "StockCode": "LOAF", "Description": "x", "Quantity": quantity,
        "InvoiceDate": when, "UnitPrice": price, "CustomerID": customer, "Country": "Norway",
        "IsReturn": quantity < 0, "IsAdjustment": False, "Revenue": quantity * price, "ord": 0,
    }
    return tuple({**values, **other}.values())
