import datetime

import pytest

from basketline.errors import AnalyticsError
from basketline.operators import filters, metrics
from tests.frames import CLEAN, day, empty_lines, line, sample_lines


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def test_revenue_summary(spark):
    row = metrics.revenue_summary(sample_lines(spark)).first().asDict()
    assert row == {
        "gross_revenue": 44.0, "net_revenue": 41.5, "returns_value": -2.5, "orders": 3,
        "aov": 14.67, "line_items": 5, "adjustments": 1,
    }


def test_empty_inputs(spark):
    nothing = empty_lines(spark)
    row = metrics.revenue_summary(nothing).first().asDict()
    assert row["gross_revenue"] == 0.0 and row["aov"] is None and row["orders"] == 0
    assert rows(metrics.top_products(nothing)) == []
    assert rows(metrics.monthly_revenue(nothing)) == []
    assert rows(metrics.weekday_revenue(nothing)) == []
    assert rows(metrics.country_metrics(nothing)) == []
    assert rows(metrics.repeat_rate(nothing)) == [(0, 0, None)]


def test_missing_columns_and_bad_parameters(spark):
    with pytest.raises(AnalyticsError, match="revenue_summary lacks columns: Revenue"):
        metrics.revenue_summary(sample_lines(spark).drop("Revenue"))
    with pytest.raises(AnalyticsError, match="no metric"):
        metrics.require_metric_columns(sample_lines(spark), "profit")
    with pytest.raises(AnalyticsError):
        metrics.top_products(sample_lines(spark), top_n=0)
    with pytest.raises(AnalyticsError):
        metrics.revenue_summary([1])


def test_products(spark):
    found = metrics.product_metrics(sample_lines(spark))
    assert rows(found["top_by_revenue"]) == [
        ("CAKE", "Cake", 24.0, 1), ("LOAF", "Rye loaf", 15.0, 6), ("BUN", "Bun", 5.0, 10),
    ]
    assert [row[0] for row in rows(found["top_by_quantity"])] == ["BUN", "LOAF", "CAKE"]
    assert rows(found["return_rate"]) == [("BUN", 0.0), ("CAKE", 0.0), ("LOAF", 1 / 6)]
    assert len(rows(metrics.top_products(sample_lines(spark), top_n=1))) == 1


def test_first_description_in_source_order(spark):
    when = day("2024-01-01")
    frame = spark.createDataFrame(
        [
            line("1", "c", when, Description=None, ord=1),
            line("2", "c", when, Description="", ord=2),
            line("3", "c", when, Description="second", ord=4),
            line("4", "c", when, Description="first", ord=3),
            line("5", "c", when, quantity=-1, Description="of a return", ord=0),
            line("6", "c", when, StockCode="B", Description=None, ord=5),
            line("7", "c", when, quantity=-1, StockCode="only returned", ord=6),
        ],
        CLEAN,
    )
    found = {row["StockCode"]: row["Description"] for row in metrics.top_products(frame).collect()}
    assert found == {"LOAF": "first", "B": ""}


def test_time_series(spark):
    monthly = rows(metrics.monthly_revenue(sample_lines(spark)))
    assert [row[0].isoformat() for row in monthly] == ["2025-05-01", "2025-06-01"]
    assert [row[1:] for row in monthly] == [(15.0, 1), (26.5, 2)]
    weekday = rows(metrics.weekday_revenue(sample_lines(spark)))
    assert [row[0] for row in weekday] == list(range(7))
    assert [row[1] for row in weekday] == [24.0, 15.0, 0.0, 0.0, -2.5, 5.0, 0.0]


def test_countries(spark):
    assert rows(metrics.country_metrics(sample_lines(spark))) == [
        ("Norway", 36.5, 2), ("Chile", 5.0, 1),
    ]


def test_repeat_rate(spark):
    assert rows(metrics.repeat_rate(sample_lines(spark))) == [(2, 1, 0.5)]


def test_filters(spark):
    lines = sample_lines(spark)
    start, end = datetime.date(2025, 6, 14), datetime.date(2025, 6, 20)
    assert filters.filter_lines(lines, start=start, end=end).count() == 3
    assert filters.filter_lines(lines, countries=["", "Chile"]).count() == 1
    assert filters.filter_lines(lines, countries=[]).count() == 6
    assert filters.filter_lines(lines, stock_codes=["LOAF"]).count() == 3
    assert filters.filter_lines(lines, segments=["k2"]).count() == 1
    members = lines.where("CustomerID = 'k1'").select("CustomerID").distinct()
    assert filters.filter_lines(lines, segments=members).count() == 4
    with pytest.raises(ValueError, match="InvoiceDate"):
        filters.filter_lines(lines.drop("InvoiceDate"), start=start)
    with pytest.raises(ValueError, match="CustomerID"):
        filters.filter_lines(lines.drop("CustomerID"), segments=["k1"])


def test_options(spark):
    lines = sample_lines(spark)
    assert [row[0] for row in filters.country_options(lines).collect()] == ["Chile", "Norway"]
    assert rows(filters.stock_code_options(lines, 2)) == [("BUN",), ("CAKE",)]
    assert filters.stock_code_options(lines).count() == 4
    assert rows(filters.date_bounds(lines)) == [
        (datetime.date(2025, 5, 6), datetime.date(2025, 6, 21))
    ]
    assert rows(filters.date_bounds(empty_lines(spark))) == [(None, None)]
    assert filters.country_options(lines.drop("Country")).count() == 0


def test_date_filter_reaches_the_scan(spark, small, tmp_path):
    from basketline.sources.tables import typed_lines

    path = str(tmp_path / "lines")
    typed_lines(spark, small).write.parquet(path)
    kept = filters.filter_lines(spark.read.parquet(path), start=datetime.date(1996, 1, 1))
    plan = metrics.country_metrics(kept)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(InvoiceDate" in plan
    assert "Description" not in plan.split("ReadSchema:")[1]
