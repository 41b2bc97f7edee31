import json

import pytest

from basketline.errors import VisualizationError
from basketline.operators import charts, metrics
from tests.frames import empty_lines, sample_lines

SEGMENTS = (
    "CustomerID string, recency long, frequency long, monetary double, cluster long, "
    "stability_score double, stability_holdout_size long, stability_threshold double, "
    "stability_flag boolean, stability_reason string"
)


def explained(chart):
    row = chart.explanation.first().asDict()
    return {**row, "exclusions": json.loads(row["exclusions"]), "filters": json.loads(row["filters"])}


def test_month_chart_carries_the_summary(spark):
    lines = sample_lines(spark)
    chart = charts.revenue_by_month(metrics.monthly_revenue(lines), metrics.revenue_summary(lines))
    found = explained(chart)
    assert found["exclusions"] == {"adjustments": 1, "returns_value": -2}
    assert found["row_count"] == 2 and "adjustments" in found["filters"]["lines"]
    assert explained(charts.revenue_by_month(metrics.monthly_revenue(lines)))["exclusions"] == {}


def test_weekday_names(spark):
    chart = charts.chart_from_lines("revenue_by_weekday", sample_lines(spark))
    assert [row["day"] for row in chart.data.collect()][::6] == ["Monday", "Sunday"]


def test_product_bars(spark):
    ranking = metrics.top_products(sample_lines(spark))
    rows = charts.top_products_bar(ranking).data.collect()
    assert [row["StockCode"] for row in rows] == ["BUN", "LOAF", "CAKE"]
    with pytest.raises(VisualizationError, match="no product ranking"):
        charts.top_products_bar(ranking, "profit")


def test_countries_beyond_the_cap_are_counted(spark):
    countries = spark.createDataFrame(
        [(f"N{n:02}", float(n), n) for n in range(21)], "Country string, revenue double, orders int"
    )
    chart = charts.country_bar(countries)
    rows = chart.data.collect()
    assert len(rows) == 15 and rows[0]["revenue"] == 6.0
    assert explained(chart)["exclusions"] == {"lower_ranked_countries": 6}


def test_repeat_gauge(spark):
    chart = charts.chart_from_lines("repeat_rate_gauge", sample_lines(spark))
    assert chart.data.first()["percent"] == 50.0 and explained(chart)["row_count"] == 2
    empty = charts.chart_from_lines("repeat_rate_gauge", empty_lines(spark))
    assert empty.data.first()["percent"] == 0.0


@pytest.mark.parametrize(
    ("score", "flag", "reason", "words"),
    [
        (0.91, True, "", "0.91"), (0.2, False, "", "unstable"),
        (None, None, "too_few_customers", "too few identified"),
        (None, None, "degenerate_single_cluster", "only one cluster"),
        (None, None, "", "not checked for this result"),
    ],
)
def test_stability_sentence(spark, score, flag, reason, words):
    row = ("c", 1, 1, 1.0, 0, score, 3, 0.7, flag, reason)
    found = explained(charts.rfm_scatter(spark.createDataFrame([row], SEGMENTS)))
    assert words in found["formula"] and found["exclusions"]["clusters_rendered"] == 1


def test_empty_segments(spark):
    found = explained(charts.rfm_scatter(spark.createDataFrame([], SEGMENTS)))
    assert "no customers were segmented" in found["formula"] and found["row_count"] == 0


def test_bad_payloads(spark):
    with pytest.raises(VisualizationError, match="missing columns: orders"):
        charts.country_bar(spark.createDataFrame([("a", 1.0)], "Country string, revenue double"))
    with pytest.raises(VisualizationError):
        charts.revenue_by_month({"monthly": 1})
    with pytest.raises(VisualizationError):
        charts.chart_from_lines("pie", sample_lines(spark))


@pytest.mark.parametrize(
    "kind", ["revenue_by_month", "revenue_by_weekday", "top_products_bar", "country_bar", "repeat_rate_gauge"]
)
def test_a_chart_reads_its_lines_once(spark, tmp_path, kind):
    sample_lines(spark).write.parquet(str(tmp_path / "lines"))
    chart = charts.chart_from_lines(kind, spark.read.parquet(str(tmp_path / "lines")))
    for frame in (chart.data, chart.explanation):
        assert "/lines/" not in "".join(frame.inputFiles())
        assert str(tmp_path) not in frame._jdf.queryExecution().executedPlan().toString()
    again = charts.chart_from_lines(kind, empty_lines(spark))
    assert again.explanation.count() == 1


def test_time_charts_from_totals_are_the_metrics(spark):
    lines = sample_lines(spark)
    for unit, expected in (("month", metrics.monthly_revenue), ("weekday", metrics.weekday_revenue)):
        totals = metrics.dated_totals(lines, unit)
        assert metrics.revenue_of_totals(totals, unit).collect() == expected(lines).collect()
        kept = metrics.revenue_summary(lines).select("adjustments", "returns_value").collect()
        assert metrics.exclusions_of_totals(totals).collect() == kept
        empty = metrics.dated_totals(empty_lines(spark), unit)
        assert metrics.revenue_of_totals(empty, unit).collect() == []
    assert metrics.sale_customers(lines).drop("unidentified_orders").collect() == metrics.repeat_rate(lines).collect()
    guests = metrics.sale_customers(lines).select("unidentified_orders").collect()
    assert guests == metrics.unidentified_orders(lines).collect()
