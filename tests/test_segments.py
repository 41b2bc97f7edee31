import datetime
import random

import pytest

from basketline.errors import AccessError, AnalyticsError
from basketline.operators import charts, segments
from tests.frames import CLEAN, empty_lines, line

END = datetime.datetime(2024, 12, 1)


def synthetic(spark, customers=40, seed=7):
    draw = random.Random(seed)
    rows = []
    for customer in range(customers):
        for invoice in range(draw.randint(3, 8)):
            when = END - datetime.timedelta(days=draw.randint(0, 300))
            rows.append(
                line(f"{customer}-{invoice}", f"c{customer:03}", when, draw.randint(1, 9),
                     round(draw.uniform(2, 50), 2))
            )
    return spark.createDataFrame(rows, CLEAN)


def test_recency_ladder(spark):
    lines = [line(f"{n}", f"c{n:02}", END - datetime.timedelta(days=n)) for n in range(1, 16)]
    rfm = segments.rfm_table(spark.createDataFrame(lines, CLEAN))
    recency = [row["recency"] for row in rfm.orderBy("CustomerID").collect()]
    assert recency == list(range(15))


def test_recency_counts_whole_days(spark):
    lines = [
        line("1", "late", datetime.datetime(2024, 1, 2, 1)),
        line("2", "early", datetime.datetime(2024, 1, 1, 23)),
    ]
    rfm = segments.rfm_table(spark.createDataFrame(lines, CLEAN))
    assert {row["recency"] for row in rfm.collect()} == {0}


def test_frequency_and_monetary(spark):
    lines = [
        line("1", "c", END, 1, 40.0), line("1", "c", END, 1, 40.0), line("2", "c", END, 1, 20.0),
        line("C2", "c", END, -1, 30.0), line("A1", "c", END, 1, 999.0, IsAdjustment=True),
        line("C9", "only returns", END, -1, 5.0),
    ]
    rows = segments.rfm_table(spark.createDataFrame(lines, CLEAN)).collect()
    assert [(row["CustomerID"], row["frequency"], row["monetary"]) for row in rows] == [
        ("c", 2, 70.0)
    ]


def test_segments(spark):
    lines = synthetic(spark)
    found = segments.rfm_segments(lines, threshold=1)
    rows = found.table.orderBy("CustomerID").collect()
    assert found.table.columns == [
        "CustomerID", "recency", "frequency", "monetary", "cluster", "stability_score",
        "stability_holdout_size", "stability_threshold", "stability_flag", "stability_reason",
    ]
    assert len(rows) == 40 and {row["cluster"] for row in rows} <= {0, 1, 2, 3}
    first = rows[0]
    assert -1 <= first["stability_score"] <= 1 and first["stability_holdout_size"] == 4
    assert first["stability_flag"] == (first["stability_score"] >= 0.7)
    assert len({row["stability_score"] for row in rows}) == 1
    assert first["stability_reason"] == ""
    again = segments.rfm_segments(lines, threshold=1).table.orderBy("CustomerID").collect()
    assert [row["cluster"] for row in again] == [row["cluster"] for row in rows]


def test_small_clusters_are_left_out(spark):
    found = segments.rfm_segments(synthetic(spark), threshold=11, starts=2)
    sizes = {row["cluster"]: row["count"] for row in found.sizes.collect()}
    kept = {row["cluster"]: row["count"] for row in found.table.groupBy("cluster").count().collect()}
    assert kept == {cluster: size for cluster, size in sizes.items() if size >= 11}
    assert found.details["clusters_suppressed"] == len(sizes) - len(kept)
    denied = {row["resource"] for row in segments.cluster_events(found, threshold=11).collect()}
    assert denied == {f"rfm_cluster_{cluster}" for cluster in set(sizes) - set(kept)}


def test_early_exits(spark):
    few = segments.rfm_segments(synthetic(spark, 5))
    assert few.table.count() == 0 and len(few.table.columns) == 10
    assert few.details["suppressed_reason"] == "too_few_customers"
    assert segments.rfm_segments(empty_lines(spark)).table.count() == 0
    with pytest.raises(AnalyticsError):
        segments.rfm_segments(synthetic(spark, 12), k=1)
    with pytest.raises(AnalyticsError, match="too few"):
        segments.rfm_segments(synthetic(spark, 12), k=12)
    with pytest.raises(AccessError):
        segments.rfm_segments(synthetic(spark, 12), threshold=0)
    same = [line(f"{n}", f"c{n:02}", END) for n in range(12)]
    one = segments.rfm_segments(spark.createDataFrame(same, CLEAN), starts=1)
    assert one.details["suppressed_reason"] == "degenerate_single_cluster"
    assert {row["stability_reason"] for row in one.table.collect()} == {
        "degenerate_single_cluster"
    }


def test_holdout_too_large(spark):
    found = segments.rfm_segments(synthetic(spark, 11), holdout_fraction=0.95, threshold=1, starts=1)
    row = found.table.first()
    assert row["stability_score"] is None and row["stability_holdout_size"] == 0
    assert row["stability_reason"] == "insufficient_customers_for_holdout"
    text = charts.rfm_scatter(found.table).explanation.first()["formula"]
    assert "too few customers to hold some out" in text


def test_adjusted_rand(spark):
    rows = [(n, n % 3, (n % 3 + 1) % 3, n % 2) for n in range(30)]
    frame = spark.createDataFrame(rows, "id int, a int, same int, other int")
    assert segments.adjusted_rand(frame, "a", "same") == 1.0
    assert abs(segments.adjusted_rand(frame, "a", "other")) < 0.1


def test_squared_silhouette(spark):
    points = spark.createDataFrame(
        [([0.0], 0), ([1.0], 0), ([10.0], 1), ([11.0], 1)], "scaled array<double>, c int"
    ).withColumn("features", segments.array_to_vector("scaled"))
    # Mean squared distances to the other cluster: 110.5 for the outer points, 90.5 for the inner.
    expected = ((110.5 - 1) / 110.5 + (90.5 - 1) / 90.5) / 2
    assert segments.silhouette_squared(points, "c") == pytest.approx(expected)
