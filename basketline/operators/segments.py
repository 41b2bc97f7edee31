"""Customer segments: recency, frequency and monetary value, K-Means, silhouette, stability."""

from dataclasses import dataclass

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline import schema
from basketline.errors import AnalyticsError
from basketline.functions.conditions import is_counted, is_sale, total
from basketline.operators import kmeans
from basketline.operators.metrics import require_metric_columns
from basketline.operators.ordinals import with_ordinals
from basketline.operators.privacy import check_threshold, suppression_events
from basketline.operators.silhouette import silhouette_euclidean
from basketline.session import written

AXES = ("recency", "frequency", "monetary")


def customer_totals(lines: DataFrame) -> DataFrame:
    """Last sale, sale invoices and net revenue of every customer with a dated sale."""
    require_metric_columns(lines, "rfm_segments")
    sale = is_sale()
    return (
        lines.where(
            is_counted() & F.col("CustomerID").isNotNull() & F.col("InvoiceDate").isNotNull()
        )
        .groupBy("CustomerID")
        .agg(
            F.max(F.when(sale, F.col("InvoiceDate"))).alias("last_sale"),
            F.count_distinct(F.when(sale, F.col("InvoiceNo"))).alias("frequency"),
            total(F.col("Revenue")).alias("monetary"),
        )
        .where(F.col("last_sale").isNotNull() & (F.abs("monetary") < float("inf")))
    )


def rfm_table(lines: DataFrame) -> DataFrame:
    """Recency in whole days since the last sale, frequency, and monetary value per customer.

    The per-customer totals are written once; the reference date and everything later read them
    and not the lines.
    """
    totals = written(customer_totals(lines), "customer-totals")
    newest = totals.agg(F.max("last_sale")).scalar()
    days = F.floor(F.timestamp_diff("SECOND", F.col("last_sale"), newest) / F.lit(86400))
    return totals.select(
        "CustomerID", days.cast("bigint").alias("recency"), "frequency", "monetary"
    )


def standardize(rfm: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Add `scaled`: each axis with zero mean and unit population variance (zero if constant)."""
    statistics = []
    for axis in axes:
        value = F.col(axis).cast("double")
        statistics += [F.avg(value).alias(f"{axis}_mean"), F.stddev_pop(value).alias(f"{axis}_std")]
    row = rfm.agg(*statistics).first()
    scaled = [
        (F.col(axis).cast("double") - F.lit(row[f"{axis}_mean"]))
        / F.lit(row[f"{axis}_std"] or 1.0)
        for axis in axes
    ]
    return rfm.withColumn("scaled", F.array(*scaled))


def adjusted_rand(frame: DataFrame, first: str, second: str) -> float:
    """Adjusted Rand index of two labelings, from their contingency table."""
    cells = frame.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    return cells.transform(lambda t: rand_index(t, first, second)).first()["adjusted_rand"]


def rand_index(cells: DataFrame, first: str, second: str) -> DataFrame:
    """One row with the adjusted Rand index, from cell counts `n`."""

    def pairs(count: Column) -> Column:
        return F.sum(count.cast("double") * (count - 1) / 2)

    grouped = cells.groupBy(first).agg(F.sum("n").alias("n"))
    other = cells.groupBy(second).agg(F.sum("n").alias("n"))
    tagged = (
        cells.select(F.lit("cell").alias("part"), "n")
        .unionByName(grouped.select(F.lit("first").alias("part"), "n"))
        .unionByName(other.select(F.lit("second").alias("part"), "n"))
    )
    n = F.col("n")
    sums = tagged.agg(
        pairs(F.when(F.col("part") == "cell", n)).alias("both"),
        pairs(F.when(F.col("part") == "first", n)).alias("a"),
        pairs(F.when(F.col("part") == "second", n)).alias("b"),
        F.sum(F.when(F.col("part") == "cell", n)).alias("rows"),
    )
    every = F.col("rows").cast("double") * (F.col("rows") - 1) / 2
    expected = F.try_divide(F.col("a") * F.col("b"), every)
    most = (F.col("a") + F.col("b")) / 2
    score = F.when(most == expected, F.lit(1.0)).otherwise(
        (F.col("both") - expected) / (most - expected)
    )
    return sums.select(score.alias("adjusted_rand"))


def silhouette_squared(points: DataFrame, label: str) -> float:
    """Mean silhouette under squared Euclidean distance; one pass over cluster moments."""
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol=label)
    return evaluator.evaluate(points.withColumn(label, F.col(label).cast("int")))


@dataclass(frozen=True)
class Segmentation:
    """Segment table plus the figures that go to the audit log."""

    table: DataFrame
    sizes: DataFrame
    details: dict[str, object]


def cluster_events(
    found: Segmentation, role: str = "pipeline", threshold: int = schema.SMALL_GROUP_THRESHOLD
) -> DataFrame:
    """Audit events of the clusters that were left out."""
    sizes = found.sizes.withColumnRenamed("count", "cohort_size")
    label = F.concat(F.lit("rfm_cluster_"), F.col("cluster").cast("string"))
    return suppression_events(sizes, label, role, threshold)


def _with_stability(
    table: DataFrame, score: float | None, holdout: int, threshold: float, reason: str
) -> DataFrame:
    flag = None if score is None else score >= threshold
    return table.select(
        "CustomerID", *AXES, "cluster",
        F.lit(score).cast("double").alias("stability_score"),
        F.lit(holdout).cast("bigint").alias("stability_holdout_size"),
        F.lit(threshold).cast("double").alias("stability_threshold"),
        F.lit(flag).cast("boolean").alias("stability_flag"),
        F.lit(reason).alias("stability_reason"),
    )


def _details(customers: int, score: float | None, holdout: int, threshold: float, **more):
    return {
        "customers": customers,
        "stability_score": None if score is None else round(score, 4),
        "stability_holdout_size": holdout,
        "stability_flag": None if score is None else score >= threshold,
        **more,
    }


def _holdout(customers: int, k: int, fraction: float) -> int:
    """Customers to hold out of the refit, 0 if too few would be left on either side."""
    holdout = round(customers * fraction)
    train = customers - holdout
    if holdout < schema.MIN_HOLDOUT or train < schema.MIN_CUSTOMERS or train <= k:
        return 0
    return holdout


def rfm_segments(
    lines: DataFrame,
    k: int = schema.DEFAULT_CLUSTERS,
    threshold: int = schema.SMALL_GROUP_THRESHOLD,
    holdout_fraction: float = schema.HOLDOUT_FRACTION,
    stability_threshold: float = schema.STABILITY_THRESHOLD,
    starts: int = schema.KMEANS_STARTS,
    sink=None,
) -> Segmentation:
    """Cluster customers, check stability, and leave out clusters below the group threshold.

    The figures, and each cluster that is left out, go to the audit sink, if there is one; only then the
    Euclidean silhouette is among them, as it takes longer than the rest.
    """
    found = _segmented(
        lines, k, threshold, holdout_fraction, stability_threshold, starts, sink is not None
    )
    if sink is not None:
        sink.put(cluster_events(found, sink.role, threshold))
        sink.put_one("protected_store_read", "rfm_segments", found.details)
    return found


def _segmented(
    lines: DataFrame,
    k: int,
    threshold: int,
    holdout_fraction: float,
    stability_threshold: float,
    starts: int,
    euclidean: bool,
) -> Segmentation:
    require_metric_columns(lines, "rfm_segments")
    if k < 2:
        raise AnalyticsError("k must be at least 2")
    check_threshold(threshold)
    rfm = rfm_table(lines)
    customers = rfm.count()
    if customers < schema.MIN_CUSTOMERS:
        reason = "too_few_customers"
        empty = rfm.limit(0).withColumn("cluster", F.lit(None).cast("bigint"))
        return Segmentation(
            _with_stability(empty, None, 0, stability_threshold, reason),
            empty.groupBy("cluster").count().withColumn("allowed", F.col("count") >= threshold),
            _details(customers, None, 0, stability_threshold, suppressed_reason=reason,
                     stability_reason=reason),
        )
    if k >= customers:
        raise AnalyticsError(f"{customers} customers are too few for k={k}")

    # In a fixed pseudo-random order, whose first part is the sample of the refit.
    digest = F.md5(F.concat_ws("|", "CustomerID", F.lit(str(schema.HOLDOUT_SEED))).cast("binary"))
    placed = with_ordinals(standardize(rfm), [digest, F.col("CustomerID")], name="place")
    dimensions = len(AXES)
    points = written(placed.select("*", *kmeans.whole_numbers(F.col("scaled"), dimensions)), "rfm-points")
    holdout = _holdout(customers, k, holdout_fraction)
    members = [F.lit(True)] + ([F.col("place") <= customers - holdout] if holdout else [])
    centres = kmeans.fit(points, "CustomerID", members, k, starts, schema.KMEANS_SEED, dimensions)
    names = ("cluster", "refit")[: len(centres)]
    labels = {name: kmeans.label(own) for name, own in zip(names, centres, strict=True)}
    features = array_to_vector("scaled")
    labelled = written(points.withColumns(labels), "rfm-labels").withColumn("features", features)
    sizes = labelled.groupBy("cluster").count().withColumn("allowed", F.col("count") >= threshold)
    by_cluster = {row["cluster"]: row["count"] for row in sizes.collect()}  # k rows
    if len(by_cluster) < 2:
        reason = "degenerate_single_cluster"
        return Segmentation(
            _with_stability(labelled, None, 0, stability_threshold, reason),
            sizes,
            _details(customers, None, 0, stability_threshold, k=k, kept_customers=customers,
                     silhouette_squared=None, clusters_suppressed=0, suppressed_reason=reason,
                     stability_reason=reason),
        )

    squared = round(silhouette_squared(labelled, "cluster"), 4)
    more = {}
    if euclidean:
        row = silhouette_euclidean(labelled, "cluster").first()
        more = {name: round(row[name], 4) for name in ("silhouette", "silhouette_bound")}
    score, reason = None, "insufficient_customers_for_holdout"
    if holdout and labelled.select("refit").distinct().count() > 1:
        score, reason = adjusted_rand(labelled, "cluster", "refit"), ""
    kept = sorted(cluster for cluster, size in by_cluster.items() if size >= threshold)
    return Segmentation(
        _with_stability(
            labelled.where(F.col("cluster").isin(*kept)), score, holdout, stability_threshold, reason
        ),
        sizes,
        _details(customers, score, holdout, stability_threshold, k=k,
                 kept_customers=sum(by_cluster[cluster] for cluster in kept),
                 silhouette_squared=squared, **more,
                 clusters_suppressed=len(by_cluster) - len(kept), stability_reason=reason),
    )
