"""Customer pseudonyms, role checks, access decisions, and suppression of small groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline import schema
from basketline.errors import AccessError, PseudonymizationError, StorageError
from basketline.functions.crypto import canonical_json, hmac_sha256, lookup


def pseudonymize_column(
    frame: DataFrame,
    key: bytes,
    column: str = "CustomerID",
    output_column: str | None = None,
    drop_source: bool = False,
) -> DataFrame:
    """Write keyed pseudonyms of a column; nulls stay null."""
    if not isinstance(key, (bytes, bytearray)) or not key:
        raise ValueError("a non-empty bytes key is needed")
    if column not in frame.columns:
        raise PseudonymizationError(f"no column {column!r} to pseudonymize")
    target = output_column or column
    result = frame.withColumn(target, hmac_sha256(frame.sparkSession, bytes(key), F.col(column)))
    return result.drop(column) if drop_source and target != column else result


def pseudonymize_customers(frame: DataFrame, hex_key: str) -> DataFrame:
    """Replace customer ids, with the key given as hex text (decoded once, here)."""
    return pseudonymize_column(frame, bytes.fromhex(hex_key))


def check(role: str, minimum: str) -> bool:
    """Whether a role ranks at least as high as the minimum."""
    for name in (role, minimum):
        if name not in schema.ROLE_RANK:
            raise AccessError(f"unknown role: {name!r}")
    return schema.ROLE_RANK[role] >= schema.ROLE_RANK[minimum]


def authorize(role: str, view: str, sink=None) -> tuple[bool, str]:
    """Decide one request: (allowed, reason). The decision goes to the audit sink, if there is one."""
    if view not in schema.VIEW_MINIMUM_ROLE:
        raise AccessError(f"unknown view: {view!r}")
    minimum = schema.VIEW_MINIMUM_ROLE[view]
    allowed = check(role, minimum)
    reason = "role_ok" if allowed else "role_insufficient"
    if sink is not None:
        action, outcome = ("protected_store_read", "success") if allowed else ("access_denied", "failure")
        details = {"actor_role": role, "minimum_role": minimum, "reason": reason}
        sink.put_one(action, view, details, outcome)
    return allowed, reason


def decide_access(requests: DataFrame) -> DataFrame:
    """Decide every row of (role, view): adds minimum_role, allowed and reason.

    The policy is a handful of constants, so it is part of the expression and nothing shuffles.
    Rows with an unknown role or view get a null decision and the reason says which.
    """
    minimum = lookup(schema.VIEW_MINIMUM_ROLE, F.col("view"))
    rank = lookup(schema.ROLE_RANK, F.col("role"))
    needed = lookup(
        {view: schema.ROLE_RANK[role] for view, role in schema.VIEW_MINIMUM_ROLE.items()},
        F.col("view"),
    )
    return requests.withColumns({"minimum_role": minimum, "allowed": rank >= needed}).withColumn(
        "reason",
        F.when(minimum.isNull(), "unknown_view")
        .when(rank.isNull(), "unknown_role")
        .when(F.col("allowed"), "role_ok")
        .otherwise("role_insufficient"),
    )


def access_events(decisions: DataFrame) -> DataFrame:
    """One audit event per decided request; needs timestamp and actor columns too."""
    known = decisions.where(F.col("allowed").isNotNull())
    return known.withColumns(
        {
            "action": F.when(F.col("allowed"), "protected_store_read").otherwise("access_denied"),
            "outcome": F.when(F.col("allowed"), "success").otherwise("failure"),
            "resource": F.col("view"),
            "details_json": canonical_json(
                {
                    "actor_role": F.col("role"),
                    "minimum_role": F.col("minimum_role"),
                    "reason": F.col("reason"),
                }
            ),
        }
    )


def scoped_columns(columns: list[str], role: str, view: str) -> list[str]:
    """Columns of a frame that a role may see in a view, in frame order."""
    if view not in schema.VIEW_COLUMNS:
        raise StorageError(f"unknown view: {view!r}")
    if role not in schema.ROLE_COLUMNS:
        raise AccessError(f"unknown role: {role!r}")
    limits = [schema.ROLE_COLUMNS[role], schema.VIEW_COLUMNS[view]]
    return [name for name in columns if all(limit is None or name in limit for limit in limits)]


def scope_view(frame: DataFrame, role: str, view: str) -> DataFrame:
    """Authorize the role on the view and select the columns it may see."""
    allowed, _ = authorize(role, view)
    if not allowed:
        raise StorageError(f"view {view!r} is closed to role {role!r}")
    return frame.select(*scoped_columns(frame.columns, role, view))


def check_threshold(threshold: int) -> None:
    if threshold <= 0:
        raise AccessError(f"group threshold {threshold} is not above zero")


def enforce_small_group(size: int, threshold: int = schema.SMALL_GROUP_THRESHOLD) -> bool:
    """Whether one group is large enough to be shown."""
    check_threshold(threshold)
    if size < 0:
        raise AccessError(f"group size {size} is below zero")
    return size >= threshold


def group_sizes(
    frame: DataFrame, groups: list[str], threshold: int = schema.SMALL_GROUP_THRESHOLD
) -> DataFrame:
    """Distinct customers per group and whether the group may be shown."""
    check_threshold(threshold)
    return (
        frame.groupBy(*groups)
        .agg(F.count_distinct("CustomerID").alias("cohort_size"))
        .withColumn("allowed", F.col("cohort_size") >= threshold)
    )


def suppress_small_groups(
    frame: DataFrame,
    groups: list[str],
    threshold: int = schema.SMALL_GROUP_THRESHOLD,
    sink=None,
) -> DataFrame:
    """Drop the rows of groups with fewer distinct customers than the threshold.

    Each group that is dropped goes to the audit sink, if there is one, by its values.
    """
    sizes = group_sizes(frame, groups, threshold)
    if sink is not None:
        label = F.concat_ws("_", *[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in groups])
        sink.put(suppression_events(sizes, label, sink.role, threshold))
    return frame.join(sizes.where("allowed").select(*groups), groups, "left_semi")


def suppression_events(
    sizes: DataFrame, label: F.Column, role: str, threshold: int = schema.SMALL_GROUP_THRESHOLD
) -> DataFrame:
    """Audit events for the groups that were not shown."""
    return sizes.where(~F.col("allowed")).select(
        F.lit("access_denied").alias("action"),
        F.lit("failure").alias("outcome"),
        label.alias("resource"),
        canonical_json(
            {
                "actor_role": F.lit(role),
                "reason": F.lit("small_group_suppressed"),
                "cohort_size": F.col("cohort_size"),
                "threshold": F.lit(threshold),
            }
        ).alias("details_json"),
    )
