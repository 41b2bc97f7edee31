"""From source files to the newest snapshot."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketline.operators.cleaning import clean, pairing_counters, value_counters
from basketline.operators.privacy import pseudonymize_column
from basketline.session import delete_folders, noted_tables, unread_tables
from basketline.sources.intake import ingest
from basketline.sources.snapshots import latest_snapshot, list_snapshots, write_snapshot


def build_snapshot(
    raw: DataFrame, folder: str, key: bytes, snapshot_id: str | None = None, spent: list[str] | None = None
) -> dict[str, object]:
    """Clean, pseudonymize and store raw lines; the counters are observed while writing.

    spent: folders of intermediate tables that nothing else reads. Those that the cleaned lines do not come from
    are deleted before they are stored.
    """
    seen = Observation("cleaning")
    counters = {**pairing_counters(), **value_counters()}
    cleaned = clean(raw)
    delete_folders(raw.sparkSession, unread_tables(cleaned, spent or []))
    cleaned = cleaned.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        *[column.alias(name) for name, column in counters.items()],
    )
    written = write_snapshot(pseudonymize_column(cleaned, key), folder, key, snapshot_id)
    return {**written, "counters": seen.get}


def ensure_snapshot(
    spark: SparkSession, source: str | list[str], folder: str, key: bytes, keep_source: bool = True
) -> str:
    """Return the newest snapshot id, building a snapshot from the source if there is none.

    Intermediate tables are deleted once nothing reads them any more; they hold plain ids. So is the source, as soon
    as it has been read whole, if it is not to be kept.
    """
    if list_snapshots(spark, folder):
        return latest_snapshot(spark, folder)
    with noted_tables() as tables:
        try:
            raw = ingest(spark, source)
            if not keep_source:
                delete_folders(spark, [source] if isinstance(source, str) else source)
            return str(build_snapshot(raw, folder, key, spent=tables)["snapshot_id"])
        finally:
            delete_folders(spark, tables)
