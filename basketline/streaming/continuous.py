"""Cleaning of files as they arrive.

The row-local stages need no state, so they run on a stream as they do on a table. Pairing of
returns looks across all lines and stays a batch step over the stored result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline import schema
from basketline.operators.cleaning import ROW_LOCAL_STAGES, clean


def stream_raw_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Raw lines from delimited files that keep arriving in a folder."""
    lines = (
        spark.readStream.schema(schema.RAW_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )
    return lines.select(
        *[F.nullif(F.col(name), F.lit("")).alias(name) for name in schema.RAW_COLUMNS]
    )


def stream_clean_lines(raw: DataFrame, target: str, checkpoint: str):
    """Append cleaned lines to a Parquet folder; each arriving file is processed exactly once."""
    return (
        clean(raw, ROW_LOCAL_STAGES)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
