"""Session helpers: where lineage is cut and where intermediate tables are written."""

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_notes: ContextVar[tuple[list[str], ...]] = ContextVar("notes", default=())


def shared_folder(spark: SparkSession) -> str:
    """Return the folder named by spark.checkpoint.dir; on a local master without one, a folder in the warehouse."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/basketline"
    context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """Return a fresh path for an intermediate table of this application in the shared folder."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    For when the results that were made from them are stored; they hold plain customer ids and
    texts. Frames that still read them fail afterwards.
    """
    delete_folders(spark, [_application_folder(spark)])


def delete_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders or files, wherever Spark stores them; those that are gone already are no error."""
    for name in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The folders of the intermediate tables that are written in here, in order."""
    folders: list[str] = []
    token = _notes.set((*_notes.get(), folders))
    try:
        yield folders
    finally:
        _notes.reset(token)


def unread_tables(frame: DataFrame, folders: Iterable[str]) -> list[str]:
    """Those of the folders of intermediate tables that the frame reads nothing of."""
    read = {file.rsplit("/", 2)[-2] for file in frame.inputFiles()}
    return [folder for folder in folders if folder.rsplit("/", 1)[-1] not in read]


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffles of each write in here as soon as it is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the frame as a Parquet table in the shared folder and continue from the table.

    For large intermediate results: later passes read only the columns they need, and a lost
    executor never causes the steps before to run again.
    """
    path = scratch_path(frame.sparkSession, name)
    for folders in _notes.get():
        folders.append(path)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """As `written`, for tables that hold all lines: packed closer, and without the shuffles that led to them."""
    with shuffles_deleted(frame.sparkSession):
        return written(frame, name, compression="zstd")


def materialize(frame: DataFrame) -> DataFrame:
    """Checkpoint the frame: for small results whose row order within partitions matters."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the cleaning plans rely on; safe to call repeatedly.

    Invoice times have no zone. Text is parsed by way of zoned timestamps, so the session zone
    is pinned to one without daylight saving, where every wall-clock time exists.

    HotSpot does not compile methods above 8000 bytes, so larger generated methods are better
    left to the per-operator code, which is split into small functions.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark
