"""Immutable encrypted snapshots in Parquet.

Rows are packed into blocks of one Arrow batch; every column of a block is compressed and sealed
on its own with AES-GCM, bound to its snapshot, column and block. A reader therefore decrypts
only the columns it selects, ciphertext costs a few bytes per block and not per cell, and a cell
that was changed or moved fails. A sealed manifest, written last, holds the schema and the
expected rows and blocks, so lost or repeated blocks are noticed too.
"""

import datetime
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketline import schema
from basketline.errors import StorageError
from basketline.functions.crypto import derive_key, secret
from basketline.operators.privacy import authorize, scoped_columns
from basketline.session import shuffles_deleted

_FOLDER_FIELD = "snapshot_id string"


def _binding(snapshot_id: str, name: str, block: Column | None = None) -> Column:
    label = F.lit(f"{snapshot_id}|{name}|")
    return (label if block is None else F.concat(label, block)).cast("binary")


def _seal(value: Column, key: Column, bound: Column) -> Column:
    empty = F.lit("").cast("binary")
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), empty, bound)


def _packer():
    """Batch function that turns each Arrow batch into one row of compressed columns.

    Texts are packed as a dictionary where that is smaller.

    Functions for tasks are made inside a function, so they travel with the plan and executors
    need no installed copy of this package.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def stream(name: str, cells: pa.Array) -> pa.Buffer:
            column = pa.record_batch([cells], names=[name])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, column.schema, options=options) as writer:
                writer.write_batch(column)
            return sink.getvalue()

        for batch in batches:
            if not batch.num_rows:
                continue
            packed = {"_block": [uuid.uuid4().hex], "_rows": [batch.num_rows]}
            for position, name in enumerate(batch.schema.names):
                cells = batch.column(position)
                forms = [stream(name, cells)]
                if pa.types.is_string(cells.type):
                    forms.append(stream(name, cells.dictionary_encode()))
                packed[name] = [min(forms, key=len).to_pybytes()]
            yield pa.RecordBatch.from_pydict(packed)

    return pack


def _unpacker():
    """Batch function that restores the rows of every block."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells = [column[row].as_buffer() for column in batch.columns]
                columns = [pa.ipc.open_stream(c).read_next_batch().column(0) for c in cells]
                columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in columns]
                yield pa.record_batch(columns, names=batch.schema.names)

    return unpack


def new_snapshot_id() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime(schema.SNAPSHOT_ID_FORMAT)


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        fields = f"manifest binary, {_FOLDER_FIELD}"
        return spark.read.schema(fields).parquet(f"{folder}/manifest")
    except AnalysisException:
        return None


def list_snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Ids of complete snapshots, oldest first."""
    manifests = _manifests(spark, folder)
    if manifests is None:
        return []
    ids = manifests.select("snapshot_id").distinct().orderBy("snapshot_id")
    return [row["snapshot_id"] for row in ids.collect()]


def latest_snapshot(spark: SparkSession, folder: str) -> str:
    """Id of the newest snapshot."""
    manifests = _manifests(spark, folder)
    newest = None if manifests is None else manifests.agg(F.max("snapshot_id")).first()[0]
    if newest is None:
        raise StorageError("the store holds no snapshot")
    return newest


def _blocks(spark: SparkSession, folder: str, snapshot_id: str, names: list[str]) -> DataFrame:
    fields = ", ".join(["_block string", "_rows bigint", *[f"`{name}` binary" for name in names]])
    return spark.read.schema(fields).parquet(f"{folder}/data/snapshot_id={snapshot_id}")


def _content(blocks: DataFrame) -> dict[str, int]:
    """Rows, blocks and an order-free digest of the block names."""
    row = blocks.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.bit_xor(F.xxhash64("_block", "_rows")), F.lit(0)).alias("digest"),
    ).first()
    return row.asDict()


def write_snapshot(
    frame: DataFrame, folder: str, key: bytes, snapshot_id: str | None = None, sink=None
) -> dict[str, object]:
    """Write a frame as a sealed snapshot. Returns its id, rows and columns.

    They go to the audit sink, if there is one.
    """
    spark = frame.sparkSession
    snapshot_id = snapshot_id or new_snapshot_id()
    sealing = secret(spark, derive_key(key, schema.SNAPSHOT_KEY_CONTEXT))
    names = frame.columns
    packed = T.StructType(
        [T.StructField("_block", T.StringType()), T.StructField("_rows", T.LongType())]
        + [T.StructField(name, T.BinaryType()) for name in names]
    )
    sealed = frame.mapInArrow(_packer(), packed).select(
        "_block",
        "_rows",
        *[
            _seal(F.col(name), sealing, _binding(snapshot_id, name, F.col("_block"))).alias(name)
            for name in names
        ],
    )
    with shuffles_deleted(spark):
        sealed.write.parquet(f"{folder}/data/snapshot_id={snapshot_id}")

    content = _content(_blocks(spark, folder, snapshot_id, []))
    manifest = json.dumps({"schema": frame.schema.json(), **content})
    spark.range(1).select(
        _seal(
            F.lit(manifest).cast("binary"), sealing, _binding(snapshot_id, "manifest")
        ).alias("manifest")
    ).coalesce(1).write.parquet(f"{folder}/manifest/snapshot_id={snapshot_id}")
    if sink is not None:
        details = {"rows": content["rows"], "columns": len(names)}
        sink.put_one("protected_store_write", snapshot_id, details)
    return {"snapshot_id": snapshot_id, "rows": content["rows"], "columns": len(names)}


def _manifest(spark: SparkSession, folder: str, key: bytes, snapshot_id: str) -> dict:
    manifests = _manifests(spark, folder)
    opened = None
    if manifests is not None:
        opened = (
            manifests.where(F.col("snapshot_id") == snapshot_id)
            .select(
                F.try_aes_decrypt(
                    "manifest",
                    secret(spark, derive_key(key, schema.SNAPSHOT_KEY_CONTEXT)),
                    F.lit("GCM"),
                    F.lit("DEFAULT"),
                    _binding(snapshot_id, "manifest"),
                ).cast("string").alias("text")
            )
            .first()
        )
    if opened is None:
        raise StorageError(f"the store has no snapshot {snapshot_id}")
    if opened["text"] is None:
        raise StorageError(f"snapshot {snapshot_id} is damaged or was sealed with another key")
    return json.loads(opened["text"])


def read_snapshot(
    spark: SparkSession,
    folder: str,
    key: bytes,
    snapshot_id: str | None = None,
    columns: list[str] | None = None,
    verify: bool = False,
) -> DataFrame:
    """Read a snapshot (default: the newest), decrypting only the selected columns.

    A wrong key, or blocks that do not add up to the manifest, raise at once. A changed cell
    fails when it is decrypted: at the first action, or here with `verify`.
    """
    snapshot_id = snapshot_id or latest_snapshot(spark, folder)
    manifest = _manifest(spark, folder, key, snapshot_id)
    content = _content(_blocks(spark, folder, snapshot_id, []))
    if any(content[name] != manifest[name] for name in content):
        raise StorageError(f"snapshot {snapshot_id} is damaged or was sealed with another key")
    full = T.StructType.fromJson(json.loads(manifest["schema"]))
    wanted = T.StructType([full[name] for name in (columns or full.names)])
    blocks = _blocks(spark, folder, snapshot_id, wanted.names)
    opening = secret(spark, derive_key(key, schema.SNAPSHOT_KEY_CONTEXT))

    def opened(name: str, decrypt=F.aes_decrypt) -> Column:
        bound = _binding(snapshot_id, name, F.col("_block"))
        return decrypt(F.col(name), opening, F.lit("GCM"), F.lit("DEFAULT"), bound)

    if verify:
        broken = [opened(name, F.try_aes_decrypt).isNull() for name in wanted.names]
        bad = blocks.where(F.greatest(F.lit(False), *broken)).limit(1).count()
        if bad:
            raise StorageError(f"snapshot {snapshot_id} is damaged or was sealed with another key")
    cells = blocks.select(*[opened(name).alias(name) for name in wanted.names])
    return cells.mapInArrow(_unpacker(), wanted)


def read_view(
    spark: SparkSession,
    folder: str,
    key: bytes,
    view: str,
    role: str,
    snapshot_id: str | None = None,
    sink=None,
) -> DataFrame:
    """Authorize a role on a view, then decrypt just the columns it may see.

    The decision goes to the audit sink, if there is one, also where it is a refusal.
    """
    if view not in schema.VIEW_COLUMNS:
        raise StorageError(f"unknown view: {view!r}")
    allowed, _ = authorize(role, view, sink)
    if not allowed:
        raise StorageError(f"view {view!r} is closed to role {role!r}")
    snapshot_id = snapshot_id or latest_snapshot(spark, folder)
    names = T.StructType.fromJson(
        json.loads(_manifest(spark, folder, key, snapshot_id)["schema"])
    ).names
    return read_snapshot(spark, folder, key, snapshot_id, scoped_columns(names, role, view))
