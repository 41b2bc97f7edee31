"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about FRAME_BYTES, each with the code points and bytes
that the text has up to its end. A place is found by these counts, so only the frames that a cut
goes through are decompressed and packed anew; all others go into the output as they are. The frames of
an output, put one behind the other, are a zstandard stream of it. Digests read the frames in order, one at
a time.

Units are code points, counted as bytes that do not continue a character.
"""

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

FRAME_BYTES = 1 << 16
#: Compressed bytes of a batch that leaves a worker, about.
BATCH_BYTES = 8 << 20
#: Decompressed bytes of a text that a digest keeps instead of decompressing them again.
KEPT_BYTES = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those that are transformed; of 100 of these, those with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

_FRAME = pa.struct([("units", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])
_FRAMES = ArrayType(StructType().add("units", "long").add("bytes", "long").add("data", "binary"))
Frame = tuple[int, int, bytes]
STORED = ("n", "marked", "frames")
ADDED = ("form", "prefix_chars", "middle_chars", "output")


def count_units(data: bytes) -> int:
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def unit_place(data: bytes, units: int) -> int:
    """The byte at which the first `units` code points end."""
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return int(starts[units]) if units < len(starts) else len(data)


def pieces(text: bytes, size: int = FRAME_BYTES) -> Iterator[bytes]:
    """The text in pieces of at most size bytes that end with a character."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while start + 1 < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        yield text[start:end]
        start = end


class Packer:
    """Collects pieces and ready frames in order; neighbouring pieces share a frame."""

    def __init__(self, compressor: zstandard.ZstdCompressor):
        self.compressor, self.frames, self.open = compressor, [], []
        self.units = self.bytes = 0

    def _add(self, units: int, size: int, data: bytes) -> None:
        self.units += units
        self.bytes += size
        self.frames.append((self.units, self.bytes, data))

    def flush(self) -> None:
        for piece in pieces(b"".join(self.open)):
            self._add(count_units(piece), len(piece), self.compressor.compress(piece))
        self.open = []

    def piece(self, data: bytes) -> None:
        if data:
            self.open.append(data)

    def frame(self, units: int, size: int, data: bytes) -> None:
        self.flush()
        self._add(units, size, data)

    def done(self) -> list[Frame]:
        self.flush()
        return self.frames


def pack(text: bytes, compressor: zstandard.ZstdCompressor) -> list[Frame]:
    """The frames of a text."""
    packer = Packer(compressor)
    packer.piece(text)
    return packer.done()


def select(frames: list[Frame], first: int, last: int, opened: dict[int, bytes], packer: Packer, read: Callable[[bytes], bytes]) -> None:
    """Put units first to last into the packer; only frames that are cut are read, once."""
    at = bisect.bisect_right(frames, first, key=lambda f: f[0])
    while at < len(frames) and first < last:
        start, begun = (frames[at - 1][0], frames[at - 1][1]) if at else (0, 0)
        end, size, data = frames[at]
        if first == start and last >= end:
            packer.frame(end - start, size - begun, data)
        else:
            if at not in opened:
                opened[at] = read(data)
            text = opened[at]
            packer.piece(text[unit_place(text, first - start) : unit_place(text, last - start)])
        first = end
        at += 1


def infill(frames: list[Frame], form: str, low: int, high: int, compressor: zstandard.ZstdCompressor, read: Callable[[bytes], bytes]) -> list[Frame]:
    """The frames of the output; low and high are where the prefix and the middle end."""
    if form == "plain":
        return frames
    n = frames[-1][0]
    prefix, middle, suffix = (PREFIX, 0, low), (MIDDLE, low, high), (SUFFIX, high, n)
    packer, opened = Packer(compressor), {}
    for mark, first, last in (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle):
        packer.piece(mark)
        select(frames, first, last, opened, packer, read)
    return packer.done()


class Reader:
    """Reads the frames of a text, in order or a range of bytes."""

    def __init__(self, frames: list[Frame], read: Callable[[bytes], bytes]):
        self.frames, self.read = frames, read
        self.keep = bool(frames) and frames[-1][1] <= KEPT_BYTES
        self.kept: dict[int, bytes] = {}

    def at(self, number: int) -> bytes:
        found = self.kept.get(number)
        if found is None:
            found = self.read(self.frames[number][2])
            if self.keep:
                self.kept[number] = found
        return found

    def range(self, first: int, last: int) -> Iterator[bytes]:
        number = bisect.bisect_right(self.frames, first, key=lambda f: f[1])
        while number < len(self.frames) and first < last:
            start = self.frames[number - 1][1] if number else 0
            yield self.at(number)[first - start : last - start]
            first = self.frames[number][1]
            number += 1

    def find(self, mark: bytes, start: int) -> int:
        """The first place of a mark from `start` on; -1 if there is none."""
        tail, place = b"", start
        for part in self.range(start, self.frames[-1][1]):
            found = (tail + part).find(mark)
            if found >= 0:
                return place - len(tail) + found
            place += len(part)
            tail = (tail + part)[-len(mark) + 1 :]
        return -1

    def whole(self) -> Iterator[bytes]:
        return map(self.at, range(len(self.frames)))


def rebuild(reader: Reader, form: str) -> Iterator[bytes]:
    """The text again, from an output and its form."""
    if form == "plain":
        yield from reader.whole()
        return
    second = reader.find(SUFFIX if form == "psm" else PREFIX, len(PREFIX))
    third = reader.find(MIDDLE, second)
    one = (len(PREFIX), second)
    two = (second + len(SUFFIX), third)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    for first, last in (prefix, (third + len(MIDDLE), reader.frames[-1][1]), suffix):
        yield from reader.range(first, last)


def _frames_of(column: pa.Array) -> Iterator[list[Frame]]:
    """The frames of each row of a batch."""
    offsets = column.offsets.to_numpy()
    units, sizes, data = (column.values.field(i) for i in range(3))
    units, sizes = units.to_numpy(), sizes.to_numpy()
    for first, last in zip(offsets[:-1], offsets[1:], strict=True):
        yield [(int(units[i]), int(sizes[i]), data[int(i)].as_py()) for i in range(first, last)]


def _frame_arrays(rows: list[list[Frame]]) -> pa.Array:
    """A list column of frames."""
    offsets = np.cumsum([0, *map(len, rows)])
    flat = [f for row in rows for f in row]
    columns = zip(*flat, strict=True) if flat else ([], [], [])
    values = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _FRAME, strict=True)], fields=list(_FRAME))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _spans(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of about BATCH_BYTES."""
    first = last = held = 0
    for size in sizes:
        held += size
        last += 1
        if held >= BATCH_BYTES:
            yield first, last
            first, held = last, 0
    if last > first:
        yield first, last


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as its units, whether it holds a mark, and its frames."""
    compressor = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        sizes = (len(t.as_buffer()) if t.is_valid else 0 for t in whole.columns[-1])
        for first, last in _spans(sizes):
            batch = whole.slice(first, last - first)
            units, marked, rows = [], [], []
            for value in batch.columns[-1]:
                text = value.as_py() or b""
                rows.append(pack(text, compressor))
                units.append(rows[-1][-1][0] if rows[-1] else 0)
                marked.append(any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)))
            added = [pa.array(units, pa.int64()), pa.array(marked, pa.bool_()), _frame_arrays(rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], *STORED])


def store(docs: DataFrame, text: str) -> DataFrame:
    """All rows and columns of docs but the text, with n (its code points), marked (it holds a mark of
    the transformation) and frames (units and bytes up to the end of each, and its data).

    A null text is empty and has no frames. Rows are independent: repeated rows stay, an empty
    table stays empty. A column of docs named like an added one is not kept.
    """
    others = [c for c in docs.columns if c != text and c not in STORED]
    schema = docs.select(*others).schema.add("n", "long").add("marked", "boolean").add("frames", _FRAMES)
    return docs.select(*others, F.col(text).cast("binary").alias("_text")).mapInArrow(_store, schema)


def draw(key: Column, number: int) -> Column:
    """The number-th of the independent draws of a document, 0 to 2^32 - 1; that of a null id too."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last four columns (frames, form, low, high) as the frames of the output."""
    compressor, read = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor().decompress
    for whole in batches:
        sizes = (sum(len(f[2]) for f in row) for row in _frames_of(whole.columns[-4]))
        for first, last in _spans(sizes):
            # A slice of a list column keeps the offsets of the whole, so rows are taken out.
            batch = whole.take(pa.array(np.arange(first, last)))
            given = zip(_frames_of(batch.columns[-4]), *(c.to_pylist() for c in batch.columns[-3:]), strict=True)
            rows = [infill(frames, form, low, high, compressor, read) for frames, form, low, high in given]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], _frame_arrays(rows)], names=[*batch.schema.names[:-4], "output"])


def transform(stored: DataFrame, key: str) -> DataFrame:
    """The stored rows with form (plain, psm or spm), prefix_chars and middle_chars (null if
    plain) and, for their frames, output: the frames of the output.

    Cuts and forms are drawn from the document id, so reruns agree and equal ids are cut alike. A
    text that is empty or holds a mark stays plain. A column of stored named like an added one is not kept.
    """
    others = [c for c in stored.columns if c not in (*ADDED, "frames")]
    one, two = (F.pmod(draw(F.col(key), i), F.col("n") + 1) for i in (0, 1))
    plain = (F.col("n") == 0) | F.col("marked") | (draw(F.col(key), 2) % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(draw(F.col(key), 3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    cut = stored.select(*others, form.alias("form"), F.least(one, two).alias("_low"), F.greatest(one, two).alias("_high"), "frames")
    whole = F.col("form") == "plain"
    cut = cut.select(
        *others,
        "form",
        F.when(~whole, F.col("_low")).alias("prefix_chars"),
        F.when(~whole, F.col("_high") - F.col("_low")).alias("middle_chars"),
        "frames",
        F.col("form").alias("_form"),
        "_low",
        "_high",
    )
    schema = cut.drop("frames", "_form", "_low", "_high").schema.add("output", _FRAMES)
    return cut.mapInArrow(_transform, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns (form, output) as the digests of the output and of the text rebuilt from it."""
    read = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out, restored = [], []
        for form, frames in zip(batch.columns[-2].to_pylist(), _frames_of(batch.columns[-1]), strict=True):
            reader = Reader(frames, read)
            for digests, parts in ((out, reader.whole()), (restored, rebuild(reader, form))):
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out), pa.array(restored)], names=[*batch.schema.names[:-2], "output_sha256", "restored_sha256"])


def digests(rows: DataFrame) -> DataFrame:
    """Transformed rows with output_sha256 and restored_sha256 for their output."""
    others = [c for c in rows.columns if c not in ("output", "output_sha256", "restored_sha256")]
    schema = rows.select(*others).schema.add("output_sha256", "string").add("restored_sha256", "string")
    return rows.select(*others, F.col("form").alias("_form"), "output").mapInArrow(_digest, schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = [b"".join(read(f[2]) for f in frames) for frames in _frames_of(batch.columns[-1])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*batch.schema.names[:-1], "_text"])


def texts(rows: DataFrame, frames: str) -> DataFrame:
    """Rows with a column of frames decompressed to a text of the same name."""
    others = [c for c in rows.columns if c != frames]
    schema = rows.select(*others).schema.add("_text", "binary")
    found = rows.select(*others, frames).mapInArrow(_texts, schema)
    return found.select(*others, F.col("_text").cast("string").alias(frames))
