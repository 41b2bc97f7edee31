"""Removal of repeated passages by a distributed, sparse suffix array.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id.

Suffixes. Shipping every suffix would move each text many times over, so only those at anchors are
compared: an anchor is a place whose SEED-byte hash is the least within some window of LENGTH
bytes. That depends on the window's content alone, so every string of LENGTH bytes has an anchor at
the same place wherever it occurs, and comparing what surrounds equal anchors misses no string.

Steps, each one shuffle:
1. Documents are dealt into cells of about CELL_BYTES. A cell sends the hashes of its anchors
   to hash buckets and learns which of them another document has too.
2. The suffixes at such anchors, with the bytes before them that a string may take in, are
   range-partitioned by their leading bytes, with splitters sampled from some cells. Leading bytes that HOT_CELLS
   cells or more have are split by document id as well, so they are spread over several partitions;
   all others stay whole. Within a cell equal suffixes go out once.
3. A partition sorts its suffixes by multikey quicksort and, by their common prefixes, finds for each
   whether one of a smaller id agrees with it for LENGTH bytes.
4. A split group at the edge of a partition may go on in the next. Its strings are compared across
   partitions, one row per string and partition.
5. Cells take the covered spans out of their texts.

Texts that are equal as a whole are found by digest first and send no suffixes, but for one.
"""

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from basketline.llm.common import cell_count, join_by_key
from basketline.session import written

LENGTH = 50
SEED = 24
#: What a string may take in before its anchor, and after the anchor's seed.
REACH = LENGTH - SEED
CELL_BYTES = 2 << 20
BUCKET_BYTES = 12 << 20
#: Cells that have the same leading bytes, from which on these are split over partitions.
HOT_CELLS = 64
#: Suffixes per range partition that its ends are estimated from, and about how many cells they come from.
SAMPLED_SUFFIXES = 100
SAMPLED_CELLS = 16
#: Bytes hashed at a time; long texts are cut into overlapping pieces of that size.
_PIECE = 1 << 18
_NO_ID = np.iinfo(np.int64).max
_U = np.uint64


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place on, never 0."""
    step = (data.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    step ^= step >> _U(29)
    step *= _U(0xBF58476D1CE4E5B9)
    have, size, out, done = step, 1, None, 0
    left = SEED
    while left:
        if left & 1:
            if out is None:
                out, done = have.copy(), size
            else:
                n = len(have) - done
                out = out[:n] * _U(0xD6E8FEB86659FD93) + have[done:]
                done += size
        left >>= 1
        if left:
            n = len(have) - size
            have = have[:n] * _U(0xA0761D6478BD642F) + have[size:]
            have ^= have >> _U(31)
            size *= 2
    out = out[: len(data) - SEED + 1]
    out = (out ^ (out >> _U(32))) * _U(0x94D049BB133111EB)
    return (out ^ (out >> _U(29))) | _U(1)


def _slide(better, values: np.ndarray, width: int) -> np.ndarray:
    """The best of each run of width values."""
    size = 1
    while size * 2 <= width:
        values = better(values[:-size], values[size:])
        size *= 2
    if size < width:
        rest = width - size
        values = better(values[:-rest], values[rest:])
    return values


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of every anchor, in order."""
    width = LENGTH - SEED + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    part: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        flat = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        ends = np.cumsum(sizes)
        hashes = _seed_hashes(flat)
        least = _slide(np.minimum, hashes, width)
        # A window that runs over the end of its text is none.
        crossing = (ends[:-1, None] - np.arange(1, LENGTH)[None, :]).ravel()
        least[crossing[(crossing >= 0) & (crossing < len(least))]] = 0
        edge = np.zeros(width - 1, _U)
        chosen = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), width) == hashes)
        owner = np.searchsorted(ends, chosen, "right")
        starts = ends - sizes
        numbers, offsets = np.array([p[0] for p in part]), np.array([p[1] for p in part])
        out.append((numbers[owner], chosen - starts[owner] + offsets[owner], hashes[chosen]))
        part.clear()

    for number, text in enumerate(texts):
        for start in range(0, len(text) - LENGTH + 1, _PIECE):
            piece = text[start : start + _PIECE + LENGTH - 1]
            part.append((number, start, piece))
            held += len(piece)
            if held >= _PIECE:
                flush()
                held = 0
    if part:
        flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    number, place, value = (np.concatenate(x) for x in zip(*out, strict=True))
    # Pieces of a long text overlap, so an anchor may come twice.
    again = np.zeros(len(number), bool)
    order = np.lexsort((place, number))
    number, place, value = number[order], place[order], value[order]
    again[1:] = (number[1:] == number[:-1]) & (place[1:] == place[:-1])
    return number[~again], place[~again], value[~again]


def multikey_quicksort(words: np.ndarray, small: int = 4096) -> np.ndarray:
    """The order that sorts rows of unsigned words: three-way partition by one word, equals by the next.

    Blocks of at most `small` rows are finished at once.
    """
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        first, last, depth = todo.pop()
        if last - first < 2 or depth == words.shape[1]:
            continue
        rows = order[first:last]
        if last - first <= small:
            order[first:last] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        key = words[rows, depth]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        low, high = key < pivot, key > pivot
        equal = ~(low | high)
        order[first:last] = np.concatenate([rows[low], rows[equal], rows[high]])
        a, b = first + int(low.sum()), last - int(high.sum())
        todo += [(first, a, depth), (a, b, depth + 1), (b, last, depth)]
    return order


def _as_words(matrix: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, padded with zeros."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    return padded.view(">u8").astype(_U)


def _shared_prefix(matrix: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in the order; the first shares none."""
    rows = matrix[order]
    out = np.zeros(len(order), np.int64)
    differ = rows[1:] != rows[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    return out


def covered(lead: np.ndarray, before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, bytes before and after its place that repeat one of a smaller id; 0, 0 for none.

    lead: the seeds; before: the bytes in front of them, nearest first; after: those behind; both
    padded to REACH columns, their numbers given. A string takes `o` bytes before the seed and
    REACH - o behind, so strings are equal where both sides share that much.
    """
    n = len(lead)
    ahead = np.concatenate([lead, after], 1)
    order = multikey_quicksort(_as_words(ahead))
    shared = _shared_prefix(ahead, order)
    back_order = multikey_quicksort(_as_words(before))
    back_shared = _shared_prefix(before, back_order)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ahead_group, back_group = np.empty(n, np.int64), np.empty(n, np.int64)
    # Suffixes whose seed occurs once in this partition cannot repeat here.
    seeds = np.cumsum(shared < SEED)
    alone = np.bincount(seeds, minlength=seeds[-1] + 1 if n else 1) < 2
    busy = np.zeros(n, bool)
    busy[order] = ~alone[seeds]
    for o in range(REACH + 1):
        ahead_group[order] = np.cumsum(shared < LENGTH - o)
        back_group[back_order] = np.cumsum(back_shared < o)
        rows = np.flatnonzero(busy & (n_before >= o) & (n_after >= REACH - o))
        if len(rows) < 2:
            continue
        key = ahead_group[rows] * (n + 1) + back_group[rows]
        by = np.lexsort((ids[rows], key))
        key, rows = key[by], rows[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(ids[rows[starts]], np.diff(np.append(starts, len(rows))))
        hit = rows[ids[rows] > least]
        right[hit] = np.maximum(right[hit], LENGTH - o)
        left[hit] = np.maximum(left[hit], o)
    return left, right


# What travels between cells, buckets and partitions.

_SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4")])
_PLACE = np.dtype([("id", "<i8"), ("cell", "<i4"), ("doc", "<u4"), ("start", "<u4")])


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Document ids; null is behind all others."""
    return column.fill_null(_NO_ID).to_numpy().astype(np.int64)


class _Cell:
    """The documents of a cell, in a fixed order, without those that copy an earlier one."""

    def __init__(self, docs: pa.Table, marks: pa.Table):
        texts = [value.as_py() or b"" for value in docs.column("text")]
        ids = _ids(docs.column("id"))
        digests = [hashlib.sha256(t).digest() for t in texts]
        self.rows = sorted(range(len(texts)), key=lambda i: (ids[i], digests[i]))
        self.texts = [texts[i] for i in self.rows]
        self.ids = ids[self.rows]
        copies = {(i, d) for i, d in zip(_ids(marks.column("id")), marks.column("digest").to_pylist(), strict=True) if d is not None}
        self.copy = [(i, digests[r]) in copies for i, r in zip(self.ids, self.rows, strict=True)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return anchors([b"" if copy else text for text, copy in zip(self.texts, self.copy, strict=True)])


def _by_bucket(hashes: np.ndarray, buckets: int):
    """Distinct (bucket, low half of hash), sorted, as one number; and each hash's place among them."""
    key = ((hashes >> _U(32)) % _U(buckets)) << _U(32) | (hashes & _U(0xFFFFFFFF))
    return np.unique(key, return_inverse=True)


_HASHES = "bucket int, cell int, hashes binary, several binary"


def _send_hashes(buckets: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        cell = _Cell(docs, marks)
        number, _, value = cell.anchors()
        keys, place = _by_bucket(value, buckets)
        ids = cell.ids[number]
        low, high = np.full(len(keys), _NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        several = low < high
        bucket = (keys >> _U(32)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        out = {"bucket": [], "cell": [], "hashes": [], "several": []}
        for part in np.split(np.arange(len(keys)), cuts) if len(keys) else []:
            out["bucket"].append(int(bucket[part[0]]))
            out["cell"].append(docs.column("cell")[0].as_py())
            out["hashes"].append((keys[part] & _U(0xFFFFFFFF)).astype("<u4").tobytes())
            out["several"].append(np.packbits(several[part]).tobytes())
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "cell": pa.array(out["cell"], pa.int32()), "hashes": pa.array(out["hashes"], pa.binary()), "several": pa.array(out["several"], pa.binary())})

    return run


_REPLY = "cell int, id long, digest binary, bucket int, shared binary, hot binary"


def _find_shared(rows: pa.Table) -> pa.Table:
    """For each message of a bucket, which of its hashes occur in another document, and in HOT_CELLS cells or more."""
    parts = [np.frombuffer(h.as_py(), "<u4") for h in rows.column("hashes")]
    sizes = [len(p) for p in parts]
    several = np.concatenate([np.unpackbits(np.frombuffer(s.as_py(), np.uint8), count=n) for s, n in zip(rows.column("several"), sizes, strict=True)])
    _, place, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = times + np.bincount(place, several).astype(np.int64) >= 2
    n, cuts = len(parts), np.cumsum(sizes)[:-1]
    answers = [pa.array([np.packbits(f).tobytes() for f in np.split(flags[place], cuts)], pa.binary()) for flags in (shared, times >= HOT_CELLS)]
    given = [rows.column("cell"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), rows.column("bucket")]
    return pa.table([*given, *answers], names=[f.split()[0] for f in _REPLY.split(", ")])


#: Suffixes of a cell for one range partition, packed, or (without any) spans that the cell has covered itself.
_SUFFIX = "part int, cell int, suffixes binary, spans binary"
#: n_before, n_after: how many of these bytes there are; split: whether the leading bytes may be in several partitions.
_FIELDS = [("lead", "u1", SEED), ("before", "u1", REACH), ("after", "u1", REACH), ("n_before", "u1", 1), ("n_after", "u1", 1), ("split", "u1", 1), ("id", "<i8", 1), ("doc", "<u4", 1), ("place", "<u4", 1)]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Suffixes as compressed bytes, column by column."""
    return zstandard.compress(b"".join(c.astype(kind).tobytes() for c, (_, kind, _) in zip(columns, _FIELDS, strict=True)), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, out = len(raw) // sum(np.dtype(kind).itemsize * width for _, kind, width in _FIELDS), 0, []
    for _, kind, width in _FIELDS:
        values = np.frombuffer(raw, kind, n * width, at)
        at += values.nbytes
        out.append(values.reshape(n, width) if width > 1 else values)
    return out


def _sample(limit: int):
    """Up to limit suffixes of a cell: their leading bytes and ids."""

    def run(docs: pa.Table) -> pa.Table:
        found = sorted({(t.as_py() or b"", i) for t, i in zip(docs.column("text"), _ids(docs.column("id")), strict=True)})
        # Copies send no suffixes, but for one.
        found = [row for row, before in zip(found, [(None, 0), *found], strict=False) if row[0] != before[0]]
        number, place, _ = anchors([text for text, _ in found])
        taken = np.random.default_rng(len(number)).permutation(len(number))[:limit]
        leads = [found[number[i]][0][place[i] : place[i] + SEED] for i in taken]
        return pa.table([pa.array(leads, pa.binary()), pa.array([found[number[i]][1] for i in taken], pa.int64())], names=["lead", "id"])

    return run


def _splitters(given: DataFrame, cells: int, buckets: int) -> list[tuple[bytes, int]]:
    """Ends of all range partitions but the last, as (leading bytes, id), from the suffixes of some cells.

    They decide how even the partitions are, and nothing else: what is in which cell is a matter of a hash. All
    suffixes count, shared or not, so no partition gets more of them than its share of all.
    """
    if buckets == 1:
        return []
    every = max(1, cells // SAMPLED_CELLS)
    some = given.select("cell", "id", "text").where(F.col("cell") % every == 0)
    limit = -(-SAMPLED_SUFFIXES * buckets // -(-cells // every))
    rows = some.groupBy("cell").applyInArrow(_sample(limit), "lead binary, id long").collect()
    found = sorted((bytes(r["lead"]), r["id"]) for r in rows)
    return [found[len(found) * i // buckets] for i in range(1, buckets)] if found else []


def _place(lead: np.ndarray, ids: np.ndarray, split: np.ndarray, splitters: list[tuple[bytes, int]]) -> np.ndarray:
    """The range partition of each suffix: by leading bytes, and where these are split by id as well."""
    ends = np.array([end for end, _ in splitters], f"S{SEED}")
    own = np.ascontiguousarray(lead).view(f"S{SEED}")[:, 0]
    part, last = np.searchsorted(ends, own, "left"), np.searchsorted(ends, own, "right")
    for i in np.flatnonzero(split & (last > part)):
        part[i] = bisect_left(splitters, ids[i], int(part[i]), int(last[i]), key=lambda end: end[1])
    return part


def _send_suffixes(buckets: int, splitters: list[tuple[bytes, int]]):
    """Suffixes at shared anchors, packed by range partition, and spans that the cell has covered itself."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        cell = _Cell(docs, replies)
        number, place, value = cell.anchors()
        keys, at = _by_bucket(value, buckets)
        shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        bucket = (keys >> _U(32)).astype(np.int64)
        for b, *answers in zip(*(replies.column(c).to_pylist() for c in ("bucket", "shared", "hot")), strict=True):
            if b is not None:
                first, last = np.searchsorted(bucket, [b, b + 1])
                for flags, bits in zip((shared, hot), answers, strict=True):
                    flags[first:last] = np.unpackbits(np.frombuffer(bits, np.uint8), count=last - first)
        chosen = np.flatnonzero(shared[at])
        out: list[tuple] = []
        if len(chosen):
            doc, place, split, ids = number[chosen], place[chosen], hot[at[chosen]], cell.ids[number[chosen]]
            # Texts in a row, with zeros between them that stand for what is beyond their ends.
            gap = bytes(REACH)
            flat = np.frombuffer(gap + gap.join(cell.texts) + gap, np.uint8)
            sizes = np.array([len(t) for t in cell.texts])
            origin = np.cumsum(sizes + REACH) - sizes
            n_before, n_after = np.minimum(place, REACH), np.minimum(sizes[doc] - place - SEED, REACH)
            around = np.zeros((len(chosen), REACH + LENGTH + 4), np.uint8)
            around[:, : REACH + LENGTH] = flat[(origin[doc] + place)[:, None] + np.arange(-REACH, LENGTH)]
            # Equal suffixes have equal numbers of bytes on either side.
            around[:, -4], around[:, -3] = n_before, n_after
            _, same = np.unique(around.view(f"V{around.shape[1]}")[:, 0], return_inverse=True)
            least = np.full(len(chosen), _NO_ID)
            np.minimum.at(least, same, ids)
            sent = ids <= least[same]
            home = docs.column("cell")[0].as_py()
            done = np.flatnonzero(~sent & (n_before + SEED + n_after >= LENGTH))
            spans = np.zeros(len(done), _SPAN)
            spans["doc"], spans["start"] = doc[done], place[done] - n_before[done]
            spans["end"] = place[done] + SEED + n_after[done]
            if len(done):
                out.append((home % buckets, home, None, spans.tobytes()))
            rows = np.flatnonzero(sent)
            lead = around[rows, REACH:LENGTH]
            part = _place(lead, ids[rows], split[rows], splitters)
            order = np.argsort(part, kind="stable")
            columns = [lead, around[rows, REACH - 1 :: -1], around[rows, LENGTH : LENGTH + REACH]]
            columns += [x[rows] for x in (n_before, n_after, split, ids, doc, place)]
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                out.append((int(part[some[0]]), home, _pack([c[some] for c in columns]), None))
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * len(types)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _SUFFIX.split(", ")])

    return run


#: Spans of a cell, or (without a cell) the places of a string.
_FOUND = "key binary, cell int, spans binary"
_FOUND_TYPES = [pa.binary(), pa.int32(), pa.binary()]
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _spans_by_cell(cells: np.ndarray, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, bytes]]:
    spans = np.zeros(len(cells), _SPAN)
    spans["doc"], spans["start"], spans["end"] = docs, starts, ends
    order = np.argsort(cells, kind="stable")
    cells, spans = cells[order], spans[order]
    cuts = np.flatnonzero(np.diff(cells)) + 1
    parts = zip(np.split(cells, cuts), np.split(spans, cuts), strict=True) if len(cells) else []
    return [(int(c[0]), s.tobytes()) for c, s in parts]


def _edge(words: np.ndarray, best) -> np.ndarray:
    """Which rows of words are the least (or greatest) of all."""
    here = np.ones(len(words), bool)
    for column in words.T:
        here &= column == best(column[here])
    return here


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range partition: spans by cell, and the strings of the split groups at its edges."""
    parts, owners, found = [], [], []
    for batch in batches:
        for cell, packed, spans in zip(*(batch.column(c).to_pylist() for c in ("cell", "suffixes", "spans")), strict=True):
            if packed is None:
                found.append((cell, spans))
            else:
                parts.append(_unpack(packed))
                owners.append(cell)
    rows: list[tuple] = []
    if parts:
        lead, before, after, n_before, n_after, split, ids, docs, places = (np.concatenate(c) for c in zip(*parts, strict=True))
        cells = np.repeat(np.array(owners, np.int64), [len(part[0]) for part in parts])
        parts.clear()
        n_before, n_after, docs, places = (c.astype(np.int64) for c in (n_before, n_after, docs, places))
        words, edge = _as_words(lead), np.zeros(len(lead), bool)
        for here in (_edge(words, np.min), _edge(words, np.max)):
            if split[here].any():
                edge |= here
        inner = np.flatnonzero(~edge)
        left, right = covered(lead[inner], before[inner], after[inner], n_before[inner], n_after[inner], ids[inner])
        hit = right > 0
        inner = inner[hit]
        found += _spans_by_cell(cells[inner], docs[inner], places[inner] - left[hit], places[inner] + right[hit])
        strings: dict[bytes, list[tuple]] = defaultdict(list)
        for i in np.flatnonzero(edge):
            around = before[i, : n_before[i]][::-1].tobytes() + lead[i].tobytes() + after[i, : n_after[i]].tobytes()
            origin = places[i] - n_before[i]
            for at in range(len(around) - LENGTH + 1):
                strings[around[at : at + LENGTH]].append((ids[i], cells[i], docs[i], origin + at))
        rows = [(string, None, np.array(places, _PLACE).tobytes()) for string, places in strings.items()]
    rows += [(cell.to_bytes(4, "little"), cell, spans) for cell, spans in found]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_FOUND_TYPES)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND_TYPES, strict=True)], names=_FOUND_NAMES)


_SPANS = "cell int, spans binary"


def _compare_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they came, and those of equal strings from different partitions."""
    strings: dict[bytes, list[np.ndarray]] = defaultdict(list)
    for batch in batches:
        strange = pa.compute.is_null(batch.column("cell"))
        known = batch.filter(pa.compute.invert(strange))
        yield pa.RecordBatch.from_arrays([known.column("cell"), known.column("spans")], names=["cell", "spans"])
        edges = batch.filter(strange)
        for string, places in zip(edges.column("key").to_pylist(), edges.column("spans").to_pylist(), strict=True):
            strings[string].append(np.frombuffer(places, _PLACE))
    hits = []
    for parts in strings.values():
        places = np.concatenate(parts)
        hits.append(places[places["id"] > places["id"].min()])
    hit = np.concatenate(hits) if hits else np.zeros(0, _PLACE)
    found = _spans_by_cell(hit["cell"], hit["doc"], hit["start"], hit["start"] + np.uint32(LENGTH))
    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], names=["cell", "spans"])


def remaining(text: bytes, spans: np.ndarray) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The text without the spans (start, end; in any order), bytes removed, and the maximal spans."""
    if not len(spans):
        return text, 0, []
    edges = np.zeros(len(text) + 1, np.int32)
    np.add.at(edges, spans[:, 0], 1)
    np.add.at(edges, spans[:, 1], -1)
    gone = np.cumsum(edges[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), [(int(a), int(b)) for a, b in turns.reshape(-1, 2)]


_ADDED = {
    "n_bytes": pa.int64(),
    "n_removed": pa.int64(),
    "n_spans": pa.int64(),
    "kept": pa.binary(),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    "was_null": pa.bool_(),
}


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> np.ndarray:
    """Runs without the characters that they cut in two."""
    out = []
    for start, end in runs:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        out.append((start, end))
    return np.array(out, np.int64).reshape(-1, 2)


def _cut(docs: pa.Table, spans: pa.Table, whole: bool) -> pa.Table:
    """The documents of a cell without their covered spans."""
    cell = _Cell(docs, spans)
    parts = [np.frombuffer(s, _SPAN) for s in spans.column("spans").to_pylist() if s is not None]
    every = np.concatenate(parts) if parts else np.zeros(0, _SPAN)
    every = every[np.argsort(every["doc"], kind="stable")]
    ranges = np.searchsorted(every["doc"], np.arange(len(cell.texts) + 1))
    out: list[list] = [[] for _ in range(len(_ADDED) - 1)]
    for number, text in enumerate(cell.texts):
        own = every[ranges[number] : ranges[number + 1]]
        own = np.stack([own["start"], own["end"]], 1).astype(np.int64)
        if cell.copy[number]:
            own = np.array([[0, len(text)]])
        kept, removed, runs = remaining(text, own)
        if whole and runs:
            kept, removed, runs = remaining(text, whole_characters(text, runs))
        row = (len(text), removed, len(runs), kept, [{"start": a, "end": b} for a, b in runs])
        for column, value in zip(out, row, strict=True):
            column.append(value)
    given = docs.take(pa.array(cell.rows, pa.int64()))
    out.append(pa.compute.is_null(given.column("text")).to_pylist())
    given = given.drop_columns(["cell", "id", "text"])
    columns = [pa.array(c, t) for c, t in zip(out, _ADDED.values(), strict=True)]
    return pa.table([*given.columns, *columns], names=[*given.column_names, *_ADDED])


def dedup(docs: DataFrame, key: str, text: str, whole_characters: bool = False) -> DataFrame:
    """All rows and columns of docs but the text, and n_bytes, n_removed, n_spans, kept (the bytes
    that stay), spans (the maximal runs removed, in bytes) and was_null.

    whole_characters: leave characters whole that the end of a run would cut in two.

    Texts are taken as UTF-8; null is empty. Rows of one id never cover each other; repeated rows
    stay repeated, and are treated alike. A null id is behind all others. Texts under LENGTH
    bytes stay whole. An empty table stays empty. Columns of docs named like an added one, or
    cell, id or text, are not kept; key must hold whole numbers.
    """
    others = [c for c in docs.columns if c not in (*_ADDED, text, "cell", "id", "text")]
    cells = cell_count(docs, text, CELL_BYTES)
    buckets = max(1, cells * CELL_BYTES // BUCKET_BYTES)
    cell = F.pmod(F.xxhash64(F.col(key), F.xxhash64(text)), F.lit(cells)).cast("int")
    given = docs.select(*others, cell.alias("cell"), F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    narrow = docs.select(
        cell.alias("cell"),
        F.col(key).cast("long").alias("id"),
        F.when(F.octet_length(text) >= LENGTH, F.unhex(F.sha2(F.col(text).cast("binary"), 256))).alias("digest"),
    )
    narrow = written(narrow.filter("digest IS NOT NULL"), "suffix-digests")
    order: Column = F.coalesce("id", F.lit(int(_NO_ID)))
    firsts = narrow.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    marked = join_by_key(narrow, firsts.filter("n > 1"), "digest", "n", narrow.count())
    marks = marked.filter(order > F.col("first")).select("cell", "id", "digest").distinct()
    marks = written(marks, "suffix-copies")

    # One exchange of the texts serves the three steps that read them.
    texts = given.repartition(cells, "cell").groupBy("cell")
    none = F.lit(None).cast("binary")
    known = marks.withColumns({"bucket": F.lit(None).cast("int"), "shared": none, "hot": none})
    hashes = texts.cogroup(marks.groupBy("cell")).applyInArrow(_send_hashes(buckets), _HASHES)
    replies = hashes.groupBy("bucket").applyInArrow(_find_shared, _REPLY).unionByName(known)
    # Splitters of our own: Spark would run the cells, with all their hashing, once more to sample them.
    splitters = _splitters(given, cells, buckets)
    suffixes = texts.cogroup(replies.groupBy("cell")).applyInArrow(_send_suffixes(buckets, splitters), _SUFFIX)
    found = suffixes.repartitionById(buckets, "part").mapInArrow(_sort_suffixes, _FOUND)
    spans = found.repartition(buckets, "key").mapInArrow(_compare_edges, _SPANS)
    spans = spans.withColumns({"id": F.lit(None).cast("long"), "digest": F.lit(None).cast("binary")})
    spans = spans.unionByName(marks.withColumn("spans", F.lit(None).cast("binary")))
    schema = docs.select(*others).schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    span = StructType().add("start", "long").add("end", "long")
    schema = schema.add("kept", "binary").add("spans", ArrayType(span)).add("was_null", "boolean")

    def cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
        return _cut(docs, spans, whole_characters)

    return texts.cogroup(spans.groupBy("cell")).applyInArrow(cut, schema)
