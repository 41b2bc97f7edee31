"""Near duplicates by SimHash fingerprints, found by the generalised pigeonhole principle.

1. A pass over the texts makes the fingerprints. Equal fingerprints are one node from here on.
2. Bits that go together are put into the same part, by their correlations over all nodes. A split of the 64 bits into
   parts with thresholds e1, e2, ... (-1: not probed) whose sum of e + 1 is DISTANCE + 1 misses no
   link: if every part differed by more than its threshold, more than DISTANCE bits would.
3. Each node gets thresholds of its own by dynamic programming over the parts. The cost of a threshold
   is the number of probes plus the estimated candidates: shares of nodes at each distance in bytes of
   the part, taken as independent, or the exact counts of frequent values within reach if these are more.
4. A node is stored under its value in every part, and probes the values within its thresholds. What meets
   in a bucket is verified by the whole fingerprints. Only trees leave a task, never pairs.
5. Trees are joined to components.

Large buckets are compared in blocks of BLOCK nodes, any two blocks in a task.
"""

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import components, join_by_key
from basketline.session import written

BITS = 64
WORDS = 3
SEED = 42
DISTANCE = 3
#: Splits that are weighed.
PARTS = (2, 3, 4, 5, 6)
#: The cost of a comparison; that of a probe, which is a row of a shuffle, is 1.
COMPARISON = 0.005
#: A value of a part is frequent if more than this share of all nodes has it.
FREQUENT = 1 / 1000
BLOCK = 4096
_PAIRS = 1 << 20
_CHUNK = 1 << 17
_U = np.uint64
_LANES = _U(0x0101010101010101)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of every shingle, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    shingles = [joined[a:b] for a, b in zip(starts, ends[WORDS - 1 :])] if len(words) >= WORDS else [joined]
    return list(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)))


def majority(hashes: np.ndarray, owner_sizes: np.ndarray) -> np.ndarray:
    """For runs of hashes of the given sizes (none 0) the bits set in over half of each.

    Eight bits are counted at a time, in the bytes of a word, over runs of at most 255.
    """
    cuts = np.concatenate([np.arange(start, start + size, 255) for start, size in zip(np.cumsum(owner_sizes) - owner_sizes, owner_sizes, strict=True)])
    first_cut = np.cumsum(-(-owner_sizes // 255)) - (-(-owner_sizes // 255))
    out = np.zeros(len(owner_sizes), _U)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> _U(k)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_cut, axis=0)
        for byte in range(8):
            out |= (counts[:, byte] * 2 > owner_sizes).astype(_U) << _U(8 * byte + k)
    return out


def fingerprints(texts: Iterator[bytes]) -> np.ndarray:
    """The fingerprint of each text; 0 for one without words."""
    out: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def close() -> None:
        sizes = np.array([len(h) for h in held])
        found = np.zeros(len(held), _U)
        if sizes.any():
            found[sizes > 0] = majority(np.concatenate(held), sizes[sizes > 0])
        out.append(found)
        held.clear()

    total = 0
    for text in texts:
        held.append(np.array(shingle_hashes(text), _U))
        total += len(held[-1])
        if total >= _CHUNK:
            close()
            total = 0
    close()
    return np.concatenate(out)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprints(value.as_py() or b"" for value in batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fingerprint"])


def fingerprint_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id and fingerprint (the 64 bits as a long)."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    return given.mapInArrow(_fingerprinted, f"id {kind}, fingerprint long")


# The split of the bits and the thresholds


def _unpacked(values: np.ndarray) -> np.ndarray:
    """Bits of each value, lowest first, a row each."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _common_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many nodes have both bits set, for every two; one row per bit."""
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = _unpacked(batch.column(0).to_numpy().view(_U)).astype(np.float32)
        for start in range(0, len(bits), 1 << 16):
            part = bits[start : start + (1 << 16)]
            total += (part.T @ part).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BITS), BITS)), pa.array(np.tile(np.arange(BITS), BITS)), pa.array(total.ravel())], names=["one", "other", "n"])


def correlations(common: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlations of bits; a constant bit goes with none."""
    share = common / max(n, 1)
    mean = np.diag(share)
    spread = np.sqrt(mean * (1 - mean))
    scale = np.outer(spread, spread)
    return np.abs(np.divide(share - np.outer(mean, mean), scale, out=np.zeros_like(scale), where=scale > 0))


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of equal size, to one bit: each starts with the strongest pair left, and takes in the bit that
    goes best with those it has."""
    left, out = list(range(BITS)), []
    for number in range(parts):
        size = BITS // parts + (number < BITS % parts)
        pairs = correlation[np.ix_(left, left)] - 2 * np.eye(len(left))
        own = [left[int(np.argmax(pairs.max(1)))]]
        while len(own) < size:
            rest = [b for b in left if b not in own]
            own.append(rest[int(np.argmax(correlation[np.ix_(rest, own)].sum(1)))])
        out.append(sorted(own))
        left = [b for b in left if b not in own]
    return out


def project(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, packed."""
    out = np.zeros(len(values), _U)
    for place, bit in enumerate(bits):
        out |= ((values >> _U(bit)) & _U(1)) << _U(place)
    return out


def allocate(costs: list[np.ndarray]) -> np.ndarray:
    """Thresholds (-1: none) with a sum of e + 1 of DISTANCE + 1 and the least cost.

    costs: per part an array of records by thresholds -1 to DISTANCE. One row of thresholds per record.
    """
    n, budget = len(costs[0]), DISTANCE + 1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    choices = []
    for cost in costs:
        options = np.full((n, budget + 1, budget + 1), np.inf)
        for spent in range(budget + 1):
            for own in range(spent + 1):
                options[:, spent, own] = best[:, spent - own] + cost[:, own]
        choices.append(options.argmin(2))
        best = options.min(2)
    out = np.empty((n, len(costs)), np.int64)
    left = np.full(n, budget)
    for part in range(len(costs) - 1, -1, -1):
        own = choices[part][np.arange(n), left]
        out[:, part] = own - 1
        left -= own
    return out


def within(width: int, distance: int) -> int:
    return sum(math.comb(width, e) for e in range(distance + 1))


class Plan:
    """The parts, and what candidate counts are estimated by."""

    def __init__(self, parts: list[list[int]], n: int, shares: list[list[tuple[list[int], np.ndarray]]], frequent: list[tuple[np.ndarray, np.ndarray]]):
        #: shares: per part its bytes, as bits of the part and the share of nodes per value of them.
        #: frequent: per part the frequent values and their counts.
        self.parts, self.n, self.shares, self.frequent = parts, n, shares, frequent
        self.by_distance = [[self._spread(table) for _, table in part] for part in shares]

    @staticmethod
    def _spread(table: np.ndarray) -> np.ndarray:
        """Per value the share of nodes at distance 0 to DISTANCE from it."""
        values = np.arange(len(table), dtype=_U)
        distance = np.bitwise_count(values[:, None] ^ values[None, :])
        return np.stack([np.where(distance == e, table[None, :], 0).sum(1) for e in range(DISTANCE + 1)], 1)

    def candidates(self, part: int, values: np.ndarray) -> np.ndarray:
        """Estimated nodes within distance 0 to DISTANCE of values of a part."""
        total = np.zeros((len(values), DISTANCE + 1))
        total[:, 0] = 1
        for (bits, _), spread in zip(self.shares[part], self.by_distance[part], strict=True):
            own = spread[project(values, bits).astype(np.int64)]
            total = np.stack([sum(total[:, a] * own[:, e - a] for a in range(e + 1)) for e in range(DISTANCE + 1)], 1)
        found = np.cumsum(total, 1) * self.n
        known, counts = self.frequent[part]
        exact = np.zeros_like(found)
        for value, count in zip(known, counts, strict=True):
            distance = np.bitwise_count(values ^ value)
            for e in range(DISTANCE + 1):
                exact[:, e] += np.where(distance <= e, count, 0)
        return np.maximum(found, exact)

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        costs = []
        for part, bits in enumerate(self.parts):
            probes = np.array([within(len(bits), e) for e in range(DISTANCE + 1)], float)
            cost = probes[None, :] + COMPARISON * self.candidates(part, project(values, bits))
            costs.append(np.concatenate([np.zeros((len(values), 1)), cost], 1))
        return allocate(costs)


def even_cost(n: int, parts: int) -> float:
    """The cost of a node if all values of a part were equally frequent."""
    costs = []
    for number in range(parts):
        width = BITS // parts + (number < BITS % parts)
        costs.append(np.array([[0.0, *(within(width, e) * (1 + COMPARISON * n / 2.0**width) for e in range(DISTANCE + 1))]]))
    chosen = allocate(costs)[0]
    return parts + sum(float(c[0, e + 1]) for c, e in zip(costs, chosen, strict=True))


def plan(nodes: DataFrame, n: int) -> Plan:
    """The split with the least cost for n nodes, and its statistics over all of them.

    On the driver are 64 x 64 sums, 256 counts per byte and fewer than 1 / FREQUENT values per part.
    """
    sums = nodes.select("fingerprint").mapInArrow(_common_bits, "one long, other long, n long").groupBy("one", "other").agg(F.sum("n").alias("n"))
    common = np.zeros((BITS, BITS))
    for row in sums.collect():
        common[row["one"], row["other"]] = row["n"]
    count = min(PARTS, key=lambda p: even_cost(n, p))
    parts = grouped_bits(correlations(common, n), count)
    slices = [(number, start, bits[start : start + 8]) for number, bits in enumerate(parts) for start in range(0, len(bits), 8)]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(slices), 256), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().view(_U)
            for place, (_, _, bits) in enumerate(slices):
                total[place] += np.bincount(project(values, bits).astype(np.int64), minlength=256)
        place, value = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(value), pa.array(total[place, value])], names=["place", "value", "n"])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(_U)
            for number, bits in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), number, np.int32)), pa.array(project(values, bits).view(np.int64))], names=["part", "value"])

    tables = np.zeros((len(slices), 256))
    rows = nodes.select("fingerprint").mapInArrow(tally, "place long, value long, n long").groupBy("place", "value").agg(F.sum("n").alias("n"))
    for row in rows.collect():
        tables[row["place"], row["value"]] = row["n"] / max(n, 1)
    frequent: list[tuple[list[int], list[int]]] = [([], []) for _ in parts]
    rows = nodes.select("fingerprint").mapInArrow(parted, "part int, value long").groupBy("part", "value").agg(F.count("*").alias("n"))
    for row in rows.filter(F.col("n") > max(2.0, n * FREQUENT)).collect():
        frequent[row["part"]][0].append(row["value"])
        frequent[row["part"]][1].append(row["n"])
    shares = [[(list(range(start, start + len(bits))), tables[place, : 1 << len(bits)]) for place, (own, start, bits) in enumerate(slices) if own == number] for number in range(count)]
    return Plan(parts, n, shares, [(np.array(v, np.int64).view(_U), np.array(c, np.int64)) for v, c in frequent])


# Probes and verification


def masks(width: int, distance: int) -> np.ndarray:
    """Every set of at most `distance` of `width` bits, the empty one first."""
    return np.array([sum(1 << b for b in bits) for e in range(distance + 1) for bits in itertools.combinations(range(width), e)], _U)


_PROBE = "part int, value long, fingerprint long, stored boolean, probing boolean"


def _probes(how: Plan):
    """A node under its own value in each part, and once under each other value that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1 << 14):
                values = whole.column(0).slice(start, 1 << 14).to_numpy().view(_U)
                thresholds = how.thresholds(values)
                for number, bits in enumerate(how.parts):
                    own = project(values, bits)
                    for e in range(-1, DISTANCE + 1):
                        rows = np.flatnonzero(thresholds[:, number] == e)
                        if not len(rows):
                            continue
                        flips = masks(len(bits), max(e, 0))
                        step = max(1, (1 << 16) // len(flips))
                        for first in range(0, len(rows), step):
                            here = rows[first : first + step]
                            probed = (own[here][:, None] ^ flips[None, :]).ravel()
                            is_own = np.tile(flips == 0, len(here))
                            size = len(probed)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(size, number, np.int32)),
                                    pa.array(probed.view(np.int64)),
                                    pa.array(np.repeat(values[here], len(flips)).view(np.int64)),
                                    pa.array(is_own),
                                    pa.array(np.full(size, e >= 0)),
                                ],
                                names=[f.split()[0] for f in _PROBE.split(", ")],
                            )

    return run


def forest(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[one], root[other])
        new = root.copy()
        np.minimum.at(new, root[one], low)
        np.minimum.at(new, root[other], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(values: np.ndarray, stored: np.ndarray, probing: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a bucket as a tree over those that are linked: each with a smaller row, or none.

    A probing row meets every stored one. side: 0 all meet all, 1 and 2 the two blocks, which meet each other.
    """
    link_one, link_other = [], []
    ask, have = np.flatnonzero(probing), np.flatnonzero(stored)
    step = max(1, _PAIRS // max(1, len(have)))
    for first in range(0, len(ask), step):
        own = ask[first : first + step]
        close = np.bitwise_count(values[own][:, None] ^ values[have][None, :]) <= DISTANCE
        if side.any():
            close &= side[own][:, None] != side[have][None, :]
        a, b = np.nonzero(close)
        a, b = own[a], have[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if len(a):
            # What is linked so far is a tree; so are the rows handed on.
            root = forest(len(values), np.concatenate([a, *link_one]), np.concatenate([b, *link_other]))
            rows = np.flatnonzero(root != np.arange(len(root)))
            link_one, link_other = [rows], [root[rows]]
    return (link_one[0], link_other[0]) if link_one else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over the links of each bucket, or pair of its blocks; rows come sorted by these."""
    held: list[np.ndarray] = []

    def links(table: np.ndarray, last: bool) -> tuple[list, np.ndarray]:
        key = table[:, :4]
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        ends = np.append(starts[1:], len(table))
        out = []
        for a, b in zip(starts, ends, strict=True):
            if b == len(table) and not last:
                return out, table[a:]
            if b - a < 2:
                continue
            part = table[a:b]
            if not part[:, 6].any() or not part[:, 7].any():
                continue
            side = np.where(part[:, 2] == part[:, 3], 0, np.where(part[:, 4] == part[:, 2], 1, 2))
            values = part[:, 5].copy().view(_U)
            one, other = bucket_links(values, part[:, 6].astype(bool), part[:, 7].astype(bool), side)
            if len(one):
                out.append((part[one, 5], part[other, 5]))
        return out, table[:0]

    def made(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).cast(pa.int64()).to_numpy() for c in ("part", "value", "low", "high", "block", "fingerprint", "stored", "probing")]
        held.append(np.stack(columns, 1))
        size += batch.num_rows
        if size >= 1 << 17:
            found, rest = links(np.concatenate(held), False)
            held, size = [rest], len(rest)
            yield from made(found)
    if held:
        yield from made(links(np.concatenate(held), True)[0])


def edges(nodes: DataFrame) -> DataFrame:
    """Trees (a, b) that connect exactly the fingerprints that links connect; nodes has distinct fingerprints."""
    how = plan(nodes, nodes.count())
    probes = written(nodes.select("fingerprint").mapInArrow(_probes(how), _PROBE), "simhash-probes")
    sizes = probes.groupBy("part", "value").agg(
        F.count("*").alias("size"), F.count_if("stored").alias("kept"), F.count_if("probing").alias("asked")
    )
    # A bucket that nothing is stored in, or nothing probes, or that holds one node, makes no pair.
    busy = sizes.filter("kept > 0 AND asked > 0 AND size > 1").select(F.xxhash64("part", "value").alias("bucket"), "part", "value", "size")
    busy = busy.groupBy("bucket").agg(F.sum("size").alias("size"))
    keyed = probes.withColumn("bucket", F.xxhash64("part", "value"))
    met = join_by_key(keyed, busy.withColumn("n", F.col("size")), "bucket", "n", probes.count(), "inner")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    dealt = met.withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")})
    key = ["part", "value", "low", "high"]
    dealt = dealt.select(*key, "block", "fingerprint", "stored", "probing").repartition(*key).sortWithinPartitions(*key, "block", "fingerprint")
    return dealt.mapInArrow(_buckets, "a long, b long")


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, fingerprint (a long) and component_id, the least id that links of at most DISTANCE
    differing bits lead to, itself included.

    A null or wordless text has fingerprint 0 and is linked like any other. A null id is never a component id
    unless all of its component are null. Repeated rows have equal fingerprints, so they are linked. Other
    columns are not read; texts are taken whole; an empty table has no rows.
    """
    rows = written(fingerprint_rows(docs, key, text), "simhash-fingerprints")
    nodes = written(rows.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "simhash-nodes")
    roots = components(edges(nodes)).select(F.col("node").alias("fingerprint"), "root")
    members = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    members = written(members, "simhash-members")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    facts = join_by_key(members, least, "root", "n", members.count()).select("fingerprint", "component_id", F.col("copies").alias("n"))
    return join_by_key(rows, facts, "fingerprint", "n", rows.count())
