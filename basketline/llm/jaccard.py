"""Similarity join of documents by word shingles, with Bayesian candidate pruning.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is THRESHOLD
or more. A text of one to four words is one shingle.

1. A pass over the texts makes the digest and the MinHash signature of each shingle set. Equal
   sets are one node from here on; copies are counted.
2. Nodes that agree in a band of the signature are candidates. A pair of similarity 0.8 agrees in none
   of the 24 bands of 4 with probability (1 - 0.8^4)^24 = 3e-6.
3. Candidates compare signatures some values at a time; a pair is dropped once the posterior
   probability that its similarity reaches the threshold (uniform prior) is below TOLERANCE. A pair is
   compared in its first common band only. What is left goes out as a tree, not as pairs.
4. Connected nodes fetch their texts, and every two of a component are verified exactly.

Large buckets and components are compared in blocks of BLOCK nodes, any two blocks in a task.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import components, join_by_key
from basketline.session import written

SHINGLE = 5
#: As a fraction, so that verification is in whole numbers.
THRESHOLD = (4, 5)
BANDS, BAND = 24, 4
VALUES = BANDS * BAND
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
KEPT_WORDS = 300_000
_PAIRS = 1 << 17
_U = np.uint64


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    odd = draw.integers(0, 1 << 63, VALUES, dtype=np.uint64) * _U(2) + _U(1)
    return odd, draw.integers(0, 1 << 63, VALUES, dtype=np.uint64)


class Shingles:
    """Distinct shingle hashes of texts; words are hashed once."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, _U)

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, _U)
        index = self.index
        if len(index) > KEPT_WORDS:
            index.clear()
        for word in [w for w in dict.fromkeys(words) if w not in index]:
            number = index[word] = len(index)
            if number >= len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[number] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        values = self.hashes[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]
        size = min(SHINGLE, len(words))
        n = len(words) - size + 1
        out = np.full(n, size, _U)
        for step in range(size):
            out = (out ^ values[step : step + n]) * _U(0x9E3779B97F4A7C15)
            out ^= out >> _U(32)
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of shingle sets, none empty, a row each."""
    odd, add = _constants()
    out = np.empty((len(sets), VALUES), np.uint32)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (held == 0 or held + len(sets[last]) <= 1 << 15):
            held += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        for k in range(VALUES):
            out[first:last, k] = np.minimum.reduceat((flat * odd[k] + add[k]) >> _U(32), starts)
        first = last
    return out


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step, the matches among the values so far from which on a pair stays.

    With a uniform prior and m matches of n, the similarity has a Beta(m + 1, n - m + 1) posterior, which
    reaches t with the probability that n + 1 throws of chance t succeed at most m times.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out.append(m)
                break
    return out


def similar_enough(signature: np.ndarray, one: np.ndarray, other: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which pairs (rows of signature) survive: their first common band is the one given, and no
    step drops them."""
    fewest = fewest_matches(THRESHOLD[0] / THRESHOLD[1], TOLERANCE)
    alive = np.arange(len(one))
    matches = np.zeros(len(one), np.int64)
    first_band = np.full(len(one), BANDS)
    for step, least in enumerate(fewest):
        columns = slice(step * STEP, (step + 1) * STEP)
        equal = signature[one[alive], columns] == signature[other[alive], columns]
        matches[alive] += equal.sum(1)
        common = equal.reshape(len(alive), STEP // BAND, BAND).all(2)
        here = np.where(common.any(1), common.argmax(1) + step * (STEP // BAND), BANDS)
        first_band[alive] = np.minimum(first_band[alive], here)
        alive = alive[(matches[alive] >= least) & (first_band[alive] >= band[alive])]
    return alive[first_band[alive] == band[alive]]


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


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Rows sorted by key in tables that hold whole keys, some `rows` rows each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        columns = [table.column(k) for k in key]
        last = [c[-1] for c in columns]
        cut = table.num_rows - 1
        while cut >= 0 and all(c[cut] == v for c, v in zip(columns, last, strict=True)):
            cut -= 1
        if cut >= 0:
            yield table.slice(0, cut + 1)
            held = table.slice(cut + 1).to_batches()
            size = table.num_rows - cut - 1
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, key: list[str]) -> np.ndarray:
    """0, 1, ... for the keys of sorted rows."""
    change = np.zeros(table.num_rows, bool)
    for k in key:
        values = table.column(k)
        if pa.types.is_binary(values.type):
            values = np.array(values.to_pylist(), object)
        else:
            values = values.to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _pairs(group: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group, in its two blocks or in its only one, some at a time."""
    n = len(group)
    ends = np.searchsorted(group, group, "right")
    same = low == high
    # Rows are sorted by block within the group: one of the low block meets those behind it.
    high_starts = np.searchsorted(group * 2 + (~same & (block == high)), group * 2 + 1)
    starts = np.where(same, np.arange(n) + 1, np.where(block == low, high_starts, ends))
    sizes = ends - starts
    upto = np.cumsum(sizes)
    first = 0
    while first < n:
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + _PAIRS, "right")))
        part = sizes[first:last]
        one = np.repeat(np.arange(first, last), part)
        other = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part) + np.repeat(starts[first:last], part)
        if len(one):
            yield one, other
        first = last


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        sets = [shingles.of(value.as_py() or b"") for value in batch.column(2)]
        full = [i for i, s in enumerate(sets) if len(s)]
        digests, marks = [None] * len(sets), [None] * len(sets)
        for i, row in zip(full, signatures([sets[i] for i in full]) if full else [], strict=True):
            digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            marks[i] = row.astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())], names=["id", "row", "digest", "signature"])


def _in_blocks(rows: DataFrame, size: str, group: list[str]) -> DataFrame:
    """Each row once for every pair of blocks that its block is in."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    rows = rows.withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}).drop("_other", size)
    key = [*group, "low", "high"]
    return rows.repartition(*key).sortWithinPartitions(*key, "block", "digest")


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over the pairs that survive."""
    key = ["bucket", "low", "high"]
    for table in _groups(batches, key):
        group = _numbers(table, key)
        low, high, block, band = (table.column(c).to_numpy() for c in ("low", "high", "block", "band"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(-1, VALUES)
        left = [(one[keep], other[keep]) for one, other in _pairs(group, low, high, block) if len(keep := similar_enough(signature, one, other, band[one]))]
        if left:
            root = forest(len(group), *(np.concatenate(x) for x in zip(*left, strict=True)))
            rows = np.flatnonzero(root != np.arange(len(root)))
            digest = table.column("digest").combine_chunks()
            yield pa.RecordBatch.from_arrays([digest.take(pa.array(rows)), digest.take(pa.array(root[rows]))], names=["a", "b"])


def _set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as its shingles; only rows whose digest is that of the text."""
    shingles = Shingles()
    for batch in batches:
        sets = [shingles.of(value.as_py() or b"") for value in batch.column(batch.num_columns - 1)]
        right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d.as_py() for s, d in zip(sets, batch.column(0), strict=True)]
        arrays = [*batch.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).filter(pa.array(right, pa.bool_()))


def linked(sets: list[np.ndarray], halves: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets at the threshold: of all, or of the first `halves` with the others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    useful = times[place] > 1
    row, place = row[useful], (np.cumsum(times > 1) - 1)[place[useful]]
    first, second = slice(0, halves or n), slice(halves or 0, n)
    common = np.zeros((first.stop - first.start, n - second.start), np.int64)
    for start in range(0, int(place.max()) + 1 if len(place) else 0, 4096):
        here = (place >= start) & (place < start + 4096)
        matrix = np.zeros((n, 4096), np.float32)
        matrix[row[here], place[here] - start] = 1
        common += (matrix[first] @ matrix[second].T).astype(np.int64)
    union = sizes[first][:, None] + sizes[second][None, :] - common
    hit = common * THRESHOLD[1] >= union * THRESHOLD[0]
    one, other = np.nonzero(hit)
    other = other + second.start
    return one[one < other], other[one < other]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node of a block pair: the documents it is linked to there, and the least node of its tree."""
    key = ["root", "low", "high"]
    for table in _groups(batches, key, 2_000):
        # Rows equal in id and text fetch the same text; one is enough.
        group = _numbers(table, key)
        digests = table.column("digest").to_pylist()
        fresh = [i for i in range(len(digests)) if i == 0 or group[i] != group[i - 1] or digests[i] != digests[i - 1]]
        table, group = table.take(pa.array(fresh)), group[fresh]
        digests = [digests[i] for i in fresh]
        copies = table.column("copies").to_numpy()
        low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
        sets = [np.frombuffer(s.as_py(), _U) for s in table.column("text")]
        links, tree = np.zeros(len(sets), np.int64), np.arange(len(sets))
        for rows in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(group)) + 1):
            halves = None if low[rows[0]] == high[rows[0]] else int((block[rows] == low[rows[0]]).sum())
            if len(rows) < 2 or halves in (0, len(rows)):
                continue
            one, other = linked([sets[i] for i in rows], halves)
            np.add.at(links, rows[one], copies[rows[other]])
            np.add.at(links, rows[other], copies[rows[one]])
            tree[rows] = rows[forest(len(rows), one, other)]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(links), pa.array([digests[i] for i in tree], pa.binary())], names=["digest", "links", "tree"])


def row_key(key: str, text: str) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.col(key), F.xxhash64(text))


def classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, row (see row_key), class_id (the least id it is connected to by links), n_links, and
    node (the same for all of a class, null for a wordless text).

    n_links counts the other rows it is linked to, copies among them. A null or wordless text is
    linked to nothing. A null id is never a class id unless all of its class are null. Repeated
    rows are linked to each other. Texts of any length are taken whole; other columns are not
    read; an empty table has no rows.
    """
    given = docs.select(F.col(key).alias("id"), row_key(key, text).alias("row"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    signed = written(given.mapInArrow(_signed, f"id {kind}, row long, digest binary, signature binary"), "jaccard-signatures")
    nodes = signed.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("id").alias("first"), F.min("row").alias("row"), F.first("signature").alias("signature")
    )
    nodes = written(nodes, "jaccard-nodes")

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = nodes.select("digest", "signature", band)
    part = F.substring("signature", F.col("band") * (4 * BAND) + 1, F.lit(4 * BAND))
    bands = bands.select(F.xxhash64("band", part).alias("bucket"), "band", "digest")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    total = nodes.count() * BANDS
    found = join_by_key(bands, shared.withColumn("size", F.col("n")), "bucket", "n", total, "inner")
    found = written(found, "jaccard-candidates")
    # Each node is looked up once for all its buckets.
    wide = found.groupBy("digest").agg(F.collect_list(F.struct("bucket", "band", "size")).alias("buckets"))
    wide = wide.join(nodes.select("digest", "signature"), "digest").select("digest", "signature", F.inline("buckets"))
    edges = _in_blocks(wide, "size", ["bucket"]).mapInArrow(_prune, "a binary, b binary")

    trees = components(edges)
    trees = written(trees.union(trees.select(F.col("root").alias("node"), "root").distinct()), "jaccard-components")
    sizes = trees.groupBy("root").agg(F.count("*").alias("n"))
    sized = join_by_key(trees, sizes.withColumn("size", F.col("n")), "root", "n", trees.count())
    asked = sized.withColumnRenamed("node", "digest").join(nodes.select("digest", "row", "copies"), "digest")
    fetched = asked.join(given.select("row", "text"), "row").select("digest", "root", "size", "copies", "text")
    sets = fetched.mapInArrow(_set_of, "digest binary, root binary, size long, copies long, text binary")
    verified = _in_blocks(sets, "size", ["root"]).mapInArrow(_verify, "digest binary, links long, tree binary")
    verified = written(verified, "jaccard-links")

    links = verified.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("digest").alias("a"), F.col("tree").alias("b")))
    # A root stands for itself; so does a node without links.
    named = nodes.select("digest", "copies", "first").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    named = named.withColumn("root", F.coalesce("root", "digest"))
    members = written(named.join(links, "digest", "left"), "jaccard-nodes")
    least = members.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("n"))
    facts = join_by_key(members, least, "root", "n", members.count())
    facts = facts.select("digest", "class_id", F.col("root").alias("node"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n"))
    rows = signed.select("id", "row", "digest")
    joined = join_by_key(rows.filter("digest IS NOT NULL"), facts, "digest", "n", signed.count()).drop("digest")
    alone = rows.filter("digest IS NULL").select("id", "row", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("binary").alias("node"))
    return joined.unionByName(alone)
