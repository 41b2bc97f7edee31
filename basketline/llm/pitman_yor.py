"""Language-model scores by a hierarchical Pitman-Yor model.

Restaurants: one per context, the whole token before; contexts with the same last two bytes share a parent, those
with the same last byte a parent of that; all of these share the root, whose base is uniform over the training
vocabulary and one unknown token. So there are as many restaurants as tokens, 65,536 + 256 + 1 above them, and any
number of dishes (tokens) in each.

Cells: documents are dealt into cells. A cell numbers its tokens once. It sends its distinct pairs of
context and token, with how often the learned documents have them, to buckets by the token's hash, and
keeps each document as the numbers of its tokens. A bucket merges the messages, looks up what they ask for, and
keeps that in their place.

Seating: all of a token's customers are in one bucket. In each round a bucket seats them by Gibbs sampling
in blocks: all customers of a dish leave their tables and sit down again, and the number of tables is drawn
from its distribution given all other dishes, at any number of customers: the generalized Stirling number
times the rising product of what each further table weighs. A new table, which opens by the parent's
probability, is a customer of the parent restaurant. Two things are approximate: all buckets move at once, on
the totals of restaurants and the parents' probabilities of the round before; and the strength is fixed,
discounts come from the counts of counts. The predictive probabilities of the rounds after the first are
averaged.

The tables of whole-token contexts lie in many buckets. In each round every bucket sends its own to the contexts' buckets
(those of the same tokens), which send back the sums; so no totals of these restaurants are in one place.

Scoring: a bucket answers a cell's message pair by pair, and a cell puts the answers together and adds them up for
each document.
"""

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.llm.common import cell_count
from basketline.session import scratch_path

CELL_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
END = b""
START = 0
ROUNDS = 3
#: Times that each customer is seated anew in a round; all at once, so that more would change nothing.
MOVES = 1
STRENGTH = 1.0
#: Up to so many customers of a dish the chances of its tables come by recurrence, which is quicker there.
TABULATED = 1024
SEED = 5
#: Contexts with a code of two bytes, at most; and from how many cells they are chosen.
RARE = (1 << 16) - 1
CODED_CELLS = 8


def pack(values: np.ndarray | bytes, kind: str = "<u8") -> bytes:
    """Numbers or text as compressed bytes: counts are mostly ones, and words are sorted."""
    return zstandard.compress(values if isinstance(values, bytes) else values.astype(kind).tobytes(), 1)


def unpack(data: bytes, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b"\n")


def pack_planes(values: np.ndarray, width: int = 4) -> bytes:
    """Numbers of some bytes, compressed with all first bytes first, and so on: the high ones are mostly zero."""
    return zstandard.compress(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack_planes(data: bytes, width: int = 4) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T.copy().view(f"<u{width}")[:, 0]


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


def stored(frame: DataFrame, name: str, folders: list[str]) -> DataFrame:
    """Write the frame as a table in the shared folder and continue from the table, without the shuffles that led
    to it. Its folder is added to folders."""
    folders.append(scratch_path(frame.sparkSession, name))
    with shuffles_deleted(frame.sparkSession):
        frame.write.parquet(folders[-1])
    return frame.sparkSession.read.schema(frame.schema).parquet(folders[-1])


def stored_apart(frame: DataFrame, flag: str, name: str, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """As stored(), in folders of their own for rows with the flag and without: who reads one reads nothing of the other.
    Both are added to folders."""
    spark = frame.sparkSession
    folder = scratch_path(spark, name)
    folders += [f"{folder}/{flag}=true", f"{folder}/{flag}=false"]
    with shuffles_deleted(spark):
        frame.write.partitionBy(flag).parquet(folder)
    rows = spark.read.schema(frame.schema).option("basePath", folder).parquet(folder)
    return rows.where(flag), rows.where(f"NOT {flag}")


def emptied(spark: SparkSession, folders: list[str]) -> None:
    """Overwrite folders of intermediate rows that nothing reads any more."""
    for folder in folders:
        spark.createDataFrame([], "nothing int").coalesce(1).write.mode("overwrite").parquet(folder)


class Numbers(dict):
    """Words numbered in the order they are asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def context_ids(words: list[bytes]) -> np.ndarray:
    """What names a whole token as a context everywhere: 48 bits of its hash, and its last two bytes."""
    tail = np.fromiter(((w[-2] << 8 if len(w) > 1 else 0) | w[-1] if w else START for w in words), np.uint64, len(words))
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return found >> np.uint64(16) << np.uint64(16) | tail


def homes(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each token."""
    return ((ids >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def tails(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint64(0xFFFF)).astype(np.int64)


def number_tokens(texts: list[bytes], buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in order of their buckets, their ids, each document's tokens by number, and where documents end."""
    index = Numbers({END: 0})
    rows = []
    for text in texts:
        rows.append(index.of(text.lower().split()))
        rows.append(np.zeros(1, np.int64))
    words = list(index)
    ids = context_ids(words)
    order = np.argsort(homes(ids, buckets), kind="stable")
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    flat = number[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
    return [words[i] for i in order], ids[order], flat, np.cumsum([len(a) + 1 for a in rows[::2]])


def pairs_of(flat: np.ndarray) -> np.ndarray:
    """Token << 32 | context of each token: the whole token before it. A document begins after an end token."""
    # The last token is an end.
    return flat << 32 | np.concatenate([flat[-1:], flat[:-1]])


class Codes:
    """Two bytes for each of the contexts that are frequent, and all others written out.

    Which are frequent decides the size of the messages and no result.
    """

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent[:RARE]
        self.order = np.argsort(self.frequent)

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        place = _found(self.frequent[self.order], ids)
        codes = np.append(self.order, RARE)[place]
        return pack_planes(codes, 2), pack_planes(ids[codes == RARE], 8)

    def unpack(self, codes: bytes, rest: bytes) -> np.ndarray:
        number = unpack_planes(codes, 2)
        ids = np.append(self.frequent, np.zeros(RARE + 1 - len(self.frequent), np.uint64))[number]
        ids[number == RARE] = unpack_planes(rest, 8)
        return ids


def _found(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted keys; one behind the last if it is not there."""
    if not len(keys):
        return np.zeros(len(key), np.int64)
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[place] == key, place, len(keys))


def frequent_contexts(given: DataFrame) -> np.ndarray:
    """The ids of the most frequent tokens of some cells, the most frequent first."""
    words = F.explode(F.split(F.lower(F.col("text").cast("string")), r"[\x20\x09-\x0D]+")).alias("word")
    counts = given.where(F.col("cell") < CODED_CELLS).select(words).where("word != ''").groupBy("word").count()
    rows = counts.orderBy(F.desc("count"), "word").limit(RARE - 1).collect()
    return np.array(list(dict.fromkeys(context_ids([END, *(r["word"].encode() for r in rows)]).tolist())), np.uint64)


_PAIRS = ["words", "n_contexts", "codes", "rest", "counts"]


def by_bucket(words: list[bytes], ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, buckets: int, codes: Codes) -> list[tuple]:
    """(bucket, words, contexts per word, contexts as codes, contexts without a code, counts).

    keys: as of pairs_of, sorted and distinct; as words are in order of their buckets, so are the keys.
    """
    home = homes(ids, buckets)
    cuts = np.flatnonzero(np.diff(home[keys >> 32])) + 1
    out = []
    for part in np.split(np.arange(len(keys)), cuts) if len(keys) else []:
        own, sizes = np.unique(keys[part] >> 32, return_counts=True)
        data = pack(b"\n".join([words[i] for i in own]))
        out.append((int(home[own[0]]), data, pack(sizes, "<u4"), *codes.pack(ids[keys[part] & 0xFFFFFFFF]), pack(counts[part])))
    return out


_MESSAGE = ["cell", "bucket", *_PAIRS]
_MESSAGE_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5]


def _read_cell(buckets: int, codes: Codes):
    """Messages of a cell, and its documents: the number of tokens and, with the first, all tokens by number and the
    last bytes of each different one."""

    def run(docs: pa.Table) -> pa.Table:
        texts = [value.as_py() or b"" for value in docs.column("text")]
        words, ids, flat, ends = number_tokens(texts, buckets)
        keys, place = np.unique(pairs_of(flat), return_inverse=True)
        sizes = np.diff(ends, prepend=0)
        learned = np.repeat(docs.column("learned").to_numpy(), sizes)
        counts = np.bincount(place[learned], minlength=len(keys))
        rows = by_bucket(words, ids, keys, counts, buckets, codes)
        cell = docs.column("cell")[0].as_py()
        columns = zip(*((cell, *r) for r in rows), strict=True)
        messages = pa.table([pa.array(c, t) for c, t in zip(columns, _MESSAGE_TYPES, strict=True)], names=_MESSAGE)
        messages = messages.append_column("message", pa.array([True] * len(rows)))
        # The tokens of the whole cell go with its first document.
        rest = [None] * (len(texts) - 1)
        added = {"number": np.arange(len(texts)), "n_tokens": sizes, "message": np.zeros(len(texts), bool)}
        added |= {"tokens": pa.array([pack_planes(flat), *rest], pa.binary()), "tails": pa.array([pack(tails(ids), "<u2"), *rest], pa.binary())}
        given = docs.drop_columns(["text", "learned"])
        for name, values in added.items():
            given = given.append_column(name, pa.array(values))
        return pa.concat_tables([messages, given], promote_options="default")

    return run


def _merge(table: pa.Table, codes: Codes) -> tuple:
    """Of a bucket's messages: the learned words in sorted order, the ids of contexts, sorted keys (word << 32 | place of
    the context), how often each was learned, and by message its words, sizes, ids of contexts and places of its keys.

    The word of what no learned document has is the number of words.
    """
    index = Numbers()
    tokens, sizes, ids, counts = [], [], [], []
    for data, n, c, rest, k in zip(*(table.column(x).to_pylist() for x in _PAIRS), strict=True):
        tokens.append(index.of(unpack_words(data)))
        sizes.append(unpack(n, "<u4"))
        ids.append(codes.unpack(c, rest))
        counts.append(unpack(k).astype(np.int64))
    # Messages come in any order; the words are numbered anew by theirs.
    token, count = np.repeat(np.concatenate(tokens), np.concatenate(sizes)), np.concatenate(counts)
    every = list(index)
    known = np.zeros(len(every), bool)
    known[token[count > 0]] = True
    words = sorted(w for w, k in zip(every, known, strict=True) if k)
    number = np.full(len(every), len(words))
    number[index.of(words)] = np.arange(len(words))
    named, place = np.unique(np.concatenate(ids), return_inverse=True)
    keys, place = np.unique(number[token] << 32 | place, return_inverse=True)
    places = np.split(place, np.cumsum([len(i) for i in ids])[:-1])
    asked = zip([number[t] for t in tokens], sizes, ids, places, strict=True)
    return words, named, keys, np.bincount(place, count, len(keys)).astype(np.int64), asked


@dataclass
class Seats:
    """A bucket's dishes: customers and tables in the contexts of whole tokens, in those of two bytes, in their parents
    and the root.

    pair: token << 16 | last two bytes; parent: token << 8 | last byte; both sorted. In the contexts of whole
    tokens most dishes have one customer, and so always one table: these are only counted, in c2. All
    others are listed, in the order of their pairs: ids are those of their contexts, sorted and distinct, whole the place
    of a dish's context among them.
    """

    words: list[bytes]
    pair: np.ndarray
    c2: np.ndarray
    t2: np.ndarray
    parent: np.ndarray
    t1: np.ndarray
    t0: np.ndarray
    ids: np.ndarray
    listed: np.ndarray
    whole: np.ndarray
    c3: np.ndarray
    t3: np.ndarray

    @property
    def up(self) -> np.ndarray:
        """The parent dish of each pair."""
        return np.searchsorted(self.parent, (self.pair >> 16 << 8) | (self.pair & 0xFF))

    @property
    def c1(self) -> np.ndarray:
        return np.bincount(self.up, self.t2, len(self.parent)).astype(np.int64)

    @property
    def c0(self) -> np.ndarray:
        return np.bincount(self.parent >> 8, self.t1, len(self.words)).astype(np.int64)

    @property
    def alone(self) -> np.ndarray:
        """The dishes of each pair that are not listed."""
        return self.c2 - np.bincount(self.listed, self.t3, len(self.pair)).astype(np.int64)

    @property
    def occurrences(self) -> np.ndarray:
        """How often each word was learned."""
        found = self.alone + np.bincount(self.listed, self.c3, len(self.pair)).astype(np.int64)
        return np.bincount(self.pair >> 16, found, len(self.words)).astype(np.int64)

    def fixed(self) -> list[bytes]:
        sizes = np.bincount(self.pair >> 16, minlength=len(self.words))
        listed = pack(np.bincount(self.listed, minlength=len(self.pair)), "<u4"), pack_planes(self.whole), pack(self.c3)
        return [pack(b"\n".join(self.words)), pack(sizes, "<u4"), pack(self.pair & 0xFFFF, "<u2"), pack_planes(self.ids, 8), *listed]

    def moved(self) -> list[bytes]:
        return [*(pack(a) for a in (self.c2, self.t2, self.t1, self.t0, self.t3)), pack(_sums(self))]


def parents_of(pair: np.ndarray) -> np.ndarray:
    """The dishes of the parent restaurants, sorted."""
    return np.unique((pair >> 16 << 8) | (pair & 0xFF))


#: What stays, and what each round changes; sums are the bucket's part of the totals.
_FIXED = ["words", "n_contexts", "contexts", "ids", "n_listed", "whole", "c3"]
_MOVED = ["c2", "t2", "t1", "t0", "t3", "sums"]
_ALONE = ["alone_ids", "alone"]
#: What a message asks for, by a bucket's numbers of words and dishes.
_ASKED = ["word", "sizes", "dish", "n_two", "two"]


def _schema(*names: str) -> str:
    return ", ".join(["bucket int", *(f"{n} binary" for n in names)])


def _seats(row: dict) -> Seats:
    words, sizes = unpack_words(row["words"]), unpack(row["n_contexts"], "<u4")
    pair = np.repeat(np.arange(len(words)), sizes) << 16 | unpack(row["contexts"], "<u2")
    c2, t2, t1, t0, c3, t3 = (unpack(row[c]).astype(np.int64) for c in ("c2", "t2", "t1", "t0", "c3", "t3"))
    listed = np.repeat(np.arange(len(pair)), unpack(row["n_listed"], "<u4"))
    return Seats(words, pair, c2, t2, parents_of(pair), t1, t0, unpack_planes(row["ids"], 8), listed, unpack_planes(row["whole"]).astype(np.int64), c3, t3)


def _packed(names: list[str], types: list[pa.DataType], rows: list) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _first_seats(codes: Codes):
    """Merged counts of a bucket with one table for each dish in each restaurant, and how many dishes that are not
    listed each context has; no such row for nothing learned. And what each message asks for: a pair's dish is 0 if it was
    not learned, 1 if once, 2 and more by its place among those of its word that are listed."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words, ids, keys, counts, asked = _merge(table, codes)
        learned = np.flatnonzero(counts)
        c3, whole = counts[learned], keys[learned] & 0xFFFFFFFF
        pair, up, c2 = np.unique(keys[learned] >> 32 << 16 | tails(ids)[whole], return_inverse=True, return_counts=True)
        parent = parents_of(pair)
        rows = np.flatnonzero(c3 > 1)
        rows = rows[np.argsort(up[rows], kind="stable")]
        contexts, place = np.unique(whole[rows], return_inverse=True)
        dish = np.minimum(counts, 1)
        token = pair[up[rows]] >> 16
        dish[learned[rows]] = 2 + np.arange(len(rows)) - np.searchsorted(token, token)
        out = []
        for cell, (word, sizes, named, places) in zip(table.column("cell").to_pylist(), asked, strict=True):
            pairs = np.unique(np.repeat(np.arange(len(word)), sizes) << 16 | tails(named))
            n_two = np.bincount(pairs >> 16, minlength=len(word))
            request = pack_planes(word), pack(sizes, "<u4"), pack_planes(dish[places]), pack(n_two, "<u4"), pack(pairs & 0xFFFF, "<u2")
            out.append((bucket, cell, True, *request, *[None] * len(_FIXED + _MOVED + _ALONE)))
        if words:
            t2, t1, t0, t3 = (np.ones(len(x), np.int64) for x in (pair, parent, words, rows))
            seats = Seats(words, pair, c2, t2, parent, t1, t0, ids[contexts], up[rows], place, c3[rows], t3)
            alone = np.bincount(whole[c3 == 1], minlength=len(ids))
            parts = *seats.fixed(), *seats.moved(), pack_planes(ids[alone > 0], 8), pack(alone[alone > 0])
            out.append((bucket, None, False, *[None] * len(_ASKED), *parts))
        types = [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * len(_ASKED + _FIXED + _MOVED + _ALONE)]
        return _packed(["bucket", "cell", "asked", *_ASKED, *_FIXED, *_MOVED, *_ALONE], types, out)

    return run


@dataclass
class Totals:
    """Customers, tables and discount of every restaurant, and the size of the vocabulary.

    The restaurants of whole tokens are summed up as one; their own tables are in _Tables.
    """

    customers: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    discounts: tuple[float, ...]
    vocabulary: int
    tokens: int

    def known(self, level: int, restaurant, customers, tables):
        """What a dish has of its restaurant's probability."""
        return (customers - self.discounts[level] * tables) / (STRENGTH + self.customers[level][restaurant])

    def passed(self, level: int, restaurant):
        """What the restaurant passes on to its parent."""
        return (STRENGTH + self.discounts[level] * self.tables[level][restaurant]) / (STRENGTH + self.customers[level][restaurant])

    @property
    def unknown(self) -> float:
        """The root's probability of the unknown token."""
        return self.passed(0, 0) / (self.vocabulary + 1)


_SUMS = ["level", "restaurant", "customers", "tables", "dishes", "ones", "twos"]


def _sums(s: Seats) -> np.ndarray:
    """A row for each of _SUMS: level, restaurant, customers, tables, dishes, of which with one customer, with two."""
    out = []
    for level, at, c, t, width in ((2, s.pair & 0xFFFF, s.c2, s.t2, 1 << 16), (1, s.parent & 0xFF, s.c1, s.t1, 256), (0, np.zeros(len(s.words), np.int64), s.c0, s.t0, 1)):
        sums = [np.bincount(at, weights, width).astype(np.int64) for weights in (c, t, np.ones(len(c)), c == 1, c == 2)]
        here = np.flatnonzero(sums[2])
        out.append(np.stack([np.full(len(here), level), here, *(x[here] for x in sums)]))
    alone, ones, twos = s.alone.sum(), (s.c3 == 1).sum(), (s.c3 == 2).sum()
    out.append(np.array([3, 0, alone + s.c3.sum(), s.c2.sum(), alone + len(s.c3), alone + ones, twos])[:, None])
    return np.concatenate(out, 1)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            columns = unpack(data).astype(np.int64).reshape(len(_SUMS), -1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_SUMS)


def totals(seats: DataFrame) -> Totals:
    """Sums over all buckets; at most 65,794 rows reach the driver."""
    found = seats.select("sums").mapInArrow(_totals, ", ".join(f"{n} long" for n in _SUMS))
    rows = found.groupBy("level", "restaurant").agg(*[F.sum(n).alias(n) for n in _SUMS[2:]]).collect()
    widths = (1, 256, 1 << 16, 1)
    customers, tables = (tuple(np.zeros(w) for w in widths) for _ in range(2))
    ones, twos, dishes = [0] * 4, [0] * 4, [0] * 4
    for r in rows:
        customers[r["level"]][r["restaurant"]] = r["customers"]
        tables[r["level"]][r["restaurant"]] = r["tables"]
        ones[r["level"]] += r["ones"]
        twos[r["level"]] += r["twos"]
        dishes[r["level"]] += r["dishes"]
    # The usual estimate of an absolute discount from the counts of counts.
    discounts = tuple(min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in zip(ones, twos, strict=True))
    return Totals(customers, tables, discounts, dishes[0], int(customers[3].sum()))


def _saddle(c: int, weight: float, discount: float) -> tuple[float, float, float]:
    """The saddle point z and w = 1 - z for c customers, and the tables expected there."""
    # Not nearer to the branch point than z^-c can tell.
    low, high = -50.0, -1e-12
    for _ in range(60):
        middle = (low + high) / 2
        more = math.log(weight) + math.log(-math.expm1(middle)) + (discount - 1) * middle > math.log(c)
        low, high = (middle, high) if more else (low, middle)
    w = max(math.exp(high), 1 / c)
    return 1 - w if w == 1 / c else -math.expm1(high), w, weight / discount * (1 - w**discount)


def table_chances(c: int, weight: float, discount: float, grow: float = 0.0) -> tuple[int, np.ndarray]:
    """The least number of tables that matters for a dish with c customers, and the chances of it and of each one more.

    t tables have a chance in proportion to S(c, t) weight (weight + grow) ... (weight + (t - 1) grow), S the
    generalized Stirling numbers: each table adds to the restaurant's tables, and so to what the next one weighs.

    S(c, t) is c! / (t! discount^t) times the coefficient of z^c in (1 - (1 - z)^discount)^t; the coefficient is
    Cauchy's integral along a hyperbola that leaves the saddle point and goes round the branch cut
    from 1, where the trapezoidal rule is right to rounding. The saddle point is that of the weight at the
    most likely number of tables, where the chances with and without growth have the same slope.
    """
    base, expected = weight, _saddle(c, weight, discount)[2]
    for _ in range(40 if grow else 0):
        weight, before = base + grow * min(c, expected), expected
        expected = _saddle(c, weight, discount)[2]
        if abs(expected - before) <= 1e-3 * before:
            break
    z, w, expected = _saddle(c, weight, discount)
    spread = c + weight * (1 - discount) * (1 - w) ** 2 * w ** (discount - 2)
    deviation = math.sqrt(max(1.0, expected - c * c / spread))

    def along(u):
        # Steps near the saddle point are as small as its distance from the pole at 0.
        v = z * np.sinh(u)
        way = w * (0.6 * (1 - np.cosh(v)) + 0.8j * np.sinh(v))
        logs = (np.log(w + way), np.log1p(-w - way)) if w < 0.5 else (np.log1p(way - z), np.log(z - way))
        return np.log(-np.expm1(discount * logs[0])), (c + 1) * logs[1], (0.8 * np.cosh(v) + 0.6j * np.sinh(v)) * np.cosh(u)

    def integral(t, power, decay, slope):
        top = t * power[0].real - decay[0].real
        return top, (np.exp(np.outer(t, power) - decay - top[:, None]) * slope).real.sum(1)

    grid = np.append(0.0, np.geomspace(1e-6, np.arcsinh(30 / z), 160))
    power, decay, slope = along(grid)
    reach = 12.0
    while True:
        least = int(max(1, min(c, expected) - reach * deviation - 20))
        tables = np.arange(least, int(min(c, expected + reach * deviation + 40)) + 1)
        tried = tables[[0, np.searchsorted(tables, min(max(int(expected), 1), c)), -1]]
        # The integrand fades slowest for the most tables.
        size = (tables[-1] * power - decay).real + np.log(np.abs(slope))
        end = grid[min(len(grid) - 1, np.flatnonzero(size - size[0] > -42)[-1] + 1)]
        nodes, before, now = 32, np.zeros(3), np.ones(3)
        while np.abs(now - before).max() > 1e-9 * now[1] and nodes < 1 << 14:
            nodes, before = 2 * nodes, now
            taken = along(np.linspace(0, end, nodes + 1))
            taken[2][0] /= 2
            now = integral(tried, *taken)[1] / nodes
        parts = [integral(part, *taken) for part in np.array_split(tables, -(-len(tables) * nodes // (1 << 18)))]
        top, sums = (np.concatenate(x) for x in zip(*parts, strict=True))
        logs = top + np.log(np.maximum(sums, 1e-300)) + tables * np.log(weight / discount)
        # A sum below rounding stands for no chance; 1 / t! comes last, as a running sum from the least t.
        logs -= np.append(0.0, np.log(tables[1:])).cumsum()
        logs += np.append(0.0, np.log((base + grow * tables[:-1]) / weight)).cumsum()
        logs[sums < 1e-13 * sums.max()] = -np.inf
        chances = np.exp(logs - logs.max())
        # Growth spreads the chances; take in more tables until what lies beyond no longer matters.
        open_ends = (least > 1 and chances[0] > 1e-11) or (tables[-1] < c and chances[-1] > 1e-11)
        if not open_ends or reach > 1e6:
            return least, chances / chances.sum()
        reach *= 2


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, draw: np.random.Generator, grow: np.ndarray | None = None) -> np.ndarray:
    """Tables of each dish after a round of Gibbs sampling; weight: of its first table, grow: what each of its
    tables adds to the weight of its next.

    All customers of a dish leave and sit down again together: the number of their tables is drawn from its
    distribution given the other dishes' (the sizes of the tables have no bearing on anything else).
    Up to TABULATED customers its chances come by recurrence, beyond from table_chances; both are
    right to rounding.
    """
    grow = np.zeros(len(customers)) if grow is None else grow
    out = np.ones(len(customers), np.int64)
    log_stirling = np.zeros(1)
    order = np.argsort(customers, kind="stable")
    sizes, first = np.unique(customers[order], return_index=True)
    rows_of = dict(zip(sizes.tolist(), np.split(order, first[1:]), strict=True)) if len(order) else {}
    tabulated = [c for c in rows_of if c <= TABULATED]
    for c in range(2, max(tabulated, default=0) + 1):
        # S(c, t) = S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t)
        stay = np.append(log_stirling + np.log(c - 1 - discount * np.arange(1, c)), -np.inf)
        log_stirling = np.logaddexp(stay, np.append(-np.inf, log_stirling))
        if c in rows_of:
            for rows in np.array_split(rows_of[c], -(-len(rows_of[c]) * c // (1 << 20))):
                logs = log_stirling + np.log(weight[rows, None] + grow[rows, None] * np.arange(c)).cumsum(1)
                sums = np.exp(logs - logs.max(1, keepdims=True)).cumsum(1)
                out[rows] = 1 + (sums < draw.random(len(rows))[:, None] * sums[:, -1:]).sum(1)
    for c, rows in rows_of.items():
        if c > TABULATED:
            for row in rows:
                least, chances = table_chances(c, float(weight[row]), discount, float(grow[row]))
                sums = chances.cumsum()
                out[row] = least + min(np.searchsorted(sums, draw.random() * sums[-1]), len(sums) - 1)
    return out


def _probabilities(s: Seats, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """The root's and the parents' probabilities of the dishes."""
    root = totals.known(0, 0, s.c0, s.t0) + totals.unknown
    last = s.parent & 0xFF
    return root, totals.known(1, last, s.c1, s.t1) + totals.passed(1, last) * root[s.parent >> 8]


def _middle(s: Seats, totals: Totals, parents: np.ndarray) -> np.ndarray:
    """The probabilities of the dishes in the contexts of two bytes."""
    last = s.pair & 0xFFFF
    return totals.known(2, last, s.c2, s.t2) + totals.passed(2, last) * parents[s.up]


_SENT = "home int, bucket int, ids binary, tables binary"
_TABLES = "bucket int, home int, tables binary"
_TABLE_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _by_home(ids: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets of the contexts as tokens, and their places among ids."""
    home = homes(ids, buckets)
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    return [(int(home[part[0]]), part) for part in np.split(order, cuts)] if len(ids) else []


def _sent(bucket: int, ids: np.ndarray, tables: np.ndarray, buckets: int) -> pa.Table:
    """Tables that a bucket has in the contexts of whole tokens, to the buckets of these tokens."""
    rows = [(home, bucket, pack_planes(ids[part], 8), pack(tables[part])) for home, part in _by_home(ids, buckets)]
    return _packed([f.split()[0] for f in _SENT.split(", ")], _TABLE_TYPES, rows)


def _send_alone(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent(row["bucket"], unpack_planes(row["alone_ids"], 8), unpack(row["alone"]), buckets).to_batches()

    return run


def _merge_alone(sent: pa.Table) -> pa.Table:
    """One row for all that a bucket was sent."""
    parts = [(unpack_planes(r["ids"], 8), unpack(r["tables"])) for r in sent.to_pylist()]
    ids, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.bincount(place, np.concatenate([p[1] for p in parts]), len(ids))
    own = sent.column("home")[0].as_py()
    return _packed([f.split()[0] for f in _SENT.split(", ")], _TABLE_TYPES, [(own, own, pack_planes(ids, 8), pack(sums))])


def _send_listed(buckets: int):
    def run(fixed: pa.Table, moved: pa.Table) -> pa.Table:
        row = fixed.to_pylist()[0]
        ids, t3 = unpack_planes(row["ids"], 8), unpack(moved.column("t3")[0].as_py())
        return _sent(row["bucket"], ids, np.bincount(unpack_planes(row["whole"]), t3, len(ids)), buckets)

    return run


def _sum_tables(key: tuple, sent: pa.Table, alone: pa.Table) -> pa.Table:
    """All tables of each context that was asked for, to the bucket that asked; and, without a home, all of the
    bucket's own contexts, which are those of all its words, in order of their ids."""
    rows = sent.to_pylist()
    parts = [(unpack_planes(r["ids"], 8), unpack(r["tables"])) for r in (*rows, *alone.to_pylist())]
    ids, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.bincount(place, np.concatenate([p[1] for p in parts]), len(ids)).astype(np.int64)
    own = key[0].as_py()
    cuts = np.cumsum([len(p[0]) for p in parts])[: len(rows)]
    out = [(own, None, pack(sums))]
    out += [(r["bucket"], own, pack(sums[at])) for r, at in zip(rows, np.split(place, cuts), strict=False)]
    return _packed(["bucket", "home", "tables"], [pa.int32(), pa.int32(), pa.binary()], out)


def context_tables(fixed: DataFrame, moved: DataFrame, alone: DataFrame, buckets: int, folders: list[str]) -> DataFrame:
    """Tables in the contexts of whole tokens, summed over all buckets. alone: of the dishes that are not listed."""
    parts = fixed.select("bucket", "ids", "whole").groupBy("bucket"), moved.select("bucket", "t3").groupBy("bucket")
    sent = parts[0].cogroup(parts[1]).applyInArrow(_send_listed(buckets), _SENT)
    summed = sent.groupBy("home").cogroup(alone.groupBy("home")).applyInArrow(_sum_tables, _TABLES)
    return stored(summed, "tables", folders)


def _sit(totals: Totals, round_number: int, buckets: int):
    def run(fixed: pa.Table, given: pa.Table) -> pa.Table:
        row, *answers = sorted(given.to_pylist(), key=lambda r: r["t3"] is None)
        s = _seats(fixed.to_pylist()[0] | {k: row[k] for k in _MOVED})
        draw = np.random.default_rng([SEED, round_number, row["bucket"]])
        root, parents = _probabilities(s, totals)
        places = dict(_by_home(s.ids, buckets))
        contexts = np.zeros(len(s.ids), np.int64)
        for r in answers:
            contexts[places[r["home"]]] = unpack(r["tables"])

        def sit(level: int, customers, tables, own, p):
            # Other dishes' tables are in the first table's weight, the dish's own come with its tables.
            d = totals.discounts[level]
            return seat(customers, (STRENGTH + d * (tables - own)) * p, d, draw, d * p)

        alone = s.alone
        s.t3 = sit(3, s.c3, contexts[s.whole], s.t3, _middle(s, totals, parents)[s.listed])
        # Customers of a parent are the tables just drawn; its own tables of the round before are known.
        s.c2 = alone + np.bincount(s.listed, s.t3, len(s.pair)).astype(np.int64)
        s.t2 = sit(2, s.c2, totals.tables[2][s.pair & 0xFFFF], s.t2, parents[s.up])
        s.t1 = sit(1, s.c1, totals.tables[1][s.parent & 0xFF], s.t1, root[s.parent >> 8])
        s.t0 = sit(0, s.c0, totals.tables[0][0], s.t0, np.full(len(s.words), 1 / (totals.vocabulary + 1)))
        return _packed(["bucket", *_MOVED], [pa.int32(), *[pa.binary()] * len(_MOVED)], [(row["bucket"], *s.moved())])

    return run


@dataclass
class Model:
    """Written seatings of the rounds that count, the totals of each, and the tables of whole tokens' contexts."""

    samples: list[tuple[DataFrame, Totals]]
    fixed: DataFrame
    moved: list[DataFrame]
    tables: list[DataFrame]
    buckets: int
    folders: list[str]

    @property
    def tokens(self) -> int:
        return self.samples[0][1].tokens if self.samples else 0

    @property
    def vocabulary(self) -> int:
        return self.samples[0][1].vocabulary if self.samples else 0


def _messages(given: DataFrame, cells: int, buckets: int, codes: Codes) -> tuple[DataFrame, str, DataFrame]:
    """The messages, their folder and the documents of all cells, written. given: cell, text, learned and columns to keep."""
    schema = f"cell int, bucket int, {', '.join(f'{c} binary' for c in _PAIRS)}, message boolean, number long, n_tokens long, tokens binary, tails binary"
    kept = [c for c in given.columns if c not in ("cell", "text", "learned")]
    whole = given.select(*kept).schema
    for field in given.sparkSession.createDataFrame([], schema).schema:
        whole = whole.add(field)
    read = _read_cell(buckets, codes)

    def run(docs: pa.Table) -> pa.Table:
        return read(docs).select(whole.names)

    folders: list[str] = []
    messages, docs = stored_apart(given.repartition(cells, "cell").groupBy("cell").applyInArrow(run, whole), "message", "cells", folders)
    return messages.select(*_MESSAGE), folders[0], docs.select(*kept, "cell", "number", "n_tokens", "tokens", "tails")


def _fit(messages: DataFrame, folder: str, buckets: int, codes: Codes) -> tuple[Model, DataFrame]:
    """The model, and what the messages ask of it, which takes their place: their folder is emptied."""
    folders: list[str] = []
    schema = f"bucket int, cell int, asked boolean, {', '.join(f'{c} binary' for c in _ASKED + _FIXED + _MOVED + _ALONE)}"
    asked, first = stored_apart(messages.groupBy("bucket").applyInArrow(_first_seats(codes), schema), "asked", "seats", folders)
    emptied(messages.sparkSession, [folder])
    sent = first.select("bucket", *_ALONE).mapInArrow(_send_alone(buckets), _SENT)
    alone = stored(sent.groupBy("home").applyInArrow(_merge_alone, _SENT), "alone", folders)
    fixed, moved = first.select("bucket", *_FIXED), [first.select("bucket", *_MOVED)]
    before = totals(moved[0])
    samples, tables = [], []
    for number in range(ROUNDS):
        if not before.tokens:
            break
        tables = tables or [context_tables(fixed, moved[0], alone, buckets, folders)]
        given = moved[-1].unionByName(tables[-1].where("home IS NOT NULL"), allowMissingColumns=True)
        sat = fixed.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_sit(before, number, buckets), _schema(*_MOVED))
        moved.append(stored(sat, "seats", folders))
        after = totals(moved[-1])
        # Discounts stay those of the counts themselves.
        before = Totals(after.customers, after.tables, before.discounts, after.vocabulary, after.tokens)
        tables.append(context_tables(fixed, moved[-1], alone, buckets, folders))
        if number:
            samples.append((fixed.join(moved[-1], "bucket"), before))
    return Model(samples, fixed, moved[2:], tables[2:], buckets, folders), asked.select("bucket", "cell", *_ASKED)


def fit(texts: DataFrame, text: str, buckets: int) -> Model:
    """Learn from all rows. Null texts are empty: an end token. Without rows there is no sample."""
    cells = cell_count(texts, text, CELL_BYTES)
    cell = F.pmod(F.xxhash64(text), F.lit(cells)).cast("int")
    given = texts.select(cell.alias("cell"), F.col(text).cast("binary").alias("text"), F.lit(True).alias("learned"))
    codes = Codes(frequent_contexts(given))
    return _fit(*_messages(given, cells, buckets, codes)[:2], buckets, codes)[0]


def _pack_samples(values: list[np.ndarray]) -> bytes:
    """The mean of the samples to four bytes, and by how much of it all but the last differ from it, to two.

    The differences are small and weighed by still smaller ones, so two bytes lose less of them than four of the mean.
    """
    if not values:
        return b""
    mean = (sum(values) / len(values)).astype("<f4")
    parts = [pack_planes(mean.view("<u4")), *(pack_planes((v / mean - 1).astype("<f2").view("<u2"), 2) for v in values[:-1])]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack_samples(data: bytes) -> np.ndarray:
    parts = []
    while data:
        size = 4 + int.from_bytes(data[:4], "little")
        parts.append(data[4:size])
        data = data[size:]
    mean = unpack_planes(parts[0]).view("<f4").astype(float)
    shares = [unpack_planes(p, 2).view("<f2").astype(float) for p in parts[1:]]
    return mean * (1 + np.stack([*shares, -sum(shares, np.zeros(len(mean)))]))


_REPLY_NAMES = ["cell", "bucket", "counts", "tables", "customers", "taken", "middle"]
_REPLY_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
_REPLY = "cell int, bucket int, counts binary, tables binary, customers binary, taken binary, middle binary"


def _answer(samples: list[Totals]):
    """For each word of a message how often it was learned, and the tables of its context in each sample; for each pair of
    it and a context how often it was learned, and its tables in all samples; for its pairs with two bytes their
    probability in each."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        nothing = np.zeros(0, np.int64)
        empty = Seats([], *[nothing] * 6, np.zeros(0, np.uint64), *[nothing] * 4)
        seats, contexts = [empty] * len(samples), [nothing] * len(samples)
        rows = model.to_pylist()
        for fixed in (r for r in rows if r["words"] is not None):
            for row in (r for r in rows if r["t3"] is not None):
                seats[row["sample"]] = _seats(fixed | {c: row[c] for c in _MOVED})
            own = np.unique(context_ids(unpack_words(fixed["words"])), return_inverse=True)[1]
            for row in (r for r in rows if r["tables"] is not None):
                contexts[row["sample"]] = unpack(row["tables"]).astype(np.int64)[own]
        # The samples differ in tables only. Behind the last of all is what was not learned.
        s = seats[0] if seats else empty
        occurrences, c3 = np.append(s.occurrences, 0), s.c3
        contexts = [np.append(c, 0) for c in contexts]
        starts = np.searchsorted(s.pair[s.listed] >> 16, np.arange(len(s.words) + 1))
        tables = []
        for one, total in zip(seats, samples, strict=True):
            root, parents = _probabilities(one, total)
            own = total.known(2, one.pair & 0xFFFF, one.c2, one.t2)
            tables.append((total, np.append(root, total.unknown), np.append(parents, 0.0), np.append(own, 0.0)))
        out = []
        for row in (r for batch in asked.to_batches(8) for r in batch.to_pylist()):
            token, dish = unpack_planes(row["word"]).astype(np.int64), unpack_planes(row["dish"]).astype(np.int64)
            many = np.flatnonzero(dish > 1) if samples else nothing
            place = starts[np.repeat(token, unpack(row["sizes"], "<u4"))[many]] + dish[many] - 2
            customers = np.minimum(dish, 1)
            taken = customers * len(seats)
            customers[many] = c3[place]
            taken[many] = sum(one.t3[place] for one in seats)
            pairs, two = np.repeat(token, unpack(row["n_two"], "<u4")), unpack(row["two"], "<u2").astype(np.int64)
            last = two & 0xFF
            above, own = _found(s.parent, pairs << 8 | last), _found(s.pair, pairs << 16 | two)
            middle = []
            for total, root, parents, dishes in tables:
                lower = np.where(above < len(s.parent), parents[above], total.passed(1, last) * root[pairs])
                middle.append(dishes[own] + total.passed(2, two) * lower)
            steps = np.diff([c[token] for c in contexts], axis=0, prepend=0) if contexts else nothing
            # Small steps up and down in turn.
            arrays = occurrences[token], (steps << 1 ^ steps >> 63).ravel(), customers, taken
            out.append((row["cell"], row["bucket"], *(pack_planes(a, 8) for a in arrays), _pack_samples(middle)))
        return _packed(_REPLY_NAMES, _REPLY_TYPES, out)

    return run


def _add_up(samples: int, discount: float):
    """The sums of a cell's documents over the answers to their pairs."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
        docs = docs.sort_by("number")
        flat = unpack_planes(docs.column("tokens")[0].as_py()).astype(np.int64)
        last = unpack(docs.column("tails")[0].as_py(), "<u2").astype(np.int64)
        keys, place = np.unique(pairs_of(flat), return_inverse=True)
        context = keys & 0xFFFFFFFF
        counts, customers, taken = (np.concatenate([unpack_planes(r[c], 8) for r in rows]).astype(np.int64) for c in ("counts", "customers", "taken"))
        logs = np.zeros(len(keys))
        if samples:
            steps = np.concatenate([unpack_planes(r["tables"], 8).reshape(samples, -1) for r in rows], 1).astype(np.int64)
            tables = (steps >> 1 ^ -(steps & 1)).cumsum(0)
            middle = np.concatenate([_unpack_samples(r["middle"]) for r in rows], 1)
            pair = np.unique(keys >> 32 << 16 | last[context], return_inverse=True)[1]
            # The mean over the samples of what the dish has of its context's probability, and what the context passes on.
            own = customers * samples - discount * taken
            passed = sum((STRENGTH + discount * tables[i][context]) * middle[i][pair] for i in range(samples))
            logs = np.log10((own + passed) / (STRENGTH + counts[context]) / samples)
        base = np.log10(counts + 0.1)
        sizes = docs.column("n_tokens").to_numpy()
        starts = np.cumsum(sizes) - sizes
        columns = {
            "n_tokens": sizes,
            "n_known": np.add.reduceat((counts > 0).astype(np.int64)[flat], starts),
            "base_logs": np.add.reduceat(base[flat], starts),
            "score": np.add.reduceat(logs[place], starts),
        }
        given = docs.drop_columns(["cell", "number", "n_tokens", "tokens", "tails"])
        return pa.table([*given.columns, *map(pa.array, columns.values())], names=[*given.column_names, *columns])

    return run


def score(docs: DataFrame, key: str, text: str, learned: Column) -> DataFrame:
    """All rows and columns of docs but the text, and n_tokens, n_known, train_tokens, base_score and score.

    learned: which rows the model learns from; null means not. A-Z are lower-cased; tokens are runs
    without ASCII white space, and one end. base_score is the sum of add-0.1 unigram logs, score
    the model's log10 probability. A null or empty text is an end token alone. If nothing is
    learned from, the base has no counts and score is 0. Repeated rows stay repeated; an empty table
    stays empty. Columns named like an added one are not kept.
    """
    added = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    others = [c for c in docs.columns if c not in (*added, text)]
    buckets = cell_count(docs, text, BUCKET_BYTES)
    cells = cell_count(docs, text, CELL_BYTES)
    cell = F.pmod(F.xxhash64(F.col(key), F.xxhash64(text)), F.lit(cells)).cast("int")
    # No column of docs has the name of a column of the cells.
    kept = [F.col(c).alias(f"field{i}") for i, c in enumerate(others)]
    given = docs.select(*kept, cell.alias("cell"), F.col(text).cast("binary").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    codes = Codes(frequent_contexts(given))
    messages, folder, rows = _messages(given, cells, buckets, codes)
    model, asked = _fit(messages, folder, buckets, codes)
    discount = model.samples[0][1].discounts[3] if model.samples else 0.0
    samples = model.fixed
    for number, parts in enumerate(zip(model.moved, model.tables, strict=True)):
        for part in (parts[0], parts[1].where("home IS NULL").drop("home")):
            samples = samples.unionByName(part.withColumn("sample", F.lit(number)), allowMissingColumns=True)
    for name in (*_MOVED, "tables"):
        if name not in samples.columns:
            samples = samples.withColumn(name, F.lit(None).cast("binary"))
    replies = asked.groupBy("bucket").cogroup(samples.groupBy("bucket")).applyInArrow(_answer([t for _, t in model.samples]), _REPLY)
    replies = stored(replies, "replies", [])
    emptied(docs.sparkSession, model.folders)
    schema = rows.drop("cell", "number", "n_tokens", "tokens", "tails").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_logs", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    found = rows.groupBy("cell").cogroup(replies.groupBy("cell")).applyInArrow(_add_up(len(model.samples), discount), schema)
    base = F.col("base_logs") - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + 0.1 * (model.vocabulary + 1))))
    return found.select(
        *[F.col(f"field{i}").alias(c) for i, c in enumerate(others)],
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
