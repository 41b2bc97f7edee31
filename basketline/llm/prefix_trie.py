"""The trie of conversation prefixes, by truncation peeling.

Texts do not move: a turn is a 16-byte digest of its role and text and its length. A conversation is the path
of its prefixes, each named by a chained digest. Conversations equal as a whole are one end; their ids are
range-sorted, packed into runs in parallel, and the runs of an end are hashed in order.

Ends are range-partitioned by their path, so that all below a prefix is next to each other. A partition peels
its part from the greatest depth up: the ends of a depth are merged with the nodes that the step before left,
cut by their last turn. What meets in a prefix is its node, and its sums are whole at once, since all that lies below
has been merged before. Only the prefixes of a partition's first and last path may have members elsewhere. Their
sums are merged across partitions, and peeled the same way: at most twice the greatest depth per partition.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import join_by_key
from basketline.session import written

#: Bytes of a key; of ids in a run; of paths in a partition, about.
KEY = 16
RUN_BYTES = 1 << 16
PARTITION_BYTES = 8 << 20

_RUN = "key binary, n long, least long, first long, ids string"
_END = "key binary, n long, least long, ends_sha256 string"


def digest(*parts: Column) -> Column:
    """16 bytes of a hash of the parts, whose lengths are part of it."""
    sized = [x for p in parts for x in (F.octet_length(p).cast("string").cast("binary"), F.lit(":").cast("binary"), p)]
    return F.substring(F.unhex(F.sha2(F.concat(*sized), 256)), 1, 16)


def turn_arrays(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Per conversation (column conv): its turns in order, an array of digest and chars.

    Turns come by turn (null first), then role, then the digest of role and text, so ties and repeated
    rows have one order and are all kept. Null roles and texts are empty. Rows with a null id are
    one conversation.
    """
    said, spoken = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.struct(
            F.col(turn).isNotNull().alias("known"),
            F.col(turn).alias("turn"),
            said.alias("role"),
            digest(said.cast("binary"), spoken.cast("binary")).alias("digest"),
            F.length(spoken).cast("long").alias("chars"),
        ).alias("turn"),
    )
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select("conv", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversation c with the first h turns of conversation c - c % 100 (none if there is no such one) before its
    own ones after the first h; h is crc32 of c in decimals, modulo 6. A null id keeps its turns.

    A conversation gives its turns to fewer than 200 others, so no key is hot.
    """
    given = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    rows = conversations.withColumn("_base", F.col("conv") - F.col("conv") % 100).withColumn("_taken", F.coalesce(given, F.lit(0)).cast("int"))
    bases = conversations.filter("conv % 100 = 0").select(F.col("conv").alias("_base"), F.slice("turns", 1, 5).alias("_first"))
    rows = rows.join(bases, "_base", "left")
    ahead = F.slice(F.coalesce("_first", F.slice("turns", 1, 0)), F.lit(1), F.col("_taken"))
    return rows.select("conv", F.concat(ahead, F.slice("turns", F.col("_taken") + 1, F.size("turns"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """Per conversation its path, the keys of its prefixes one behind the other, and the chars of its turns."""

    def step(path: Column, turn: Column) -> Column:
        key = digest(F.substring(path, -KEY, KEY), turn["digest"])
        return F.concat(path, key)

    return conversations.select("conv", F.aggregate("turns", F.lit(b""), step).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) as runs of comma-joined ids. A null id counts and has no digits."""
    out: list[tuple] = []
    key, n, least, ids, size = None, 0, None, [], 0

    def close() -> None:
        out.append((key, n, least, least, ",".join(ids) if ids else None))

    def batch() -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["key", "n", "least", "first", "ids"]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for rows in batches:
        for own, conv in zip(rows.column("key").to_pylist(), rows.column("conv").to_pylist(), strict=True):
            if n and (own != key or size >= RUN_BYTES):
                close()
                n, least, ids, size = 0, None, [], 0
                if len(out) >= 1000:
                    yield batch()
                    out.clear()
            key = own
            n += 1
            if conv is not None:
                if least is None:
                    least = conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
    if n:
        close()
    yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as one row per key: members, the least of them, and the hash of all their ids."""
    out: list[tuple] = []
    key, n, least, some, state = None, 0, None, False, hashlib.sha256()

    def batch() -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        names = ["key", "n", "least", "ends_sha256"]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for rows in batches:
        for own, count, first, ids in zip(*(rows.column(c).to_pylist() for c in ("key", "n", "first", "ids")), strict=True):
            if n and own != key:
                out.append((key, n, least, state.hexdigest()))
                n, least, some, state = 0, None, False, hashlib.sha256()
                if len(out) >= 10_000:
                    yield batch()
                    out.clear()
            key = own
            n += count
            if ids is not None:
                least = first if least is None else least
                state.update((("," if some else "") + ids).encode())
                some = True
    if n:
        out.append((key, n, least, state.hexdigest()))
    yield batch()


def ends(found: DataFrame) -> DataFrame:
    """Per distinct whole conversation: path, chars, its members (n), the least of them, and ends_sha256.

    The ids of a hot end are spread over range partitions and come to its task as runs.
    """
    keyed = written(found.withColumn("key", F.substring("path", -KEY, KEY)), "trie-paths")
    order = keyed.select("key", "conv")
    runs = order.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_runs, _RUN)
    sums = runs.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("first")).mapInArrow(_hashed, _END)
    distinct = keyed.groupBy("key").agg(F.first(F.struct("path", "chars")).alias("way"))
    return sums.join(distinct, "key").select("way.*", "n", "least", "ends_sha256")


_NODE = {
    "shared": pa.bool_(),
    "key": pa.binary(),
    "parent": pa.binary(),
    "depth": pa.int64(),
    "chars": pa.int64(),
    "n_convs": pa.int64(),
    "least": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
    "parent_known": pa.bool_(),
    "parent_conv_id": pa.int64(),
}
_NODES = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'binary' if t == pa.binary() else 'string' if t == pa.string() else 'long'}" for n, t in _NODE.items())


def _least(one: int | None, other: int | None) -> int | None:
    return other if one is None else one if other is None else min(one, other)


class Node:
    """A prefix of some length, and the sums of what is known of it."""

    def __init__(self, chars: int):
        self.chars, self.n, self.least, self.ends = chars, 0, None, None
        self.children = self.leaves = self.saved = 0
        self.shared = False

    def close(self) -> None:
        """All below has been merged."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.chars

    def add_child(self, other: "Node") -> None:
        self.n += other.n
        self.least = _least(self.least, other.least)
        self.children += 1
        self.leaves += other.leaves
        self.saved += other.saved

    def merge(self, n: int, least: int | None, children: int, leaves: int, saved: int, ends: str | None) -> None:
        self.n += n
        self.least = _least(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = self.ends or ends

    def row(self, shared: bool, key: bytes, parent: bytes | None, depth: int, known: bool, parent_id: int | None) -> tuple:
        sums = (self.chars, self.n, self.least, self.children, self.leaves, self.saved, self.ends)
        return shared, key, parent, depth, *sums, known, parent_id


def _node_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(_NODE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE.values(), strict=True)], names=list(_NODE))

    for row in rows:
        held.append(row)
        if len(held) >= 10_000:
            yield batch()
            held.clear()
    yield batch()


def peel(ended: list[tuple]) -> Iterator[tuple]:
    """The nodes of some ends (path, chars, n, least, ends_sha256), deepest first.

    A prefix of the first or the last path is shared: its sums are without those of its shared children, and it is
    not closed. Of other nodes the parent's id is known unless the parent is shared.
    """
    first, last = min(e[0] for e in ended), max(e[0] for e in ended)
    by_depth = defaultdict(list)
    for end in ended:
        by_depth[len(end[0]) // KEY].append(end)
    level: dict[bytes, Node] = {}
    waiting: list[tuple[bytes, Node]] = []
    # For each prefix the lengths of the turns of an end below it.
    ways: dict[bytes, list[int]] = {}
    for depth in range(max(by_depth), -1, -1):
        # Survivors are cut by their last turn, and meet the ends of this depth.
        above: dict[bytes, Node] = {}
        kept: dict[bytes, list[int]] = {}
        for path, node in level.items():
            cut = path[:-KEY]
            if cut not in above:
                kept[cut] = ways[path]
                above[cut] = Node(ways[path][depth - 1] if depth else 0)
            if not node.shared:
                above[cut].add_child(node)
        for path, chars, n, least, ends_sha256 in by_depth[depth]:
            if path not in above:
                kept[path] = chars
                above[path] = Node(chars[depth - 1] if depth else 0)
            above[path].merge(n, least, 0, 0, 0, ends_sha256)
        for path, node in above.items():
            node.shared = first.startswith(path) or last.startswith(path)
            if not node.shared:
                node.close()
        for path, node in waiting:
            parent = above[path[:-KEY]]
            known = not node.shared and not parent.shared
            yield node.row(node.shared, path[-KEY:], path[-2 * KEY : -KEY], depth + 1, known, parent.least if known else None)
        level, ways, waiting = above, kept, list(above.items())
    for path, node in waiting:
        yield node.row(node.shared, path, None, 0, not node.shared, None)


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a range partition."""
    names = ("path", "chars", "n", "least", "ends_sha256")
    ended = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
    if ended:
        yield from _node_batches(peel(ended))


def _peel_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared nodes of all partitions, merged and peeled."""
    levels: dict[int, dict[bytes, tuple[Node, bytes | None]]] = defaultdict(dict)
    for batch in batches:
        for row in batch.to_pylist():
            node, _ = levels[row["depth"]].setdefault(row["key"], (Node(row["chars"]), row["parent"]))
            node.merge(row["n_convs"], row["least"], row["n_children"], row["n_leaves"], row["saved_tokens"], row["ends_sha256"])

    def rows() -> Iterator[tuple]:
        for depth in sorted(levels, reverse=True):
            for node, parent in levels[depth].values():
                node.close()
                if depth:
                    levels[depth - 1][parent][0].add_child(node)
        for depth, level in levels.items():
            for key, (node, parent) in level.items():
                yield node.row(True, key, parent, depth, True, levels[depth - 1][parent][0].least if depth else None)

    yield from _node_batches(rows())


def trie(found: DataFrame) -> DataFrame:
    """The nodes of the trie of paths (columns conv, path and chars; see `paths`): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the least id of a node's members, null if all have a null id; such a member counts, but has no
    digits in ends_sha256. Conversations without turns end at the root. Equal conversations are
    members of the same nodes. Without conversations there is no root. The paths of a partition, of some
    PARTITION_BYTES or of one conversation, must fit into a task's memory.
    """
    spark = found.sparkSession
    ended = written(ends(found), "trie-ends")
    size = ended.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    nodes = written(ended.repartitionByRange(parts, "path").mapInArrow(_peel, _NODES), "trie-nodes")
    shared = written(nodes.filter("shared").repartition(1).mapInArrow(_peel_shared, _NODES), "trie-shared")
    own = nodes.filter("NOT shared")
    facts = shared.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    open_ = own.filter("NOT parent_known").drop("parent_conv_id")
    below = join_by_key(open_, facts.filter("_n > 0"), "parent", "_n", open_.count())
    every = own.filter("parent_known").unionByName(below).unionByName(shared)
    return every.select(
        F.col("least").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of rebuilt conversations; other columns of turns are not read. See `trie`."""
    return trie(paths(rebuilt(written(turn_arrays(turns, conv_id, turn, role, text), "trie-turns"))))
