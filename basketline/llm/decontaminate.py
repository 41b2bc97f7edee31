"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, other words lose case and punctuation. Windows
of eight template words are hash-joined between benchmark items and documents. Where windows of an
item lie in a document in the same order and distance, the words that fill the placeholders
are compared: each filling of the item must stand for one filling of the document, and the
other way round. So a question that was only given new numbers or names is found, and a text that
happens to share a pattern of placeholders is not.

A capitalised word is a name. At the start of a sentence it may as well be a common word, so there it has
both templates, in items and in documents, and the fillings decide.

Windows are joined by their literal words (the fillings) too. These find copies whatever they consist
of: items dense in numbers or names have no template of enough plain words, and items of fewer words
than a window have one window. An item of fewer than SENTENCE words is found only where it makes up
a sentence.

The benchmark is the stated query set: its windows go to all tasks in blocks of bounded size. There is
one pass over the documents per block, and a plan holds one block.
"""

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import worker_memory
from basketline.session import scratch_path, written

WINDOW = 8
#: Words of a template window that are no placeholders, at least. Literal windows have no such bound.
PLAIN = 5
#: Shorter items count only as a sentence of their own.
SENTENCE = 3
#: Words of an item that a document must cover, or all if the item is shorter.
COVERED = 13
BLOCK_WINDOWS = 1 << 20
KEPT_WORDS = 600_000
#: Bytes of text that a task looks at together.
TOGETHER = 1 << 16

NUMBER, NAME, UNIT, QUANTITY = "<number>", "<name>", "<unit>", "<quantity>"
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml l s sec min h hr ms hz khz mhz ghz w kw mw v a ma n j kj cal kcal pa kpa bar "
    "percent degrees meters metres kilometers kilometres miles inches feet grams kilograms pounds ounces liters litres gallons "
    "seconds minutes hours days weeks months years dollars cents euros usd eur gbp kb mb gb tb".split()
)
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?$")
_QUANTITY = re.compile(r"[+-]?\d+(?:[.,]\d+)*-?([^\W\d_]+)$")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def word_facts(raw: str) -> tuple[str, str, str, bool, bool, bool]:
    """Of a raw word: its filling, its template as a common word and as it is capitalised, and
    whether it is a number, may be a unit, and ends a sentence. Without a letter or digit it is no word."""
    if raw.isalpha():
        core, ends = raw, False
    else:
        core = _EDGES.sub("", raw)
        ends = raw.rstrip("\"'”’)]»").endswith((".", "!", "?", ":", "…"))
    low = core.lower()
    if not core:
        return "", "", "", False, False, ends
    if low[0].isdigit():
        if _NUMBER.match(low):
            return low, NUMBER, NUMBER, True, False, ends
        if (m := _QUANTITY.match(low)) and m[1] in UNITS:
            return low, QUANTITY, QUANTITY, False, False, ends
    return low, low, NAME if core[0].isupper() else low, False, low in UNITS, ends


_IS_NUMBER, _IS_UNIT, _ENDS, _IS_WORD = 1, 2, 4, 8


@dataclass
class Words:
    """The words of some texts, one text after the other."""

    #: Template hashes with names wherever a word is capitalised, and with common words at sentence starts.
    named: np.ndarray
    common: np.ndarray
    #: Hashes of the fillings, the words' numbers, and the texts they are in.
    literal: np.ndarray
    ids: np.ndarray
    owner: np.ndarray
    #: Whether a sentence starts at the word.
    begins: np.ndarray


class Vocabulary(dict):
    """Numbers of the words seen so far, and their facts as arrays by number."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.words: list[bytes] = []
        self.low, self.common, self.named = (np.zeros(1024, np.uint64) for _ in range(3))
        self.flags = np.zeros(1024, np.uint8)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        low, common, named, is_number, is_unit, ends = word_facts(word.decode("utf-8", "replace"))
        self.words.append(word)
        if number >= len(self.flags):
            self.low, self.common, self.named, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.common, self.named, self.flags))
        self.low[number] = hashed = _hash(low)
        self.common[number] = hashed if common == low else _hash(common)
        self.named[number] = self.common[number] if named == common else _hash(named)
        self.flags[number] = _IS_NUMBER * is_number | _IS_UNIT * is_unit | _ENDS * ends | _IS_WORD * (low != "")
        return number

    def filling(self, number: int) -> str:
        """The word without case and punctuation."""
        return word_facts(self.words[number].decode("utf-8", "replace"))[0]

    def read(self, texts: list[bytes]) -> Words:
        if len(self) > KEPT_WORDS:
            self.forget()
        words = [text.split() for text in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        flags = self.flags[ids]
        begins = np.ones(len(ids), bool)
        begins[1:] = (owner[1:] != owner[:-1]) | ((flags[:-1] & _ENDS) > 0)
        # A mark between two words may end the sentence but is no word itself.
        kept = (flags & _IS_WORD) > 0
        if not kept.all():
            places = np.flatnonzero(kept)
            after = np.searchsorted(places, np.flatnonzero(begins))
            ids, owner, flags = ids[kept], owner[kept], flags[kept]
            begins = np.zeros(len(ids), bool)
            begins[after[after < len(ids)]] = True
            begins[1:] |= owner[1:] != owner[:-1]
        named = self.named[ids]
        common = np.where(begins, self.common[ids], named)
        units = np.flatnonzero(flags & _IS_UNIT)
        units = units[units > 0]
        units = units[((flags[units - 1] & _IS_NUMBER) > 0) & (owner[units - 1] == owner[units])]
        named[units] = common[units] = _PLACES[UNIT]
        return Words(named, common, self.low[ids], ids, owner, begins)


_PLACES = {name: np.uint64(_hash(name)) for name in (NUMBER, NAME, UNIT, QUANTITY)}
_PLACE_HASHES = np.array([*_PLACES.values()], np.uint64)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of length words, built from runs of 1, 2, 4, ... words."""
    if len(hashes) < length:
        return hashes[:0]
    have, size, factor = hashes ^ (hashes >> np.uint64(31)), 1, np.array([_MULTIPLIER])
    out, done = None, 0
    while length:
        if length & 1:
            if out is None:
                out, done = have, size
            else:
                n = len(have) - done
                out = out[:n] * factor + have[done:]
                done += size
        length >>= 1
        if length:
            have = have[: len(have) - size] * factor + have[size:]
            size, factor = size * 2, np.multiply(factor, factor, dtype=np.uint64)
    out = out[: len(hashes) - done + 1]
    return out ^ (out >> np.uint64(29))


@dataclass
class Block:
    """Some benchmark items: words, fillings, and their windows by kind and length, sorted by hash."""

    keys: list
    words: list[Words]
    slots: list[np.ndarray]
    fillings: list[list[str]]
    #: By (literal, length): hashes, items and first words.
    windows: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _windows(words: list[Words]) -> dict[tuple[bool, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    found = defaultdict(list)
    for item, own in enumerate(words):
        length = min(WINDOW, len(own.ids))
        if not length:
            continue
        found[True, length].append((window_hashes(own.literal, length), np.arange(len(own.ids) - length + 1), item))
        for template in (own.named, own.common):
            plain = np.convolve(~np.isin(template, _PLACE_HASHES), np.ones(length, int), "valid")
            places = np.flatnonzero(plain >= PLAIN)
            if len(places):
                found[False, length].append((window_hashes(template, length)[places], places, item))
    out = {}
    for kind, parts in found.items():
        hashed, starts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        items = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
        # Where both templates of a window are the same it is one entry.
        _, first = np.unique(np.stack([hashed, items.astype(np.uint64), starts.astype(np.uint64)]), axis=1, return_index=True)
        first = first[np.argsort(hashed[first], kind="stable")]
        out[kind] = hashed[first], items[first], starts[first]
    return out


def blocks(benchmark: DataFrame, key: str, text: str, size: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The items in blocks of at most size windows (or one item); one block is on the driver at a time.

    An item of fewer than WINDOW words is one window; an item without words has none, so it finds
    nothing. Null texts are empty.
    """
    vocabulary = Vocabulary()
    keys, words, fillings, total = [], [], [], 0

    def block() -> Block:
        return Block(keys, words, [np.isin(w.named, _PLACE_HASHES) for w in words], fillings, _windows(words))

    for row in benchmark.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).toLocalIterator():
        own = vocabulary.read([bytes(row["text"] or b"")])
        if keys and total + len(own.ids) > size:
            yield block()
            keys, words, fillings, total = [], [], [], 0
        keys.append(row["key"])
        words.append(own)
        fillings.append([vocabulary.filling(i) for i in own.ids])
        total += len(own.ids)
    if keys:
        yield block()


def finder(block: Block) -> Callable[[list[bytes]], list[list[tuple]]]:
    """A function that gives, for each of some texts, rows of (item, windows, covered words, first
    word, last word, refilled).

    Words are counted from 0 among the words of the text; refilled: how many placeholders hold another
    word than in the item.
    """
    vocabulary = worker_memory("decontaminate", Vocabulary)
    shift = np.uint64(64 - 22)
    filters = {}
    for kind, (hashed, _, _) in block.windows.items():
        filters[kind] = np.zeros(1 << 22, bool)
        filters[kind][(hashed >> shift).astype(np.int64)] = True

    def place(item: int, offset: int, starts: set[int], ids: np.ndarray, in_a_row: bool) -> tuple | None:
        """The row of an item at a place of a text, if enough of it is covered and its fillings agree."""
        size = len(block.fillings[item])
        length = min(WINDOW, size)
        covered = np.zeros(size, bool)
        for start in starts:
            covered[start : start + length] = True
        if in_a_row:
            # Only the runs that are long enough by themselves.
            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))).reshape(-1, 2)
            for first, last in edges:
                covered[first:last] = last - first >= min(COVERED, size)
        if covered.sum() < min(COVERED, size):
            return None
        there, back, refilled = {}, {}, 0
        for i in np.flatnonzero(covered & block.slots[item]):
            ours, theirs = block.fillings[item][i], vocabulary.filling(ids[i + offset])
            if there.setdefault(ours, theirs) != theirs or back.setdefault(theirs, ours) != ours:
                return None
            refilled += ours != theirs
        places = np.flatnonzero(covered) + offset
        return item, len(starts), int(covered.sum()), int(places[0]), int(places[-1]), refilled

    def best_places(matched: dict, ids: np.ndarray) -> list[tuple]:
        best: dict[int, tuple] = {}
        for (item, offset), (literal, every) in matched.items():
            # So many words in a row that are there literally count whatever stands in the placeholders around them.
            for starts, in_a_row in ((every, False), (literal, True)):
                if starts and (row := place(item, offset, starts, ids, in_a_row)):
                    best[item] = max(best.get(item, row), row, key=lambda r: (r[2], -r[3]))
                    break
        return [best[item] for item in sorted(best)]

    def find(texts: list[bytes]) -> list[list[tuple]]:
        words = vocabulary.read(texts)
        n = len(words.ids)
        begin = np.searchsorted(words.owner, np.arange(len(texts) + 1))
        matched: dict[int, dict] = defaultdict(lambda: defaultdict(lambda: (set(), set())))
        unsure = np.concatenate([[0], np.cumsum(words.named != words.common)])
        for (is_literal, length), (hashed, items, starts) in block.windows.items():
            if length > n:
                continue
            for hashes in (words.literal,) if is_literal else (words.named, words.common):
                windows = window_hashes(hashes, length)
                places = np.flatnonzero(filters[is_literal, length][(windows >> shift).astype(np.int64)])
                places = places[words.owner[places] == words.owner[places + length - 1]]
                if hashes is words.common:
                    places = places[unsure[places + length] > unsure[places]]
                if length < SENTENCE:
                    whole = np.append(words.begins, True)
                    places = places[whole[places] & whole[places + length]]
                left = np.searchsorted(hashed, windows[places], "left")
                right = np.searchsorted(hashed, windows[places], "right")
                for at, a, b in zip(places, left, right, strict=True):
                    for k in range(a, b):
                        item, start = int(items[k]), int(starts[k])
                        own = block.words[item]
                        here, span = hashes[at : at + length], slice(start, start + length)
                        if not any(np.array_equal(here, x[span]) for x in ((own.literal,) if is_literal else (own.named, own.common))):
                            continue
                        text = int(words.owner[at])
                        literal, every = matched[text][item, int(at - begin[text]) - start]
                        every.add(start)
                        if is_literal:
                            literal.add(start)
        out: list[list[tuple]] = [[] for _ in texts]
        for text, found in matched.items():
            out[text] = best_places(found, words.ids[begin[text] : begin[text + 1]])
        return out

    return find


def _with_last(items: Iterator[Block]) -> Iterator[tuple[Block, bool]]:
    """The blocks that have windows, and whether each is the last."""
    held = None
    for block in items:
        if not block.windows:
            continue
        if held is not None:
            yield held, False
        held = block
    if held is not None:
        yield held, True


def _in_batches(texts: Iterator[bytes], find: Callable) -> Iterator[list[tuple]]:
    """What is found in each text, looking at some TOGETHER bytes at a time."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield from find(held)
            held, size = [], 0
    if held:
        yield from find(held)


def matches(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """One row per document and benchmark item in it, the item's best place (most words, then first).

    The columns to keep, item_id, n_windows, n_words (covered), first_word, last_word, refilled.
    Null and empty texts hold nothing; repeated rows are found each, as are repeated items; an
    empty benchmark or table gives no rows. Whole texts are read, whatever their length.
    """
    schema = docs.select(*keep).schema.add("item_id", benchmark.schema[item].dataType)
    for name in ("n_windows", "n_words", "first_word", "last_word", "refilled"):
        schema = schema.add(name, "long")
    names = [f"_{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).cast("binary").alias("_text"))

    def search(block: Block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = finder(block)
            for batch in batches:
                rows, found = [], []
                texts = (value.as_py() or b"" for value in batch.column(len(names)))
                for number, hits in enumerate(_in_batches(texts, find)):
                    rows += [number] * len(hits)
                    found += hits
                taken = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(names))]
                items = pa.array([block.keys[hit[0]] for hit in found])
                counts = [pa.array([hit[i] for hit in found], pa.int64()) for i in range(1, 6)]
                yield pa.RecordBatch.from_arrays([*taken, items if found else pa.array([], pa.int64()), *counts], names=[f.name for f in schema])

        return run

    spark = docs.sparkSession
    folder, number = None, 0
    for block, last in _with_last(blocks(benchmark, item, item_text)):
        rows = given.mapInArrow(search(block), schema)
        if last and not number:
            return rows
        # Each block is a job of its own, so that no plan holds two.
        folder = folder or scratch_path(spark, "benchmark-matches")
        rows.write.parquet(f"{folder}/{number}")
        number += 1
    if folder is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{i}" for i in range(number)])


def clean(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """The rows of docs, unchanged, that hold no benchmark item; cases as for matches().

    One pass over the documents per block of the benchmark, each written before the next.
    """
    place = docs.columns.index(text)

    def sieve(block: Block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = finder(block)
            for batch in batches:
                texts = ((value.as_py() or "").encode() for value in batch.column(place))
                free = [not hits for hits in _in_batches(texts, find)]
                yield batch.filter(pa.array(free, pa.bool_()))

        return run

    for block, last in _with_last(blocks(benchmark, item, item_text)):
        docs = docs.mapInArrow(sieve(block), docs.schema)
        if not last:
            docs = written(docs, "decontaminated")
    return docs
