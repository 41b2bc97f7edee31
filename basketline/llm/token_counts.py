"""Token counts by byte-pair merging, with a heap over a linked list of symbols.

A tokenizer file in the JSON layout of the `tokenizers` library supplies the merges. A text is cut
into pieces as that file says; a piece starts as one symbol per byte, and the lowest-ranked
adjacent pair is merged until none is left. The number of tokens is the number of first symbols
less the number of merges, so no identifiers are looked up.

Pieces never cross ASCII white space, so texts are cut there first and counts are kept per word.
"""

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import worker_memory

#: Words whose counts a task keeps; beyond it the memory is emptied and filled anew.
KEPT_WORDS = 700_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for value in range(256):
        out.append(chr(value if value in plain else extra))
        extra += value not in plain
    return out


def merged_length(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """Symbols left after all merges: the lowest rank goes first, the leftmost pair among equals.

    ranks: by first symbol << 20 | second symbol; merged: the new symbol of each rank.
    """
    n = left = len(symbols)
    rank_of, pop, push = ranks.get, heapq.heappop, heapq.heappush
    shift = n.bit_length()
    mask = (1 << shift) - 1
    # The rank of the pair that starts at each symbol; an entry of the heap that has another is stale.
    now = [rank_of(first << 20 | second, -1) for first, second in zip(symbols, symbols[1:])]
    heap = [rank << shift | i for i, rank in enumerate(now) if rank >= 0]
    if not heap:
        return n
    heapq.heapify(heap)
    symbols, after, before = [*symbols], [*range(1, n + 1)], [*range(-1, n - 1)]
    now.append(-1)
    while heap:
        entry = pop(heap)
        i = entry & mask
        rank = entry >> shift
        if now[i] != rank:
            continue
        left -= 1
        symbol = symbols[i] = merged[rank]
        j = after[i]
        now[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            now[i] = rank = rank_of(symbol << 20 | symbols[k], -1)
            if rank >= 0:
                push(heap, rank << shift | i)
        else:
            now[i] = -1
        h = before[i]
        if h >= 0:
            now[h] = rank = rank_of(symbols[h] << 20 | symbol, -1)
            if rank >= 0:
                push(heap, rank << shift | h)
    return left


def word_counter(path: str) -> Callable[[bytes], int]:
    """A function that counts the tokens of a text without ASCII white space, as UTF-8 bytes."""
    import regex

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    ranks = {vocabulary[first] << 20 | vocabulary[second]: rank for rank, (first, second) in enumerate(model["merges"])}
    merged = [vocabulary[first + second] for first, second in model["merges"]]
    inner = [vocabulary[symbol] for symbol in byte_symbols()]
    last = [vocabulary[symbol + suffix] for symbol in byte_symbols()]
    steps = [step["type"] for step in spec["normalizer"]["normalizers"]]
    if steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE":
        raise ValueError(f"the layout of {path} is not supported: {steps}")
    pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    special = [token["content"] for token in spec["added_tokens"]]
    cut = regex.compile("|".join(map(regex.escape, special))) if special else None
    known: dict[str, int] = {}

    def count_piece(piece: str) -> int:
        if (n := known.get(piece)) is None:
            data = piece.encode()
            symbols = [*map(inner.__getitem__, data)]
            symbols[-1] = last[data[-1]]
            if len(known) >= KEPT_WORDS:
                known.clear()
            n = known[piece] = merged_length(symbols, ranks, merged)
        return n

    def count_plain(text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        # Capital sigma has two lower-case forms by its place; the library lowers each character alone.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return sum(map(count_piece, pieces.findall(text)))

    def count(word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if cut and "<|" in text:
            return sum(map(count_plain, cut.split(text))) + len(cut.findall(text))
        return count_plain(text)

    return count


class WordCounts(dict):
    """Token counts by word, counted when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.count = word_counter(path)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self[word] = self.count(word)
        return n


def token_counts(docs: DataFrame, text: str, path: str, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns to keep, n_bytes and n_tokens of each row's whole text, in one pass.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows stay repeated; other columns are
    not read. A text of any length is handled word by word, a word of any length in n log n.
    """
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long")
    names = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_memory(f"tokens {path}", lambda: WordCounts(path))
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(len(names)):
                data = value.as_py() or b""
                sizes.append(len(data))
                tokens.append(sum(map(counts.__getitem__, data.split())))
            arrays = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=[f.name for f in schema])

    given = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).cast("binary").alias("_text"))
    return given.mapInArrow(run, schema)
