import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from basketline.llm import infilling, prefix_trie, simhash
from basketline.llm.common import table
from basketline.llm.queries import QUERIES

# SimHash


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    counts = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(shingles))


def plain_components(marks):
    """The least id reachable, pair by pair; marks: (id, fingerprint)."""
    found = sorted(set(f for _, f in marks))
    values = np.array(found, np.uint64)
    root = list(range(len(found)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(found)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            root[top(int(j))] = top(i)
    least = {}
    for i, f in marks:
        r = top(found.index(f))
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return {f: least.get(top(n)) for n, f in enumerate(found)}


def test_fingerprints():
    texts = ["", " \n", "One", "one two", "a b c", "A b  C\td", "É é É", "x y z " * 300, "z" * 100_000, "w1 w2 w3 w4 " * 3]
    found = simhash.fingerprints(iter([t.encode() for t in texts]))
    assert [int(f) for f in found] == [plain_fingerprint(t) for t in texts]
    draw = np.random.default_rng(1)
    sizes = np.array([1, 2, 254, 255, 256, 700])
    hashes = draw.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for size, start, got in zip(sizes, np.cumsum(sizes) - sizes, simhash.majority(hashes, sizes), strict=True):
        bits = (hashes[start : start + size, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert int(got) == sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > size)


def test_thresholds_miss_no_link():
    """Every allocation keeps the sum that the pigeonhole principle asks for, at the least cost of all."""
    draw = np.random.default_rng(2)
    costs = [np.concatenate([np.zeros((200, 1)), np.sort(draw.exponential(5, (200, 4)) ** 3, axis=1)], 1) for _ in range(4)]
    chosen = simhash.allocate(costs)
    assert ((chosen + 1).sum(1) == simhash.DISTANCE + 1).all()
    every = [e for e in np.ndindex(5, 5, 5, 5) if sum(e) == simhash.DISTANCE + 1]
    best = np.min([sum(c[:, e] for c, e in zip(costs, option, strict=True)) for option in every], axis=0)
    got = sum(c[np.arange(200), e + 1] for c, e in zip(costs, chosen.T, strict=True))
    assert np.allclose(got, best)


def test_correlated_bits_share_a_part():
    draw = np.random.default_rng(3)
    bits = draw.integers(0, 2, (4000, 64)).astype(np.uint8)
    together = [3, 11, 19, 40, 41, 60]
    bits[:, together] = bits[:, :1] ^ (draw.random((4000, len(together))) < 0.1)
    common = bits.T.astype(float) @ bits
    parts = simhash.grouped_bits(simhash.correlations(common, 4000), 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any(set(together) <= set(p) for p in parts)


def test_estimates_count_frequent_values():
    parts = [list(range(0, 32)), list(range(32, 64))]
    even = np.full(256, 1 / 256)
    shares = [[(list(range(8 * k, 8 * k + 8)), even) for k in range(4)] for _ in range(2)]
    value = np.array([5], np.uint64)
    how = simhash.Plan(parts, 1000, shares, [(value, np.array([700])), (np.zeros(0, np.uint64), np.zeros(0, np.int64))])
    assert how.candidates(0, np.array([5, 4, 0], np.uint64))[:, 0].tolist() == [700, pytest.approx(1000 / 2**32), pytest.approx(1000 / 2**32)]
    assert how.candidates(0, np.array([4], np.uint64))[0, 1] == 700
    # A probe of a hot value costs more, so the other part gets its threshold.
    dear = simhash.Plan(parts, 10**9, shares, [(value, np.array([10**8])), how.frequent[1]])
    assert dear.thresholds(np.array([5], np.uint64)).tolist() == [[-1, 3]]


@pytest.mark.parametrize("parts", [(2,), (3,), (4,), (6,)])
def test_edges_connect_what_links_do(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "PARTS", parts)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    draw = random.Random(4)
    values = set()
    for _ in range(60):
        centre = draw.getrandbits(64)
        for _ in range(12):
            values.add(centre)
            for _ in range(draw.choice([1, 2, 3, 4, 5])):
                centre ^= 1 << draw.randrange(64)
    hot = draw.getrandbits(64)
    values |= {hot ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(300)} | {0, 2**64 - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in simhash.edges(nodes).collect():
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        root[top(a)] = top(b)
    groups = defaultdict(set)
    for v in values:
        groups[top(v)].add(v)
    expected = defaultdict(set)
    for v, least in plain_components([(v, v) for v in values]).items():
        expected[least].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    docs += [(None, docs[0][1]), (None, "quite alone here, no other"), (900_001, None), (900_002, ""), (900_003, " \n"), (900_004, "ONE two"), (900_005, "one TWO"), (900_004, "ONE two"), (900_006, "long " * 200_000)]
    rows = spark.createDataFrame([(i, t, i, t, 7) for i, t in docs], "doc_id long, text string, fingerprint long, id string, component_id int")
    marks = [(i, plain_fingerprint(t)) for i, t in docs]
    least = plain_components(marks)
    got = Counter((r["id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(rows, "doc_id", "text").collect())
    assert got == Counter((i, f, least[f]) for i, f in marks)
    assert simhash.near_duplicates(rows.limit(0), "doc_id", "text").count() == 0
    found = {r["doc_id"]: r["fingerprint"] for r in QUERIES["op11_simhash_near_dedup"](spark, small).collect()}
    assert found == {i: f"{f:016x}" for i, f in marks if i is not None and i < 900_000}


# Prefix trie


def plain_trie(turns):
    """Node rows from conversations (id: ordered (role, text) pairs), node by node."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, said in turns.items():
        for d in range(len(said) + 1):
            members[said[:d]].add(c)
        ends[said].append(c)
    children = Counter(node[:-1] for node in members if node)
    below = {node: [0, 0] for node in members}
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]][0] += node not in children
            below[node[:d]][1] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0

    def first(node):
        return min((c for c in members[node] if c is not None), default=None)

    return Counter(
        (first(n), len(n), first(n[:-1]) if n else None, len(members[n]), children[n], *below[n], hashlib.sha256(",".join(map(str, sorted(c for c in ends[n] if c is not None))).encode()).hexdigest())
        for n in members
    )


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        mark = hashlib.sha256(f"{len(role.encode())}:{role}{len(text.encode())}:{text}".encode()).digest()[:16]
        own[c].append((turn is not None, turn or 0, role, mark, text))
    turns = {c: tuple((role, text) for _, _, role, _, text in sorted(said)) for c, said in own.items()}
    out = {}
    for c, said in turns.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = () if c is None else turns.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), ())
        out[c] = base[:h] + said[h:]
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def as_rows(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 16)
    monkeypatch.setattr(prefix_trie, "PARTITION_BYTES", 1 << 11)
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 420, 3), 100, 200, 300, -7, -150, -100, None]:
        for turn in range(draw.choice([0, 1, 2, 3, 9])):
            rows.append((c, draw.choice([turn, turn, 0, None]), draw.choice(["user", "assistant", None, "é"]), draw.choice(["", None, "a", "b", "日本", "x" * 3000])))
    rows += [rows[5], rows[5], (901, 0, "user", None), (902, 0, None, ""), (7_000_000_000, 0, "user", "far")]
    # Copies by the hundred end at one node.
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1600) if c % 100 for t in range(7)]
    frame = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int, n_convs int")
    assert as_rows(prefix_trie.conversation_trie(frame)) == plain_trie(plain_rebuilt(rows))
    assert prefix_trie.conversation_trie(frame.limit(0)).count() == 0


def test_trie_query(spark, small):
    given = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(QUERIES["op12_prefix_trie"](spark, small)) == plain_trie(plain_rebuilt(given))


# Fill-in-the-middle


def plain_infill(key, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_frames_are_seekable():
    compressor, read = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    text = ("é日本" + "ab<P" * 5 + "😀\n") * 9000
    data = text.encode()
    frames = infilling.pack(data, compressor)
    assert len(frames) > 3
    assert frames[-1][:2] == (len(text), len(data))
    assert b"".join(read.decompress(f[2]) for f in frames) == data
    # One zstandard stream, and each frame on its own is text.
    stream = zstandard.ZstdDecompressor().stream_reader(b"".join(f[2] for f in frames), read_across_frames=True)
    assert stream.read() == data
    for f in frames:
        read.decompress(f[2]).decode()
    opened = []

    def counted(frame):
        opened.append(frame)
        return read.decompress(frame)

    for low, high in [(0, 0), (0, len(text)), (1, 2), (frames[0][0], frames[1][0]), (5, len(text) - 1), (frames[0][0] - 1, frames[2][0] + 1)]:
        for form in ("psm", "spm"):
            opened.clear()
            out = infilling.infill(frames, form, low, high, compressor, counted)
            assert len(opened) <= 2
            parts = {"p": "<P>" + text[:low], "m": "<M>" + text[low:high], "s": "<S>" + text[high:]}
            expected = "".join(parts[k] for k in form)
            assert b"".join(read.decompress(f[2]) for f in out).decode() == expected
            reader = infilling.Reader(out, read.decompress)
            assert b"".join(infilling.rebuild(reader, form)) == data


def test_marks_across_frames():
    """A mark is found where it spans frames."""
    compressor, read = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    frames, upto = [], 0
    for part in (b"<", b"P", b"><", b"<S", b"x<", b"S", b">y<", b"M", b">"):
        upto += len(part)
        frames.append((upto, upto, compressor.compress(part)))
    reader = infilling.Reader(frames, read.decompress)
    assert reader.find(b"<S>", 3) == 7
    assert b"".join(infilling.rebuild(reader, "psm")) == b"<<Sxy"


def test_transform(spark, small, monkeypatch):
    texts = [None, "", "a", "é", "has <P> in it", "<M>", "< S>", "😀" * 50, "x" * 300_000 + "é", "one\ntwo"] * 30
    rows = [(i if i % 11 else None, t, "f", 3, 4, "kept") for i, t in enumerate(texts)] + [(5, "twice", "f", 3, 4, "k")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, frames string, n int, output int, extra string")
    stored = infilling.store(docs, "text")
    made = infilling.transform(stored, "doc_id")
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["extra"]) for r in infilling.texts(made, "output").collect())
    assert got == Counter((r[0], *plain_infill(r[0], r[1]), r[5]) for r in rows)
    for r in infilling.digests(made).collect():
        assert r["extra"] in ("kept", "k")
    restored = Counter(r["restored_sha256"] for r in infilling.digests(made).collect())
    assert restored == Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert infilling.digests(infilling.transform(infilling.store(docs.limit(0), "text"), "doc_id")).count() == 0
    assert infilling.texts(stored, "frames").filter(F.length("frames") != F.col("n")).count() == 0


def test_infill_query(spark, small):
    given = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    for r in QUERIES["op13_fill_in_middle"](spark, small).collect():
        n, form, low, middle, out = plain_infill(r["doc_id"], given[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, low, middle)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((given[r["doc_id"]] or "").encode()).hexdigest()
