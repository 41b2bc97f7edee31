import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from basketline.llm import jaccard, suffixes
from basketline.llm.common import components


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    words = ["alpha", "été", "Gamma,", "de", "x", "日本語", "<|", "lorem\n"]

    def text(n):
        return " ".join(draw.choice(words) + draw.choice(["", "s", "1"]) for _ in range(n))

    passage, base = text(40), text(60)
    rows = []
    for i in range(90):
        body = text(draw.choice([1, 3, 30, 90]))
        kind = i % 9
        if kind == 1:
            body = body + " " + passage + " " + text(4)
        if kind == 2:
            body = base
        if kind == 3:
            changed = base.split(" ")
            changed[draw.randrange(len(changed))] = f"edit{i}"
            body = " ".join(changed)
        if kind == 4:
            body = passage[draw.randrange(30) :] + text(3)
        rows.append((draw.choice([i, i, i, 1000 + i]), body))
    rows += [(None, base), (None, text(50)), (500, None), (501, ""), (502, "  \n "), (503, "a" * 400), (504, "b" + "a" * 300), (7, base), (7, text(80)), (505, "one two three"), (506, "one two three")]
    rows += [rows[4], rows[4]]
    return rows


def removed(rows):
    """For each row its kept bytes, removed bytes and runs, string by string."""
    first = {}
    rows = [(2**62 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], 2**63), i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest(), sum(gone), runs))
    return out


def test_multikey_quicksort():
    draw = np.random.default_rng(0)
    for n, small in ((0, 4), (1, 4), (3000, 4), (3000, 100)):
        words = draw.integers(0, 4, (n, 3)).astype(np.uint64)
        order = suffixes.multikey_quicksort(words, small)
        assert sorted(order) == list(range(n))
        assert (words[order].tolist()) == sorted(words.tolist())


def test_every_string_has_an_anchor_of_its_own_content():
    draw = random.Random(2)
    text = bytes(draw.choice(b"ab ") for _ in range(3000)) + b"z" * 200
    _, places, hashes = suffixes.anchors([text])
    _, again, _ = suffixes.anchors([b"#", text[:40], b"prefix" + text])
    assert set(places + 6) <= set(again[again >= 0])
    have = set(places)
    for p in range(len(text) - 49):
        assert any(q in have for q in range(p, p + 27))


@pytest.mark.parametrize("cell_bytes, bucket_bytes, hot_cells", [(1 << 11, 1 << 12, 2), (1 << 11, 1 << 12, 64), (1 << 20, 1 << 20, 64)])
def test_removal_against_every_string(spark, corpus, monkeypatch, cell_bytes, bucket_bytes, hot_cells):
    monkeypatch.setattr(suffixes, "HOT_CELLS", hot_cells)
    monkeypatch.setattr(suffixes, "CELL_BYTES", cell_bytes)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket_bytes)
    frame = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(corpus)], "doc_id long, text string, number int, kept string")
    out = suffixes.dedup(frame, "doc_id", "text").collect()
    got = {r["number"]: (hashlib.sha256(r["kept"]).hexdigest(), r["n_removed"], r["n_spans"]) for r in out}
    assert got == dict(enumerate(removed(corpus)))
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out)


def test_each_cell_sends_its_suffixes_once(spark, corpus, monkeypatch):
    """The ends of the range partitions come from some cells; nothing runs all of them once more to sample them."""
    runs, make = spark.sparkContext.accumulator(0), suffixes._send_suffixes

    def told(*given):
        run = make(*given)

        def counted(docs, replies):
            runs.add(1)
            return run(docs, replies)

        return counted

    monkeypatch.setattr(suffixes, "_send_suffixes", told)
    monkeypatch.setattr(suffixes, "CELL_BYTES", 1 << 11)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1 << 12)
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    cells = suffixes.cell_count(frame, "text", 1 << 11)
    assert cells > 4
    assert suffixes.dedup(frame, "doc_id", "text").count() == len(corpus)
    assert cells // 2 < runs.value <= cells


def test_split_leading_bytes_are_placed_by_id():
    ends = [(b"a" * 24, 1), (b"b" * 23 + b"\0", 5), (b"b" * 23 + b"\0", 9), (b"\xff" * 24, 3)]
    leads = [b"a" * 24, b"b" * 23 + b"\0", b"b" * 23 + b"\0", bytes(24), b"\xff" * 24]
    lead = np.frombuffer(b"".join(leads), np.uint8).reshape(-1, 24)
    ids, split = np.array([1, 7, 7, 1, 9]), np.array([False, True, False, False, True])
    assert suffixes._place(lead, ids, split, ends).tolist() == [0, 2, 1, 0, 4]
    assert suffixes._place(lead, ids, split, []).tolist() == [0] * 5


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 256)
    draw = random.Random(5)
    body = "".join(draw.choice("abcdef ") for _ in range(5000))
    rows = [(1, body), (2, "zz" + body[1000:4200] + "qq"), (3, body[:3] + "-" + body[3:])]
    out = {r["doc_id"]: r for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    for (i, _), want in zip(rows, removed(rows), strict=True):
        assert (hashlib.sha256(out[i]["kept"]).hexdigest(), out[i]["n_removed"], out[i]["n_spans"]) == want


def test_whole_characters(spark):
    tail = "日本語" * 20
    rows = [(1, "a" + tail), (2, "\U00065e5b" + tail[:40])]
    out = {r["doc_id"]: r for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", whole_characters=True).collect()}
    assert out[2]["kept"].decode() == "\U00065e5b" and out[1]["n_removed"] == 0


def test_nothing_to_remove_from(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


# Jaccard join


def linked_by_hand(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        least[find(x)].append(i)
    return [(min((i for i in least[find(x)] if i is not None), default=None), links[x]) for x in range(len(rows))]


@pytest.mark.parametrize("block", [3, 512])
def test_classes_against_every_pair(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    frame = spark.createDataFrame([(i, t, "x") for i, t in corpus], "doc_id long, text string, row string")
    got = sorted((r["id"] is None, r["id"], r["class_id"], r["n_links"]) for r in jaccard.classes(frame, "doc_id", "text").collect() if r["id"] is not None)
    want = sorted((False, i, *facts) for (i, _), facts in zip(corpus, linked_by_hand(corpus), strict=True) if i is not None)
    assert got == want


def test_blocks_meet_each_other_once():
    group, low, high, block = np.array([0, 0, 0, 1, 1, 1, 1, 2]), *(np.array(x) for x in ([0, 0, 0, 0, 0, 0, 0, 1], [0, 0, 0, 1, 1, 1, 1, 2], [0, 0, 0, 0, 0, 1, 1, 1]))
    pairs = [p for one, other in jaccard._pairs(group, low, high, block) for p in zip(one, other)]
    assert pairs == [(0, 1), (0, 2), (1, 2), (3, 5), (3, 6), (4, 5), (4, 6)]


def test_pruning_drops_what_cannot_reach_the_threshold():
    fewest = jaccard.fewest_matches(0.8, 1e-6)
    assert len(fewest) == jaccard.VALUES // jaccard.STEP
    draw = np.random.default_rng(1)
    for n, least in zip(range(jaccard.STEP, jaccard.VALUES + 1, jaccard.STEP), fewest, strict=True):
        reached = draw.beta(least + 1, n - least + 1, 200_000) >= 0.8
        assert reached.mean() < 1e-3
    # A pair at the threshold is all but never below.
    matches = (draw.random((20_000, jaccard.VALUES)) < 0.8).cumsum(1)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert (matches < np.array(fewest)).any(1).mean() < 1e-3


def test_components(spark):
    draw = random.Random(6)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        assert got.get(node, node) == min(seen)


def test_no_documents(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
