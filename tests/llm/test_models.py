import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketline.llm import language_id, pitman_yor, token_counts
from basketline.llm.common import fold, table
from basketline.llm.queries import QUERIES

ODD = [None, "", " \n\t", "123 !!", "a", "ß", "<|endoftext|> don't'S", "İΣΑΣ É", "x" * 5000, "日本語 text", "日本語 text"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i if i else None, t, "x", "de") for i, t in enumerate(ODD)], "doc_id long, text string, score string, lang string")


# Token counts


def test_counts_equal_the_library(spark, odd, small):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    draw = random.Random(1)
    pool = [chr(draw.choice([draw.randrange(32, 127), draw.randrange(0xA0, 0x250), draw.randrange(0x370, 0x400), 0x4E00, 0x1F600, 10])) for _ in range(400)]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(2000)]
    texts += [r["text"] for r in table(spark, small, "documents").collect()]
    count = token_counts.word_counter(path)
    for text in texts:
        assert sum(map(count, text.encode().split())) == len(library.encode(text, add_special_tokens=False).ids), text
    for r in token_counts.token_counts(odd, "text", path, ["doc_id"]).collect():
        text = ODD[r["doc_id"] or 0] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


def test_merges_take_the_lowest_rank_first():
    # a=0 b=1 c=2, ab=3, bc=4, abc=5: bc goes before ab.
    ranks, merged = {1 << 20 | 2: 0, 0 << 20 | 1: 1, 0 << 20 | 4: 2}, [4, 3, 5]
    assert token_counts.merged_length([0, 1, 2], ranks, merged) == 1
    assert token_counts.merged_length([0, 1, 0, 1, 2, 0], ranks, merged) == 3
    assert token_counts.merged_length([2, 2], ranks, merged) == 2


# Language identification


def test_gradients():
    words, labels = [b"hello", b"abc", b"z"], np.array([0, 1, 2])
    model = {k: v.astype(np.float64) for k, v in language_id.train(words, labels, 3, language_id.Settings(hidden=3, epochs=0)).items()}
    _, grads = language_id.loss_and_gradients(model, words, labels)
    for name, values in model.items():
        for place in [p for p in np.ndindex(values.shape) if abs(grads[name][p]) > 1e-3][:4]:
            values[place] += 1e-3
            more, _ = language_id.loss_and_gradients(model, words, labels)
            values[place] -= 2e-3
            less, _ = language_id.loss_and_gradients(model, words, labels)
            values[place] += 1e-3
            assert (more - less) / 2e-3 == pytest.approx(grads[name][place], rel=0.05, abs=1e-4)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op4_language_id"](spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pooled_over_all_bytes(spark, odd):
    languages, model = language_id.fit(odd.filter("doc_id IS NOT NULL"), "text", "lang", F.col("doc_id"), language_id.Settings(epochs=1))
    assert languages == ["de"]
    both = {**model, "out": np.random.default_rng(0).normal(0, 1, (24, 2)).astype(np.float32), "bias": np.zeros(2, np.float32)}
    out = language_id.predict(odd, "text", ["de", "fr"], both).collect()
    for r in out:
        text = (ODD[r["doc_id"] or 0] or "")
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums, size = np.zeros(2), 0
        for word in text.encode().split():
            for at in range(0, len(word), language_id.MAX_PIECE):
                sums += language_id.probabilities(both, [word[at : at + language_id.MAX_PIECE]])[0]
            size += len(word)
        assert r["score"] == pytest.approx((sums / size).max(), abs=1e-4)
        assert r["lang_pred"] == ["de", "fr"][int((sums / size).argmax())]


def test_every_language_is_learned(spark):
    """Seventy languages, each with a letter of its own."""
    letters = [chr(0x4E00 + 97 * i) for i in range(70)]
    rows = [(70 * k + i, f"{c}{c} {c}{c}{c} {c}", f"l{i:02}") for i, c in enumerate(letters) for k in range(6 if i else 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, model = language_id.fit(frame, "text", "lang", F.col("doc_id"), language_id.Settings(epochs=40, batch=64))
    assert languages == [f"l{i:02}" for i in range(70)]
    found = language_id.predict(frame, "text", languages, model).join(frame.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9


def test_no_labels(spark, odd):
    assert language_id.fit(odd.limit(0), "text", "lang", F.col("doc_id")) == ([], None)
    out = language_id.predict(odd, "text", [], None).collect()
    assert len(out) == len(ODD) and {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}


# Language-model scores


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    sides = [[f"en{i}th" for i in range(40)], [f"de{i}CH" for i in range(40)]]
    rows = [(i, " ".join(draw.choices(sides[i % 2], weights=[1 / (k + 1) for k in range(40)], k=draw.randrange(0, 60)))) for i in range(120)]
    return [*rows, *((1000 + i, t) for i, t in enumerate(ODD)), rows[3]]


def test_scores(spark, texts, monkeypatch):
    monkeypatch.setattr(pitman_yor, "CELL_BYTES", 1 << 12)
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 1 << 13)
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, score string")
    out = pitman_yor.score(frame, "doc_id", "text", fold(F.col("doc_id"), 10) != 0).collect()
    assert len(out) == len(texts)
    learned = Counter()
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in texts]
    for i, own in tokens:
        if zlib.crc32(str(i).encode()) % 10:
            learned.update(own)
    n, v = sum(learned.values()), len(learned)
    want = sorted((i, len(own), sum(learned[w] > 0 for w in own), n, round(sum(math.log10((learned[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)) for i, own in tokens)
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in out)


def test_probabilities_add_up_to_one(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    model = pitman_yor.fit(frame, "text", 3)
    assert len(model.samples) == pitman_yor.ROUNDS - 1
    for seats, totals in model.samples:
        contexts = [0, ord("t") << 8 | ord("h"), ord("z")]
        mass = {c: totals.passed(2, c) * totals.passed(1, c & 0xFF) * totals.unknown for c in contexts}
        for row in seats.collect():
            s = pitman_yor._seats(row.asDict())
            assert (s.t2 >= 1).all() and (s.t2 <= s.c2).all() and (s.t1 <= s.c1).all() and (s.t0 <= s.c0).all()
            root, parents = pitman_yor._probabilities(s, totals)
            for c in contexts:
                last = c & 0xFF
                middle = totals.passed(1, last) * root
                here = s.parent & 0xFF == last
                middle[s.parent[here] >> 8] = parents[here]
                p = totals.passed(2, c) * middle
                own = s.pair & 0xFFFF == c
                p[s.pair[own] >> 16] += totals.known(2, c, s.c2[own], s.t2[own])
                mass[c] += p.sum()
        assert list(mass.values()) == pytest.approx([1.0] * 3)


def test_whole_tokens_are_contexts(spark):
    """Tokens that end alike are told apart by what follows them, also where it was learned only once."""
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["oneth left", "twoth right"]) for _ in range(20)), True) for i in range(30)]
    rows += [(99, "onceth down", True)]
    asked = ["oneth left", "oneth right", "twoth left", "twoth right", "onceth down", "onceth left"]
    rows += [(100 + i, t, False) for i, t in enumerate(asked)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, learned boolean")
    out = pitman_yor.score(frame, "doc_id", "text", F.col("learned")).where("doc_id >= 100").collect()
    score = {asked[r["doc_id"] - 100]: r["score"] for r in out}
    assert score["oneth left"] > score["oneth right"] + 1
    assert score["twoth right"] > score["twoth left"] + 1
    assert score["onceth down"] > score["onceth left"]


def test_scores_against_single_dishes(spark, texts, monkeypatch):
    """Counts, tables and scores of whole-token contexts, from the seating of each dish, over several buckets and cells."""
    monkeypatch.setattr(pitman_yor, "CELL_BYTES", 1 << 12)
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 1 << 13)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    buckets = pitman_yor.cell_count(frame, "text", 1 << 13)
    assert buckets > 1
    model = pitman_yor.fit(frame, "text", buckets)
    tokens = [[b"", *(t or "").encode().lower().split(), b""] for _, t in texts]
    counts = Counter((u, w) for own in tokens for u, w in zip(own, own[1:], strict=False))
    learned = Counter(w for own in tokens for w in own[1:])
    name = dict(zip(pitman_yor.context_ids(list(learned)).tolist(), learned, strict=True))
    mean = Counter()
    for (seats, totals), sums in zip(model.samples, model.tables, strict=True):
        t3, two, lower, roots = {p: 1 for p in counts}, {}, {}, {}
        for row in seats.collect():
            s = pitman_yor._seats(row.asDict())
            assert dict(zip(s.words, s.occurrences.tolist(), strict=True)) == {w: learned[w] for w in s.words}
            for up, whole, c, t in zip(s.listed, s.whole, s.c3, s.t3, strict=True):
                pair = name[s.ids[whole]], s.words[s.pair[up] >> 16]
                assert c == counts[pair] and 1 <= t <= c
                t3[pair] = t
            root, parents = pitman_yor._probabilities(s, totals)
            middle = pitman_yor._middle(s, totals, parents)
            two |= {(k & 0xFFFF, s.words[k >> 16]): (p, c) for k, p, c in zip(s.pair.tolist(), middle, s.c2.tolist(), strict=True)}
        of_pair, of_context = Counter(), Counter()
        for (u, w), t in t3.items():
            of_pair[int(pitman_yor.tails(pitman_yor.context_ids([u]))[0]), w] += t
            of_context[u] += t
        assert {k: c for k, (_, c) in two.items()} == of_pair
        found = Counter()
        for r in sums.where("home IS NULL").collect():
            own = [i for i in sorted(name) if pitman_yor.homes(np.array([i], np.uint64), buckets)[0] == r["bucket"]]
            found.update({name[i]: n for i, n in zip(own, pitman_yor.unpack(r["tables"]).tolist(), strict=True)})
        assert found == of_context
        d = totals.discounts[3]
        for (u, w), c in counts.items():
            p = two[int(pitman_yor.tails(pitman_yor.context_ids([u]))[0]), w][0]
            mean[u, w] += (c - d * t3[u, w] + (1 + d * of_context[u]) * p) / (1 + learned[u]) / len(model.samples)
    want = sorted((i, round(sum(math.log10(mean[p]) for p in zip(own, own[1:], strict=False)), 4)) for (i, _), own in zip(texts, tokens, strict=True))
    out = pitman_yor.score(frame, "doc_id", "text", F.lit(True)).collect()
    assert sorted((r["doc_id"], round(r["score"], 4)) for r in out) == [(i, pytest.approx(x, abs=2e-4)) for i, x in want]


def test_words_that_no_bucket_knows(spark, monkeypatch):
    """A bucket without a learned word answers with the unknown token's probability, not with certainty."""
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 1)
    frame = spark.createDataFrame([(1, "a", True), (2, "b c d e f g h", False)], "doc_id long, text string, learned boolean")
    out = pitman_yor.score(frame, "doc_id", "text", F.col("learned")).where("doc_id = 2").first()
    assert out["score"] < -7 * math.log10(3)


def test_seating_against_one_customer_at_a_time():
    """Mean tables after many rounds equal those of a plain sampler of the same seating."""
    draw = np.random.default_rng(2)
    c, a, d = 12, 1.7, 0.6
    plain, sizes = [], [c]
    for step in range(20_000):
        j = draw.choice(len(sizes), p=np.array(sizes) / c)
        sizes[j] -= 1
        if not sizes[j]:
            sizes.pop(j)
        weights = np.array([*(s - d for s in sizes), a])
        j = draw.choice(len(weights), p=weights / weights.sum())
        if j == len(sizes):
            sizes.append(1)
        else:
            sizes[j] += 1
        plain.append(len(sizes))
    pitman_yor.MOVES, moves = 60, pitman_yor.MOVES
    try:
        got = pitman_yor.seat(np.full(4000, c), np.full(4000, a), d, draw)
    finally:
        pitman_yor.MOVES = moves
    assert got.mean() == pytest.approx(np.mean(plain[500:]), rel=0.05)


def table_chances(c, a, d):
    """Chances of 1 to c tables by the recurrence of the generalized Stirling numbers."""
    logs = np.zeros(1)
    for k in range(2, c + 1):
        logs = np.logaddexp(np.append(logs + np.log(k - 1 - d * np.arange(1, k)), -np.inf), np.append(-np.inf, logs))
    logs = logs + np.log(a) * np.arange(1, c + 1)
    chances = np.exp(logs - logs.max())
    return chances / chances.sum()


@pytest.mark.parametrize("c", [65, 400, 1500])
def test_chances_of_tables_at_any_size(c):
    for d in (0.05, 0.7, 0.95):
        for a in (0.01, 1.0, 0.2 * c, 5.0 * c, 1000.0 * c):
            least, got = pitman_yor.table_chances(c, a, d)
            whole = np.zeros(c)
            whole[least - 1 : least - 1 + len(got)] = got
            assert np.abs(whole - table_chances(c, a, d)).sum() < 1e-6


@pytest.mark.parametrize("c", [100, 2000])
def test_large_dishes_are_seated_anew(c):
    """Mean and spread of the tables, not the average alone."""
    want, counts = table_chances(c, 0.2 * c, 0.6), np.arange(1, c + 1)
    mean = want @ counts
    got = pitman_yor.seat(np.full(400, c), np.full(400, 0.2 * c), 0.6, np.random.default_rng(4))
    deviation = np.sqrt(want @ (counts - mean) ** 2)
    assert got.mean() == pytest.approx(mean, abs=0.2 * deviation)
    assert got.std() == pytest.approx(deviation, rel=0.15)


def rising_chances(c, first, grow, d):
    """Chances of 1 to c tables where each table adds to the weight of the next."""
    logs = np.zeros(1)
    for k in range(2, c + 1):
        logs = np.logaddexp(np.append(logs + np.log(k - 1 - d * np.arange(1, k)), -np.inf), np.append(-np.inf, logs))
    logs = logs + np.log(first + grow * np.arange(c)).cumsum()
    chances = np.exp(logs - logs.max())
    return chances / chances.sum()


@pytest.mark.parametrize("c, others, p, mean", [(10, 0, 0.3, 2.119), (40, 3, 0.3, None), (30, 1, 0.9, None)])
def test_seating_in_a_restaurant_with_few_tables(c, others, p, mean):
    """One customer at a time leaves and sits down; a new table weighs more the more tables there are."""
    draw, strength, d = np.random.default_rng(3), 1.0, 0.5
    sizes, plain = [c], []
    for _ in range(1500 * c):
        j = draw.choice(len(sizes), p=np.array(sizes) / c)
        sizes[j] -= 1
        if not sizes[j]:
            sizes.pop(j)
        weights = np.array([*(s - d for s in sizes), (strength + d * (others + len(sizes))) * p])
        j = draw.choice(len(weights), p=weights / weights.sum())
        if j == len(sizes):
            sizes.append(1)
        else:
            sizes[j] += 1
        plain.append(len(sizes))
    first, grow = (strength + d * others) * p, d * p
    want = rising_chances(c, first, grow, d) @ np.arange(1, c + 1)
    got = pitman_yor.seat(np.full(6000, c), np.full(6000, first), d, draw, np.full(6000, grow))
    assert got.mean() == pytest.approx(want, rel=0.03)
    assert np.mean(plain[len(plain) // 10 :]) == pytest.approx(want, rel=0.06)
    if mean:
        assert want == pytest.approx(mean, abs=2e-3)
        # By hand for 200 customers beside three tables.
        assert rising_chances(200, (strength + d * 3) * p, d * p, d) @ np.arange(1, 201) == pytest.approx(3.544, abs=2e-3)


@pytest.mark.parametrize("c", [65, 400, 1500])
def test_rising_chances_at_any_size(c):
    for d in (0.05, 0.7, 0.95):
        for p in (1e-4, 0.03, 0.9):
            for others in (0, 40, 100 * c):
                first, grow = (1 + d * others) * p, d * p
                least, got = pitman_yor.table_chances(c, first, d, grow)
                whole = np.zeros(c)
                whole[least - 1 : least - 1 + len(got)] = got
                assert np.abs(whole - rising_chances(c, first, grow, d)).sum() < 1e-6


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pitman_yor.score(empty, "doc_id", "text", F.lit(True)).count() == 0
    rows = pitman_yor.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", "text", F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows] == [(3, 0, 0, 0.0)]
