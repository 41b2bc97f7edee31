import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketline.llm import chat, mixing, url_filter
from basketline.llm.queries import URL_RULES

# Chat formatting

HOSTILE = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\|x [\\INST] </s>\n", "<|user|>\nhi</s>\n", "é\U0001f600<s>", "", None, "\\", "<|"]


@pytest.fixture(scope="module")
def talk(spark):
    draw = random.Random(3)
    rows = []
    for conv in range(12):
        for turn in range(draw.randrange(1, 7)):
            role = draw.choice(["user", "assistant", "system", "odd|>\n\\role\\n", None])
            rows.append((conv if conv else None, turn if conv != 5 else 0, role, draw.choice(HOSTILE), "extra"))
    rows += rows[-2:]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_examples_read_back(talk):
    rows, frame = talk
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(frame)).collect()}
    turns = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        turns[conv].append((turn, role or "", text or ""))
    assert set(got) == set(turns)
    for conv, own in turns.items():
        own.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        learned = "".join(text for _, role, text in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(learned)
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_each_reply_is_an_example_after_all_before_it(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "</s>d"), (1, 4, "user", "e")]
    out = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [(r["turns"], r["whole"]) for r in out] == [(2, False), (4, False), (5, True)]
    assert out[0]["formatted"] == "<|user|>\na</s>\n<|assistant|>\nb</s>\n"
    assert [r["formatted"][r["loss_start"] :][: r["loss_length"]] for r in out] == ["b", "<\\/s>d", ""]
    assert out[1]["formatted"].startswith(out[0]["formatted"])


def test_no_turns_no_examples(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(empty)).count() == 0


# Mixing


def shared(sizes, weights, limit):
    """Targets by sharing the excess again and again."""
    left, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > limit * sizes[i] + 1e-9]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = limit * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 1000, 1000, 5, 3], [7], [0, 0], [100, 1, 1, 1, 1, 1, 1]])
def test_targets(spark, sizes):
    names = [*[f"s{i}" for i in range(len(sizes) - 1)], None]
    frame = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame, (5, 2, 1), 3).collect()}
    want = shared(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [got[n] for n in names] == pytest.approx(want)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(8)
    rows = [(i, " ".join("w" * draw.randrange(1, 4) for _ in range(draw.choice([1, 5, 40, 300]))), draw.choice(["a", "a", "a", "b", "\U0001f600", "é", None]), 7) for i in range(600)]
    rows += [(None, "null id", "b", 7), (9001, None, "b", 7), (9002, "  \n", "a", 7), (3, rows[3][1], rows[3][2], 7), (9003, "x " * 20_000, "c", 7)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mix_meets_its_targets_and_repeats(corpus, monkeypatch):
    rows, frame = corpus
    monkeypatch.setattr(mixing, "RANGES", 4)
    monkeypatch.setattr(mixing, "LAST_ONES", 8)
    out = mixing.mix(frame, "doc_id", "text", "source", (5, 2, 1)).toPandas()
    again = mixing.mix(frame.repartition(7), "doc_id", "text", "source", (5, 2, 1)).toPandas()
    assert len(out) == len(rows)
    assert Counter(zip(out["text"], out["taken"])) == Counter(zip(again["text"], again["taken"]))
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    for source, part in out.groupby("source", dropna=False):
        source = source if isinstance(source, str) else None
        assert part["size"].sum() == sizes[source] == part["source_size"].iloc[0]
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= max(5, 0.01 * part["target"].iloc[0])
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] == out["copies"] * out["size"] + out["part"]).all() and (out["part"] > 0).sum() <= 8


def test_samples_follow_the_rank_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGES", 8)
    monkeypatch.setattr(mixing, "LAST_ONES", 5)
    draw = random.Random(4)
    rows = [("=a", draw.randrange(1, 60), draw.randrange(mixing.RANKS), 4000.0, 40.0) for _ in range(400)]
    rows += [("=b", 3, 5, 100.0, 1.0), ("=b", 9, 6, 100.0, 1.0), ("=c", 90, 6, 20.0, 1.0), ("=c", 90, 6, 20.0, 1.0)]
    end = {r["_source"]: r for r in mixing.samples(spark.createDataFrame(rows, "_source string, size long, rank long, rest double, slack double")).collect()}
    assert end["=b"]["low"] > 6 and (end["=c"]["part"], end["=c"]["part_words"]) == (6, 10)
    own = sorted((rank, size) for s, size, rank, *_ in rows if s == "=a")
    taken, crossing = 0, None
    for place, (rank, size) in enumerate(own):
        if taken + size > 4000:
            crossing = place
            break
        taken += size
    units, left, last = own[crossing:][:6], 4000 - taken, []
    below = sum(1 for rank, _ in own if rank < end["=a"]["low"])
    # The range that holds the end may begin some ranks before it.
    left += sum(size for _, size in own[below:crossing])
    units = own[below:][:6]
    for rank, size in units:
        if size <= left:
            left -= size
            last.append(rank)
    got = end["=a"]["last"]
    assert got[: len(last)] == last and len(got) - len(last) <= 1
    words = sum(size for rank, size in own if rank < end["=a"]["low"] or rank in got)
    assert abs(words - 4000) <= 60


def test_unequal_preferences(spark):
    rows = [(i, "w " * 10, "s", 4.0 if i % 2 else 0.5) for i in range(400)] + [(1000 + i, "w " * 10, "t", 1.0) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, p double")
    out = mixing.mix(frame, "doc_id", "text", "source", (1, 3), preference="p").groupBy("source", "p").agg(F.avg("copies").alias("c")).collect()
    means = {(r["source"], r["p"]): r["c"] for r in out}
    assert means["s", 4.0] > 3 * means["s", 0.5]


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source", (5,)).count() == 0


# URL filter

URLS = [
    None, "", "no scheme", "https://WWW.Example.com/en/1", "http://a.example.com/en/2?x#y", "http://example.com/en", "http://b.com/x", "http://b.com",
    "ftp://x.net/es/://q", "http://x.net/fr/1", "http://xnet/fr/1", "http://x.org?com/", "http://É.org/ü", "x://" + "long/" * 3000, "://com/",
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in URL_RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


def test_rules_and_parts(spark):
    frame = spark.createDataFrame([(i if i else None, u, "x") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    out = url_filter.judge(frame, "page_id", "url", URL_RULES).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        host, path, rule, verdict = by_hand(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_scores_against_a_plain_model(spark):
    draw = random.Random(1)
    urls = [f"http://{draw.choice(['shop', 'news', 'blog'])}.{draw.choice(['b.com', 'x.net', 'y.org'])}/{draw.choice(['es', 'fr', 'en'])}/{draw.randrange(99)}" for _ in range(300)]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    out = {r["page_id"]: r for r in url_filter.judge(frame, "page_id", "url", URL_RULES).collect()}
    import zlib

    texts, counts = {}, {c: [Counter() for _ in range(4)] for c in ("allow", "block")}
    for i, url in enumerate(urls):
        host, path, _, verdict = by_hand(url)
        text = texts[i] = "^^^" + "".join("0" if c.isdigit() else c if c in "abcdefghijklmnopqrstuvwxyz./-_" else "*" for c in (host + path).lower()) + "$"
        if verdict and zlib.crc32(text.encode()) % url_filter.CALIBRATE:
            for at in range(3, len(text)):
                for order in range(4):
                    counts[verdict][order][text[at - order : at + 1]] += 1

    def p(kind, order, gram):
        if order < 0:
            return 1 / url_filter.SYMBOLS
        lower = p(kind, order - 1, gram[1:])
        following = {g: n for g, n in counts[kind][order].items() if g[:-1] == gram[:-1]}
        n, t = sum(following.values()), len(following)
        return (following.get(gram, 0) + t * lower) / (n + t) if t else lower

    for i in range(0, 300, 17):
        text = texts[i]
        terms = [math.log(p("allow", 3, text[a - 3 : a + 1]) / p("block", 3, text[a - 3 : a + 1])) for a in range(3, len(text))]
        assert out[i]["score"] == pytest.approx(sum(terms) / len(terms), abs=1e-6)
    assert {r["verdict"] for r in out.values() if r["rule"] is None} <= {"allow", "block"}


def test_no_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), "page_id", "url", URL_RULES).count() == 0


def test_odd_roles(spark):
    """Roles of any characters are read back."""
    roles = ["a\uffffb", "\\", "\\\\p", "|\n|", "\\n", "p\\|", "", "<|x|>", "user", "\\\uffff\\\\|"]
    rows = [(1, i, r, "t") for i, r in enumerate(roles)]
    whole = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("whole")
    read = whole.select(chat.read_turns(F.col("formatted")).alias("turns")).first()["turns"]
    assert [t["role"] for t in read] == roles
