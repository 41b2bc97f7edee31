import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketline.llm import decontaminate, quality
from basketline.llm.common import table
from basketline.llm.queries import QUERIES

# Decontamination

ITEMS = [
    (1, "Maria has 12 apples and 5 pears. If Maria gives 5 pears to her neighbour, how many of the 12 apples are left over?"),
    (2, "The river is 40 km long and flows through three old towns before it reaches the sea near the harbour"),
    (3, "short item"),
    (None, "seven plain words make one single window"),
    (5, None),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(spark, items, *texts):
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id long")
    return sorted((r["doc_id"], r["item_id"] or 0, r["refilled"]) for r in decontaminate.matches(frame, "text", items, "item_id", "text").collect())


def test_templates_and_slots(spark, items):
    refilled = ITEMS[0][1].replace("Maria", "Paolo").replace("12", "30").replace("5", "7")
    # One 12 is a 30 here and a 12 there, and no 13 words are as they were.
    mixed = ITEMS[0][1].replace("12 apples and", "30 apples and").replace("neighbour,", "sister")
    got = found(
        spark, items,
        "before " + ITEMS[0][1] + " after", "Q: " + refilled, mixed, ITEMS[1][1].replace("40 km", "9 miles"),
        "nothing here", None, "", "x" * 100_000, ITEMS[1][1].upper().replace("KM", "km"), "seven plain words make one single window", ITEMS[0][1], "12 5 12 5 12 5 12 5 12 5",
    )
    # A copy in capitals has the same literal words.
    assert [g[:2] for g in got] == [(0, 1), (1, 1), (3, 2), (8, 2), (9, 0), (10, 1)]
    assert got[0][2] == 0 and got[1][2] > 0 and got[2][2] > 0 and got[3][2] == 0


@pytest.mark.parametrize(
    "item, text",
    [
        ("Tom has 3 apples. Tom buys 5 more. Tom eats 2 of them. How many apples does Tom have left?", None),
        (
            "Tom has 3 apples. Tom buys 5 more. Tom eats 2 of them. How many apples does Tom have left?",
            "Mary has 7 apples. Mary buys 9 more. Mary eats 4 of them. How many apples does Mary have left?",
        ),
        ("What is the boiling point of pure water?", None),
        ("Who wrote Hamlet?", None),
        ("Welche Farbe hat der Himmel", None),
        ("Der Bauer bringt Milch, Käse, Butter, Eier und Honig zum Markt der Stadt Ulm, denn Frau Weber wartet", None),
        ("THE RIVER FLOWS PAST MANY OLD TOWNS AND THEN IT REACHES THE SEA", None),
        ("3 + 4 - 2 + 9 - 11 + 5 - 8 + 20 - 1", None),
        ("Berlin", None),
    ],
)
def test_items_of_every_kind_are_found(spark, item, text):
    """Short, capitalised, numeric and re-parameterised items, within running text and as a sentence."""
    items = spark.createDataFrame([(4, item)], "item_id long, text string")
    text = text or item
    alone = f"Some words. {text} Then the answer" if text[-1] in ".?" else f"Some words: {text}"
    got = found(spark, items, alone, text.lower() if text == item else text, "Some other words that have nothing to do with it, at all.")
    assert [g[0] for g in got] == [0, 1]
    assert all((r > 0) == (text != item) for _, _, r in got)
    if len(item.split()) > 2:
        assert [g[0] for g in found(spark, items, f"some words {text} and more words")] == [0]
    else:
        # A word or two count only as a sentence.
        assert found(spark, items, f"some words {text} and more words") == []


def plain_finds(text, item):
    """Whether the literal words of an item are in a text: 13 in a row, or all of a shorter one."""
    def words(t):
        return [w for w in (decontaminate.word_facts(x)[0] for x in (t or "").split()) if w]

    have, want = words(text), words(item)
    n = min(decontaminate.COVERED, len(want))
    runs = {tuple(have[i : i + n]) for i in range(len(have) - n + 1)}
    return n > 0 and any(tuple(want[i : i + n]) in runs for i in range(len(want) - n + 1))


def test_every_literal_item_is_found(spark):
    """Items of any length and words, planted anywhere in texts of the same words, against plain search."""
    draw = random.Random(21)
    pool = ["Tom", "3", "12", "km", "apples", "the", "The", "of", "5kg", "is", "Rome", "red.", "how?", "x2", "and", "it", "--", "old"]
    items = [(i, " ".join(draw.choice(pool) for _ in range(draw.choice([3, 4, 7, 8, 9, 13, 14, 30])))) for i in range(60)]
    texts = []
    for i in range(120):
        body = [draw.choice(pool) for _ in range(40)]
        if i % 2:
            own = draw.choice(items)[1].split()
            cut = draw.randrange(max(1, len(own) - 12))
            body[20:20] = own[cut : cut + draw.choice([5, 13, 20, 30])]
        texts.append(" ".join(body))
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if plain_finds(t, x) and len([w for w in x.split() if w != "--"]) >= decontaminate.SENTENCE}
    assert len(want) > 50 and want <= got


def test_blocks_are_passes(spark, small, monkeypatch):
    """Several blocks give what one does; no plan holds more than one."""
    docs, benchmark = table(spark, small, "documents"), table(spark, small, "benchmark")
    whole = sorted(map(tuple, decontaminate.matches(docs, "text", benchmark, "item_id", "text").collect()))
    free = sorted(r["doc_id"] for r in decontaminate.clean(docs, "text", benchmark, "item_id", "text").collect())
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (400,))
    parts = decontaminate.matches(docs, "text", benchmark, "item_id", "text")
    assert sorted(map(tuple, parts.collect())) == whole
    cut = decontaminate.clean(docs, "text", benchmark, "item_id", "text")
    assert sorted(r["doc_id"] for r in cut.collect()) == free
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_word_facts():
    assert decontaminate.word_facts("(1,200.5)")[:4] == ("1,200.5", "<number>", "<number>", True)
    assert decontaminate.word_facts("5kg")[1] == "<quantity>"
    assert decontaminate.word_facts("Berlin,")[1:3] == ("berlin", "<name>")
    assert decontaminate.word_facts("--")[0] == "" and decontaminate.word_facts("End.")[5]


def test_blocks_and_every_window(spark, small):
    docs, benchmark = table(spark, small, "documents"), table(spark, small, "benchmark")
    whole = {tuple(r) for r in decontaminate.matches(docs, "text", benchmark, "item_id", "text").collect()}
    parts = [*decontaminate.blocks(benchmark, "item_id", "text", 300)]
    assert len(parts) > 2
    in_parts = set()
    for r in docs.select("doc_id", "text").collect():
        for block in parts:
            in_parts |= {(r["doc_id"], block.keys[hit[0]], *hit[1:]) for hit in decontaminate.finder(block)([r["text"].encode()])[0]}
    assert in_parts == whole

    def windows(text):
        w = text.split()
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    items = set().union(*(windows(r["text"]) for r in benchmark.collect()))
    want = {r["doc_id"] for r in docs.collect() if windows(r["text"]) & items}
    assert want <= {r[0] for r in whole}
    kept = {r["doc_id"] for r in decontaminate.clean(docs, "text", benchmark, "item_id", "text").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {r[0] for r in whole}


def test_empty_benchmark(spark, items, small):
    docs = table(spark, small, "documents")
    assert decontaminate.matches(docs, "text", items.limit(0), "item_id", "text").count() == 0
    assert decontaminate.clean(docs.limit(0), "text", items, "item_id", "text").count() == 0


# Quality rules


def counted(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(lines)


@pytest.mark.parametrize("text", ["", " ", "a b c d e f", "a b c d e " * 3, "x\ny\n\nx\n x\n", "é ü\u00a0z #*|", "a " * 300, "p q r s t u p q r s t v", " ".join(str(i) for i in range(5000)) + " 1 2 3 4 5"])
def test_text_counts(text):
    if len(text) < 3000:
        assert quality.text_counts(text.encode()) == counted(text)
    else:
        assert quality.text_counts(text.encode())[4] == 10


def estimated(vectors):
    """The estimate of one group, in numpy."""
    floors = np.array([*quality.STATISTICS.values()])

    def quantile(values, low, high, share):
        place = np.clip(np.floor((values - low) / (high - low) * 4096), 0, 4095)
        return (np.sort(place)[int(np.ceil(len(place) * share)) - 1] + 1) * ((high - low) / 4096) + low

    center = np.array([quantile(v, -2.0, 6.0, 0.5) for v in vectors.T])
    spread = np.array([quantile(np.abs(v - c), 0.0, 8.0, 0.5) for v, c in zip(vectors.T, center)])
    inverse = np.diag(1 / ((1.4826 * spread) ** 2 + floors**2))
    for _ in range(quality.STEPS):
        d = np.einsum("ni,ij,nj->n", vectors - center, inverse, vectors - center)
        logs = np.log(np.maximum(d, 1e-6))
        inside = vectors[logs <= quantile(logs, -14.0, 14.0, quality.SUBSET)]
        center = inside.mean(0)
        inverse = np.linalg.inv(np.cov(inside.T, bias=True) + np.diag(floors**2))
    d = np.einsum("ni,ij,nj->n", vectors - center, inverse, vectors - center)
    return d / max(1.0, np.exp(quantile(np.log(np.maximum(d, 1e-6)), -14.0, 14.0, 0.5)) / quality.MEDIAN)


def test_distances_against_numpy(spark):
    draw = random.Random(7)
    rows = []
    for i in range(400):
        words = ["w" * draw.randrange(2, 9) for _ in range(draw.randrange(10, 80))]
        if i % 29 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en" if i % 5 else None, "a" if i < 300 else "b" if i < 390 else None, "x"))
    rows += [(900, None, "en", "a", "x"), (901, "", None, None, "x"), rows[0], (902, "few words", "en", "a", "x"), (903, "z " * 30_000, "en", "a", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    out = quality.judge(frame, "text", "lang", "source", ["doc_id"]).toPandas()
    assert len(out) == len(rows)
    groups, vectors = {}, {}
    usable = {}
    for i, text, lang, source, _ in rows:
        c = quality.text_counts((text or "").encode())
        if c[0] >= 10 and 100 * c[4] <= 20 * c[0]:
            usable.setdefault((lang, source), []).append(i)
            vectors[i] = [np.log((c[1] + 1) / c[0]), np.sqrt(c[2] / max(c[1], 1)), np.sqrt(c[3] / max(c[5], 1)), np.sqrt(c[4] / c[0])]
    small = [k for k, ids in usable.items() if len(ids) < quality.FEWEST]
    pools = {}
    for k, ids in usable.items():
        pools.setdefault(k if k not in small else k[0], []).extend(ids)
    for pool in pools.values():
        if len(pool) >= quality.FEWEST:
            groups.update(zip(pool, estimated(np.array([vectors[i] for i in pool])), strict=True))
    assert len(groups) > 300
    got = out.dropna(subset=["distance"]).drop_duplicates("doc_id").set_index("doc_id")["distance"]
    for i, d in groups.items():
        assert got[i] == pytest.approx(d, rel=1e-6, abs=1e-9)
    kept = out.drop_duplicates("doc_id").set_index("doc_id")["kept"]
    assert not any(kept[i] for i in range(0, 400, 29) if i in groups)
    assert not kept[900] and not kept[901] and not kept[902]
    assert all(kept[i] for i in groups if i % 29)


def prose(draw, n):
    return " ".join("w" * draw.randrange(2, 9) for _ in range(n))


def test_a_source_with_much_junk(spark):
    draw = random.Random(3)
    rows = []
    for i in range(500):
        text = prose(draw, draw.randrange(60, 200))
        if i % 5 < 2:
            text = " ".join(w + "*" * max(1, len(w) // 2) for w in text.split())
        rows.append((i, text, "en", "a"))
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "text", "lang", "source", ["doc_id"])
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not any(kept[i] for i in kept if i % 5 < 2)
    assert np.mean([kept[i] for i in kept if i % 5 >= 2]) > 0.97


def test_groups_of_more_vectors_than_cells(spark, monkeypatch):
    """What a grid of cells gives is carried on over all vectors, to a determinant as small as that of the vectors themselves."""
    draw = np.random.default_rng(8)
    mixed = draw.multivariate_normal([1.6, 0.3, 0.2, 0.2], np.diag([0.02, 0.01, 0.01, 0.02]), 900)
    mixed[:300] += [0.5, 0.4, 0.0, 0.3]
    rows = [(g, v.tolist()) for g, part in (("large", mixed), ("small", mixed[250:290])) for v in part]
    frame = spark.createDataFrame(rows, "group string, vector array<double>")
    whole = {r["group"]: r for r in quality.estimates(frame).collect()}
    for grids in ((64, 8), (64, 2)):
        monkeypatch.setattr(quality, "CELLS", 60)
        monkeypatch.setattr(quality, "GRIDS", grids)
        found = {r["group"]: r for r in quality.estimates(frame).collect()}
        assert found["small"] == whole["small"] and found["large"]["n"] == 900

        def size(r):
            return -np.linalg.slogdet(np.array(r["inverse"]).reshape(4, 4))[1]

        assert size(found["large"]) <= size(whole["large"]) + 0.01
        assert np.allclose(found["large"]["center"], whole["large"]["center"], atol=0.03)
        assert found["large"]["scale"] == pytest.approx(whole["large"]["scale"], rel=0.05)


def test_rows_of_tables_among_prose(spark):
    """A tenth of symbols in a long text is much, one symbol in a short text is not."""
    draw = random.Random(5)
    rows = [(i, prose(draw, draw.randrange(20, 200)), "en", "a") for i in range(300)]
    rows += [(1000 + i, " | ".join(prose(draw, 2) for _ in range(40)), "en", "a") for i in range(20)]
    rows += [(2000 + i, prose(draw, 12) + " & " + prose(draw, 4), "en", "a") for i in range(5)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "text", "lang", "source", ["doc_id"])
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not any(kept[1000 + i] for i in range(20))
    assert all(kept[2000 + i] for i in range(5))
    assert np.mean([kept[i] for i in range(300)]) > 0.97


def test_small_sources_are_judged_too(spark):
    """By the language, large sources included; a language with few texts by the whole table."""
    draw = random.Random(6)
    rows = [(i, prose(draw, draw.randrange(20, 200)), "en", "large") for i in range(200)]
    junk = " ".join(w + "***" for w in prose(draw, 60).split())
    rows += [(1000, junk, "en", "small"), (1001, prose(draw, 60), "en", "small"), (1002, junk, "xx", "small"), (1003, prose(draw, 60), "xx", None)]
    columns = "doc_id long, text string, lang string, source string"
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, columns), "text", "lang", "source", ["doc_id"]).collect()}
    assert all(r["distance"] is not None for r in out.values() if not r["base_failed"])
    assert [out[i]["kept"] for i in (1000, 1001, 1002, 1003)] == [False, True, False, True]
    few = quality.judge(spark.createDataFrame([*rows[:20], rows[200]], columns), "text", "lang", "source", ["doc_id"])
    assert {r["doc_id"] for r in few.filter("NOT kept").collect()} == {1000}


def test_few_or_no_texts(spark):
    text = " ".join(f"word{i}" for i in range(20))
    rows = spark.createDataFrame([(1, text, "en", "a"), (2, "# " * 20, "en", "a")], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: (r["kept"], r["distance"]) for r in quality.judge(rows, "text", "lang", "source", ["doc_id"]).collect()}
    assert out == {1: (True, None), 2: (False, None)}
    assert quality.judge(rows.limit(0), "text", "lang", "source", ["doc_id"]).count() == 0


# Queries and pipeline


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op2_source_mixing", "op3_suffix_dedup", "op7_jaccard_join", "op8_url_filter", "op10_quality_rules"])
def test_queries_return_every_row(spark, small, name):
    rows = QUERIES[name](spark, small).count()
    source = {"op1_chat_formatting": "conversations", "op8_url_filter": "pages"}.get(name, "documents")
    given = table(spark, small, source)
    assert rows == (given.select("conv_id").distinct().count() + 1 if name.startswith("op1_") else given.count())


def test_pipeline(spark, tmp_path):
    draw = random.Random(12)
    words = [f"{a}{b}" for a in ("ba", "re", "to", "lin", "mes") for b in ("k", "ra", "dis", "pel", "un", "o")]

    def text(n):
        return " ".join(draw.choice(words) for _ in range(n))

    item, passage = text(30), text(60)
    rows = [(i, text(120), "en", f"s{i % 3}", 0) for i in range(90)]
    rows += [
        (100, rows[5][1], "en", "s0", 0),
        (101, rows[6][1] + " extra", "en", "s1", 0),
        (102, text(30) + " " + item + " " + text(30), "en", "s0", 0),
        (103, text(50) + " " + passage, "en", "s1", 0),
        (104, passage + " " + text(70), "en", "s2", 0),
        (105, " ".join(w + "***$$$" for w in text(100).split()), "en", "s0", 0),
        (106, "too short", "en", "s0", 0),
        (107, None, None, None, None),
        (108, "", "en", "s1", 0),
        (None, text(100), "en", "s2", 0),
        rows[7],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing sources":
            assert out.columns == docs.columns
        kept[name] = out.toPandas()
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {name: [None if i != i else int(i) for i in frame["doc_id"]] for name, frame in kept.items()}
    assert set(ids["quality rules"]) == {*range(90), 100, 101, 102, 103, 104, None}
    assert sorted(ids["n-gram Jaccard join"], key=lambda i: (i is None, i)) == [*range(90), 102, 103, 104, None]
    cut = kept["suffix-array dedup"].dropna(subset=["doc_id"]).set_index("doc_id")
    assert passage in cut.loc[103, "text"] and passage[:60] not in cut.loc[104, "text"]
    assert cut.loc[104, "n_chars"] == len(cut.loc[104, "text"])
    assert set(ids["benchmark decontamination"]) == {*range(90), 103, 104, None}
    mixed = kept["mixing sources"]
    assert (mixed["taken"] > 0).all() and mixed.groupby("source")["taken"].sum().sum() == pytest.approx(mixed.groupby("source")["target"].first().sum(), rel=0.05)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(mixed)


def test_clashing_columns(spark, tmp_path):
    """Columns named like those that operators add come back unchanged from every stage."""
    draw = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "re", "to", "lin", "mes") for b in ("k", "ra", "dis", "pel", "un", "o")]
    clash = ["id", "cell", "spans", "kept", "_row", "row", "size", "target", "n_bytes", "was_null", "node", "class_id", "group", "distance", "item_id", "field3"]
    texts = [" ".join(draw.choice(words) for _ in range(90)) for _ in range(40)]
    texts[7] = texts[6]
    texts[9] = texts[8][:300] + " " + texts[9]
    rows = [(i, t, "en", "s", len(t), *[f"{c}{i}" for c in clash]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, "nothing of the kind is in any of them at all, not even once here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns
        assert len(found) >= 35
        assert all(r[c] == f"{c}{r['doc_id']}" for r in found for c in clash)
        docs = spark.createDataFrame(found, out.schema)
    assert set(out.columns) - set(docs.columns) == set() and {"mix_size", "mix_target", "taken"} <= set(out.columns)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).filter(F.lit(True)).count() == 0
