"""URL filter: rules for hosts and paths, and character models for the URLs without a rule.

URLs that a rule allows and URLs that a rule blocks train one Markov model each, of order 0 to 3
with Witten-Bell smoothing. The score of a URL is the mean over its characters of the difference
of the two log-likelihoods; it passes at the threshold that separates the ruled URLs kept from
training best (largest sum of the two classes' rates).

Characters are folded to 34 symbols (lower-case letters, 0 for digits, . / - _ * for the rest, start
and end), so there are at most 34^4 = 1,336,336 grams whatever the input; tables by gram have that
bound when they are broadcast.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketline.llm.common import join_by_key

ORDER = 3
SYMBOLS = 34
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every so many-th distinct folded URL calibrates, the others train.
CALIBRATE = 5
_BINS = 2000
_BIN_WIDTH = 0.005


def _after_scheme(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without a ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one.

    rules: (verdict, host/path). A rule fits its host and all subdomains where the path starts
    with the rule's. Rules are few and given by the caller, so they become one expression.
    """
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = (F.col(host) == name) | F.col(host).endswith("." + name)
        fits = fits & F.col(path).startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def folded(host: str, path: str) -> Column:
    """Host and path in the model's symbols, with its start and end."""
    text = F.lower(F.concat(F.col(host), F.col(path)))
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), r"[^a-z0./\-_]", "*")
    return F.concat(F.lit("^" * ORDER), text, F.lit("$"))


def _grams(rows: DataFrame) -> DataFrame:
    """One row per character: the gram that ends with it."""
    places = F.sequence(F.lit(1), F.length("folded") - ORDER)
    return rows.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring(F.col("folded"), i, F.lit(ORDER + 1)))))


def gram_scores(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """gram and score for each of the grams: the difference of the models' log-probabilities.

    counts: gram, allow and block (how often it occurs in the training URLs of each class).
    p_k(c|h) = (n(h,c) + T(h) p_(k-1)(c|h')) / (n(h) + T(h)), with T(h) the distinct characters
    that follow h; a context that a class has not seen leaves the shorter one's probability.
    """
    uniform = F.lit(1.0 / SYMBOLS)
    scored = grams.withColumns({"p_allow": uniform, "p_block": uniform})
    for order in range(ORDER + 1):
        key = F.substring("gram", ORDER + 1 - order, order + 1)
        seen = counts.groupBy(key.alias("key")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        contexts = seen.groupBy(F.substring("key", 1, order).alias("context")).agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("allow", "block")],
            *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in ("allow", "block")],
        )
        scored = scored.withColumns({"key": key, "context": F.substring("gram", ORDER + 1 - order, order)})
        scored = scored.join(F.broadcast(seen), "key", "left").join(F.broadcast(contexts), "context", "left")
        for c in ("allow", "block"):
            n, t, p = F.coalesce(f"n_{c}", F.lit(0)), F.coalesce(f"t_{c}", F.lit(0)), F.col(f"p_{c}")
            better = F.try_divide(F.coalesce(c, F.lit(0)) + t * p, n + t)
            scored = scored.withColumn(f"p_{c}", F.when(t > 0, better).otherwise(p))
        scored = scored.select("gram", "p_allow", "p_block")
    return scored.select("gram", (F.log("p_allow") - F.log("p_block")).alias("score"))


def threshold(scores: DataFrame) -> DataFrame:
    """One row, threshold: the score from which on URLs pass; 0 unless both classes are there.

    scores: score, allow and block (URLs of each class). Scores are counted in bins, so the
    running sums are over _BINS rows; of equally good thresholds it is the one nearest 0.
    """
    place = F.floor(F.col("score") / _BIN_WIDTH)
    bins = F.greatest(F.lit(-_BINS // 2), F.least(F.lit(_BINS // 2 - 1), place)).alias("bin")
    counts = scores.groupBy(bins).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocked = F.try_divide(F.coalesce(F.sum("block").over(below), F.lit(0)), F.sum("block").over(whole))
    lost = F.try_divide(F.coalesce(F.sum("allow").over(below), F.lit(0)), F.sum("allow").over(whole))
    good = counts.select("bin", F.round(blocked - lost, 12).alias("good")).filter("good IS NOT NULL")
    best = good.agg(F.max_by("bin", F.struct("good", -F.abs("bin"), "bin")).alias("bin"))
    return best.select(F.coalesce(F.col("bin") * F.lit(_BIN_WIDTH), F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, key: str, url: str, rules: list[tuple[str, str]]) -> DataFrame:
    """key, url, host, path, rule, score, threshold and verdict of every row.

    A null URL, or one without ://, has empty host and path, so no rule, and is scored like any
    other. Where no URL trains one of the classes its model is uniform; repeated rows stay
    repeated and count for the models each time, as do null keys. Other columns are not read.
    """
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("_url"))
    rows = rows.withColumn("host", host(F.col("_url"))).withColumn("path", path(F.col("_url")))
    rule, ruled = matching_rule("host", "path", rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled, "folded": folded("host", "path")})
    texts = rows.groupBy("folded").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ruled") == "allow").alias("allow"),
        F.count_if(F.col("ruled") == "block").alias("block"),
    )
    kept = F.crc32(F.col("folded").cast("binary")) % CALIBRATE == 0
    grams = _grams(texts.withColumn("kept", kept)).groupBy("gram").agg(
        *[F.sum(F.when(F.col("kept"), 0).otherwise(F.col(c))).alias(c) for c in ("allow", "block")]
    )
    scores = gram_scores(grams, grams.select("gram"))
    # Summed in units of 1e-9, so that the order of addition cannot change a score.
    points = F.sum(F.round(F.col("score") * 1e9).cast("long")) / F.count("*") / 1e9
    scored = _grams(texts).join(F.broadcast(scores), "gram").groupBy("folded", "n", "allow", "block").agg(points.alias("score"))
    calibrate = threshold(scored.filter(kept).select("score", "allow", "block"))
    judged = join_by_key(rows, scored.select("folded", "n", "score"), "folded", "n", rows.count())
    judged = judged.crossJoin(F.broadcast(calibrate))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block"))
    return judged.select(key, F.col("_url").alias("url"), "host", "path", "rule", "score", "threshold", verdict.alias("verdict"))
