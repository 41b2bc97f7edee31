"""Quality rules: plain counts per text, and robust outliers among texts of one language and source.

The counts of each text give a vector of transformed statistics. For every language and source the
minimum covariance determinant is estimated: the mean and covariance of the half of the vectors
that lie closest together, found by concentration steps from a few starts, of which the one of
least determinant goes on until it no longer falls. A text is rejected if its squared Mahalanobis
distance passes CUTOFF by the covariance made consistent with normal vectors, plus what the
statistics of a text of its length vary by chance.

A group's vectors come to one task as cells: the vectors themselves, or where they are more than CELLS
the sums of those that share a cell of a grid of so few. There the starts are made and the steps taken. What
the cells of a grid gave is then carried on by steps over all vectors, each one aggregation by group and
bin of distance, until no vector joins or leaves; groups that are done take no further part.
Quantiles of distances are exact counts in fixed bins, so results do not depend on how rows are partitioned.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.llm.common import join_by_key
from basketline.session import scratch_path, written

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
_CONTINUED = bytes(range(0x80, 0xC0))
WINDOW = 5

COUNTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long"}
#: The statistics, and how far a clean text of a few words strays in each: added to the
#: deviations by which the closest half is chosen, so that statistics that are constant in a group
#: still have a scale. Texts are rejected without it.
STATISTICS = {"word_length": 0.2, "symbols": 0.08, "dup_lines": 0.1, "repeats": 0.1}
#: The share of the texts whose covariance is least: the half, so that nearly as many may be junk.
SUBSET = 0.5
#: The steps that each first estimate takes before the best goes on.
TRIAL = 2
#: Steps of the best at most; they end when no logarithm of a determinant falls by more than rounding.
STEPS, ENOUGH = 100, 1e-9
#: Quantiles of the chi-square distribution with 4 degrees of freedom: the median, and 0.999.
MEDIAN, CUTOFF = 3.357, 18.467
#: By how much the closest half of normal vectors understates their covariance, by the number of
#: statistics that vary: 0.5 / P(chi2[q + 2] <= median of chi2[q]).
CONSISTENCY = (1.0, 7.009, 3.259, 2.459, 2.109)
#: Texts of languages and sources with fewer are judged by the estimate of the language, or of all texts.
FEWEST = 50
_BINS = 4096
_DIMENSIONS = len(STATISTICS)
#: Fewer texts have no half of more than _DIMENSIONS vectors, so they have no estimate.
LEAST = 2 * (_DIMENSIONS + 1)
#: Vectors or cells of a group in one task, and the cells per unit of each statistic of the grids that are
#: tried. The last has no more than 64 * 9 * 9 * 9 cells.
CELLS, GRIDS = 1 << 16, (64, 8)
#: Bins of distances are even in the logarithm; those of statistics and of deviations from a centre.
_LOW, _HIGH = -14.0, 14.0
_STATISTIC, _DEVIATION = (-2.0, 6.0), (0.0, 8.0)


def repeated_words(words: list[bytes]) -> int:
    """Words within windows of five words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    key = ids[:n].copy()
    for step in range(1, WINDOW):
        if step > 1 and len(numbers) > 4096:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(numbers) + ids[step : step + n]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return 0
    starts = np.unique(np.concatenate([order[same], order[same + 1]]))
    gaps = np.diff(starts)
    return int(WINDOW + np.minimum(gaps, WINDOW).sum())


def text_counts(data: bytes) -> tuple[int, ...]:
    """COUNTS of a text: words, characters in words, symbols, lines with a word equal to an
    earlier line, words in repeated windows, lines with a word."""
    words = data.split()
    chars = len(data.translate(None, _CONTINUED + SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep and COUNTS of every whole text; a null text is empty. One pass, no shuffle."""
    schema = docs.select(*keep).schema
    for name, kind in COUNTS.items():
        schema = schema.add(name, kind)
    kept = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_counts(value.as_py() or b"") for value in batch.column(len(kept))]
            columns = zip(*found, strict=True) if found else [[]] * len(COUNTS)
            arrays = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.int64()) for c in columns)], names=[f.name for f in schema])

    given = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, kept, strict=True)], F.col(text).cast("binary").alias("_text"))
    return given.mapInArrow(run, schema)


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return F.array(
        F.log((F.col("word_chars") + 1) / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    )


def _group(rows: DataFrame, lang: str, source: str, total: int) -> DataFrame:
    """Add group, by whose estimate a text is judged, and teaches, the groups whose estimates it is part of.

    A language and source with FEWEST usable texts is judged by itself, one with fewer by all texts of
    the language, if those are as many, else by the whole table. group is null only where the whole
    table has fewer than LEAST usable texts.
    """

    def name(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))

    rows = rows.withColumn("_lang", name(lang)).withColumn("_pair", F.to_json(F.struct(F.col("_lang"), name(source).alias("s"))))
    sizes = rows.groupBy("_lang", "_pair").agg(F.count("*").alias("n"), F.count_if("usable").alias("usable"))
    sizes = written(sizes, "quality-sizes")
    of_all = sizes.agg(F.sum("usable")).first()[0] or 0
    pair, language, whole = F.concat(F.lit("p"), "_pair"), F.concat(F.lit("l"), "_lang"), F.lit("all")
    by_language = sizes.groupBy("_lang").agg(F.sum("usable").alias("of_language"), F.count_if((F.col("usable") > 0) & (F.col("usable") < FEWEST)).alias("small"))
    group = F.when(F.col("usable") >= FEWEST, pair).when(F.col("of_language") >= FEWEST, language)
    sizes = sizes.join(by_language, "_lang").withColumn("group", group.when(F.lit(of_all >= LEAST), whole))
    asked = F.lit(bool(sizes.filter("group = 'all' AND usable > 0").head(1)))
    teaches = F.array_compact(
        F.array(
            F.when(F.col("usable") >= FEWEST, pair),
            F.when((F.col("small") > 0) & (F.col("of_language") >= FEWEST), language),
            F.when(asked, whole),
        )
    )
    groups = sizes.select("_pair", "n", "group", teaches.alias("teaches"))
    return join_by_key(rows, written(groups, "quality-groups"), "_pair", "n", total, stored=True).drop("_pair", "_lang")


def _sums(vector: list[Column]) -> list[Column]:
    """Count, sums of the statistics, and sums of their products (upper triangle)."""
    pairs = [F.sum(vector[i] * vector[j]) for i in range(_DIMENSIONS) for j in range(i, _DIMENSIONS)]
    return [F.count("*").alias("cells_n"), F.array(*map(F.sum, vector)).alias("s"), F.array(*pairs).alias("p")]


_TRIANGLE = np.triu_indices(_DIMENSIONS)


def _products(p: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their upper triangles, a row each."""
    out = np.empty((len(p), _DIMENSIONS, _DIMENSIONS))
    out[:, _TRIANGLE[0], _TRIANGLE[1]] = out[:, _TRIANGLE[1], _TRIANGLE[0]] = p
    return out


def _quantile(values: np.ndarray, weights: np.ndarray, low: float, high: float, share: float) -> float:
    """The upper edge of the bin that holds the share-th of the weighted values."""
    place = np.clip(np.floor((values - low) / (high - low) * _BINS), 0, _BINS - 1).astype(np.int64)
    until = np.cumsum(np.bincount(place, weights, _BINS))
    return (int(np.searchsorted(until, np.ceil(until[-1] * share))) + 1) * ((high - low) / _BINS) + low


def _shortest_half(values: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """The middle and half the width of the shortest interval of bins that holds half of the weight."""
    low, high = _STATISTIC
    place = np.clip(np.floor((values - low) / (high - low) * _BINS), 0, _BINS - 1).astype(np.int64)
    counts = np.bincount(place, weights, _BINS)
    bins = np.flatnonzero(counts)
    until = counts[bins].cumsum()
    last = np.searchsorted(until, until - counts[bins] + np.ceil(until[-1] / 2))
    first = np.flatnonzero(last < len(bins))
    best = first[np.argmin(bins[last[first]] - bins[first])]
    width = (high - low) / _BINS
    return (bins[best] + bins[last[best]] + 1) / 2 * width + low, (bins[last[best]] - bins[best]) / 2 * width


class Estimate:
    """A centre, the inverse of a covariance, and the logarithm of its determinant."""

    def __init__(self, center: np.ndarray, spread: np.ndarray):
        spread = (spread + spread.T) / 2 + np.diag(np.square([*STATISTICS.values()]))
        self.center, self.inverse, self.size = center, np.linalg.inv(spread), float(np.linalg.slogdet(spread)[1])

    @classmethod
    def of_sums(cls, n: float, s: np.ndarray, p: np.ndarray) -> "Estimate":
        center = s / n
        return cls(center, p / n - np.outer(center, center))

    def log_distances(self, vectors: np.ndarray) -> np.ndarray:
        away = vectors - self.center
        return np.log(np.maximum(np.einsum("ni,ij,nj->n", away, self.inverse, away), 1e-6))


class Cells:
    """The cells of a group: their weights, sums and products."""

    def __init__(self, weights: np.ndarray, s: np.ndarray, p: np.ndarray):
        order = np.lexsort((s / weights[:, None]).T)
        self.weights, self.s, self.p = weights[order].astype(float), s[order], p[order]
        self.vectors = self.s / self.weights[:, None]

    def middle(self, estimate: Estimate) -> float:
        """The median of the logarithms of distances."""
        return _quantile(estimate.log_distances(self.vectors), self.weights, _LOW, _HIGH, 0.5)

    def step(self, estimate: Estimate) -> Estimate:
        """The estimate of the SUBSET of the vectors that is closest by the estimate given."""
        away = estimate.log_distances(self.vectors)
        near = away <= _quantile(away, self.weights, _LOW, _HIGH, SUBSET)
        return Estimate.of_sums(self.weights[near].sum(), self.s[near].sum(0), self.p[near].sum(0))

    def starts(self) -> list[Estimate]:
        """Medians and absolute deviations, shortest halves, and medians with the covariance of the signs (the
        vectors' directions from the medians, which no far text can stretch)."""
        columns = self.vectors.T
        center = np.array([_quantile(v, self.weights, *_STATISTIC, 0.5) for v in columns])
        spread = np.array([_quantile(np.abs(v - c), self.weights, *_DEVIATION, 0.5) for v, c in zip(columns, center, strict=True)])
        middle, width = np.array([_shortest_half(v, self.weights) for v in columns]).T
        medians = Estimate(center, np.diag((spread * 1.4826) ** 2))
        deviations = 1 / np.sqrt(np.diag(medians.inverse))
        scaled = (self.vectors - center) / deviations
        scaled /= np.sqrt((scaled**2).sum(1, keepdims=True) + 1e-12)
        signs = (scaled * self.weights[:, None]).T @ scaled / self.weights.sum() * _DIMENSIONS
        return [medians, Estimate(middle, np.diag((width * 1.4826) ** 2)), Estimate(center, signs * np.outer(deviations, deviations))]

    def fit(self) -> Estimate:
        """The best start after TRIAL steps, carried on until its determinant no longer falls."""
        found = self.starts()
        for _ in range(TRIAL):
            found = [self.step(e) for e in found]
        # Limits are as exact as the bins, so a determinant that differs by less is no better than the first start's.
        margin = _DIMENSIONS * (_HIGH - _LOW) / _BINS
        best = found[min(range(len(found)), key=lambda i: (found[i].size - (margin if i == 0 else 0), i))]
        for _ in range(STEPS):
            before, best = best, self.step(best)
            if before.size - best.size <= ENOUGH:
                break
        return best


_ESTIMATE = "group string, n long, large boolean, center array<double>, inverse array<double>, size double, middle double"


def _row(group: str, n: int, large: bool, estimate: Estimate, middle: float | None) -> pd.DataFrame:
    row = {"group": group, "n": n, "large": large, "center": estimate.center, "inverse": estimate.inverse.ravel(), "size": estimate.size, "middle": middle}
    return pd.DataFrame({k: [v] for k, v in row.items()})


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    """The estimate of a group by its cells; a vector of its own has no products."""
    weights, s = frame["cells_n"].to_numpy(), np.stack(frame["s"].to_numpy())
    own = frame["p"].isna().to_numpy()
    p = np.einsum("ni,nj->nij", s, s)
    if not own.all():
        p[~own] = _products(np.stack(frame["p"][~own].to_numpy()))
    cells = Cells(weights, s, p)
    best = cells.fit()
    return _row(frame["group"].iloc[0], frame["n"].iloc[0], frame["large"].iloc[0], best, cells.middle(best))


def _cells(rows: DataFrame) -> DataFrame:
    """Per group at most CELLS cells: group, n (its vectors), large, cells_n, s and p.

    rows: group, n, large (more than CELLS vectors) and vector.
    """
    vector = [F.col("vector")[i] for i in range(_DIMENSIONS)]
    none = F.lit(None).cast("array<double>")
    singles = rows.filter("NOT large").select("group", "n", "large", F.lit(1).cast("long").alias("cells_n"), F.col("vector").alias("s"), none.alias("p"))
    if not rows.filter("large").head(1):
        return singles
    low, high = _STATISTIC
    place = [F.floor(F.greatest(F.lit(low), F.least(F.lit(high), v)) * GRIDS[0]).cast("int") for v in vector]
    grid = rows.filter("large").groupBy("group", "n", "large", F.array(*place).alias("cell")).agg(*_sums(vector))
    grid = written(grid, "quality-grid")
    for fine, coarse in zip(GRIDS[:-1], GRIDS[1:], strict=True):
        counts = grid.groupBy("group").agg(F.count("*").alias("_cells"))
        sized = join_by_key(grid, counts.withColumn("_n", F.col("_cells")), "group", "_n", grid.count())
        cell = F.when(F.col("_cells") <= CELLS, F.col("cell")).otherwise(F.transform("cell", lambda c: F.floor(c * coarse / fine).cast("int")))
        parts = [F.array(*[F.sum(F.col(name)[i]) for i in range(width)]).alias(name) for name, width in (("s", _DIMENSIONS), ("p", len(_TRIANGLE[0])))]
        # Cells of either grid have coordinates of their own group only.
        grid = written(sized.groupBy("group", "n", "large", cell.alias("cell")).agg(F.sum("cells_n").alias("cells_n"), *parts), "quality-grid")
    return singles.unionByName(grid.drop("cell"))


def _distance() -> Column:
    """The squared distance of vector from center by inverse."""
    away = [F.col("vector")[i] - F.col("center")[i] for i in range(_DIMENSIONS)]
    terms = [away[i] * away[j] * F.col("inverse")[i * _DIMENSIONS + j] for i in range(_DIMENSIONS) for j in range(_DIMENSIONS)]
    return sum(terms[1:], terms[0])


def _whole_step(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """For the groups found: the estimate of the closest SUBSET of all their vectors, and the median of
    the logarithms of distances by the estimate found (limit and median are the same share)."""
    facts = found.select("group", "n", "center", "inverse", F.col("n").alias("_n"))
    joined = join_by_key(rows.select("group", "vector"), facts, "group", "_n", total, "inner", stored=True)
    away = F.log(F.greatest(_distance(), F.lit(1e-6)))
    place = F.floor((away - _LOW) / (_HIGH - _LOW) * _BINS)
    bins = F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), place)).cast("int")
    sums = joined.groupBy("group", "n", bins.alias("bin")).agg(*_sums([F.col("vector")[i] for i in range(_DIMENSIONS)]))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        weights = frame["cells_n"].to_numpy()
        until = weights.cumsum()
        last = int(np.searchsorted(until, np.ceil(until[-1] * SUBSET)))
        near = frame.iloc[: last + 1]
        s, p = np.stack(near["s"].to_numpy()).sum(0), _products(np.stack(near["p"].to_numpy())).sum(0)
        middle = (int(frame["bin"].iloc[last]) + 1) * ((_HIGH - _LOW) / _BINS) + _LOW
        return _row(frame["group"].iloc[0], frame["n"].iloc[0], True, Estimate.of_sums(until[last], s, p), middle)

    return sums.groupBy("group").applyInPandas(run, _ESTIMATE)


def _carried_on(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """Estimates by steps over all vectors, until no determinant falls; a group that is done is left out of the next."""
    folder, number = scratch_path(rows.sparkSession, "quality-done"), 0
    while True:
        number += 1
        after = written(_whole_step(rows, found, total), "quality-step")
        fell = found.select("group", F.col("size").alias("before")).join(after, "group")
        done = F.lit(number >= STEPS) | (F.col("before") - F.col("size") <= ENOUGH)
        fell = written(fell.withColumn("done", done), "quality-step")
        fell.filter("done").drop("before", "done").write.parquet(f"{folder}/{number}")
        found = fell.filter("NOT done").drop("before", "done")
        if not found.head(1):
            break
    done = rows.sparkSession.read.schema(_ESTIMATE).parquet(*[f"{folder}/{i + 1}" for i in range(number)])
    middle = _whole_step(rows, done, total).select("group", "middle")
    return done.drop("middle").join(middle, "group").select(*[f.split()[0] for f in _ESTIMATE.split(", ")])


def estimates(rows: DataFrame) -> DataFrame:
    """Per group its center, inverse covariance, scale (what distances are divided by) and covariance, made consistent.

    rows: group and vector, of the texts to learn from.
    """
    total = rows.count()
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).withColumn("_n", F.col("n")).withColumn("large", F.col("n") > CELLS)
    sized = written(join_by_key(rows, sizes, "group", "_n", total), "quality-sized")
    fits = written(_cells(sized).groupBy("group").applyInPandas(_fit, _ESTIMATE), "quality-fits")
    large = fits.filter("large")
    if large.head(1):
        fits = fits.filter("NOT large").unionByName(_carried_on(sized.filter("large"), large, total))
    # The covariance of the closest vectors is too small; but distances are never stretched.
    scale = F.greatest(F.lit(1.0), F.exp("middle") / MEDIAN)
    found = fits.select("group", "n", "center", "inverse", scale.alias("scale"))
    schema = "group string, n long, center array<double>, inverse array<double>, scale double, covariance array<double>"
    return written(found.mapInPandas(_consistent, schema), "quality-estimates")


def _consistent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the covariance of all texts that the closest half, without what was added to it, stands for."""
    floors = np.square([*STATISTICS.values()])
    for frame in frames:
        spreads = []
        for inverse in frame["inverse"]:
            spread = np.linalg.inv(np.array(inverse).reshape(_DIMENSIONS, -1)) - np.diag(floors)
            varying = int((np.diag(spread) > 1e-6).sum())
            spreads.append((spread * CONSISTENCY[varying]).ravel())
        yield frame.assign(covariance=spreads)


def _strangeness(vector: pd.Series, center: pd.Series, covariance: pd.Series, chance: pd.Series) -> pd.Series:
    """Squared distances by the covariance plus the chance variances of each text; null without an estimate."""
    out = np.full(len(vector), np.nan)
    known = np.flatnonzero(covariance.notna())
    if len(known):
        v, m, c, d = (np.stack(x.iloc[known].to_numpy()) for x in (vector, center, covariance, chance))
        c = c.reshape(len(known), v.shape[1], v.shape[1]) + d[:, :, None] * np.eye(v.shape[1])
        out[known] = ((v - m) * np.linalg.solve(c, (v - m)[:, :, None])[:, :, 0]).sum(1)
    return pd.Series(out)


def _chance() -> Column:
    """The variances of _vector() by the sampling of a text of its length: of a root of a share of n, 1 / 4n.

    The lengths of words deviate by about half their mean; two equal windows are ten words at once.
    """
    words = F.greatest(F.col("n_words"), F.lit(1))
    return F.array(0.25 / words, 0.25 / F.greatest(F.col("word_chars"), F.lit(1)), 0.25 / F.greatest(F.col("n_lines"), F.lit(1)), 0.25 * 2 * WINDOW / words)


def judge(docs: DataFrame, text: str, lang: str, source: str, keep: list[str]) -> DataFrame:
    """The columns to keep, COUNTS, base_failed, distance (squared, scaled; without the allowance for the
    text's length) and kept of each row.

    A null text has no words, so it fails the base rules, as does an empty one. A null language or
    source is one like another. distance is null, and only the base rules count, where the whole
    table has fewer than LEAST usable texts. Repeated rows are judged, and count, each;
    an empty table stays empty. Names with a leading underscore are reserved.
    """
    named = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(lang).alias("_l"), F.col(source).alias("_s"), F.col(text).alias("_t"))
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = written(counts(named, "_t", [*names, "_l", "_s"]), "quality-counts")
    total = rows.count()
    rows = rows.withColumn("base_failed", base_failed())
    rows = written(_group(rows.withColumn("usable", ~F.col("base_failed")), "_l", "_s", total), "quality-rows")
    usable = rows.filter("usable").select(F.explode("teaches").alias("group"), _vector().alias("vector"))
    estimated = estimates(written(usable, "quality-vectors")).drop("n")
    judged = rows.groupBy("group").agg(F.count("*").alias("n"))
    estimated = written(estimated.join(judged, "group"), "quality-estimates")
    measured = join_by_key(rows.withColumn("vector", _vector()), estimated, "group", "n", total, stored=True).withColumn("distance", _distance())
    distance = F.when(~F.col("base_failed"), F.col("distance") / F.col("scale"))
    strange = F.pandas_udf(_strangeness, "double")("vector", "center", "covariance", _chance()) > CUTOFF
    kept = ~F.col("base_failed") & (F.col("covariance").isNull() | ~strange)
    return measured.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *COUNTS, "base_failed", distance.alias("distance"), kept.alias("kept"))
