"""K-Means whose labels depend on the points alone, not on partitions or the order of addition.

Points have whole-number coordinates, so distances and sums are exact. Seeds are drawn by k-means++ as a race:
of all points the one with the least -ln(u) / d^2 wins, u a number from a hash of its key, d the distance to
the nearest seed so far. That is a draw in proportion to d^2, made by one aggregation. All starts of all fits
take each step together in one pass over the points; starts that have come to rest leave the next.

Most steps need no pass: each start first settles in a task of its own, on the points if they are at most CELLS, else on
that many cells of a grid that stand for theirs. Steps over all points go on from where the cells came to rest.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.session import written

#: Units per standard deviation. Coordinate sums stay below rows times this, as mean absolute values are at most 1.
SCALE = 10_000
MOST_STEPS = 100
#: Points or cells that a task gets.
CELLS = 1 << 16
#: A start is at rest when its centres move by no more than a hundredth of a standard deviation, all squares added.
REST = SCALE * SCALE // 10_000


@dataclass
class Start:
    """One start of one fit: centres, and what the last pass found for them."""

    fit: int
    number: int
    centres: list[tuple[int, ...]] = field(default_factory=list)
    cost: int = 0
    done: bool = False


def whole_numbers(scaled: Column, dimensions: int) -> list[Column]:
    """Standardized values in units of 1 / SCALE, one column each."""
    return [F.floor(scaled[i] * SCALE + 0.5).cast("bigint").alias(f"q{i}") for i in range(dimensions)]


def draw(key: Column, seed: int, start: Column, step: int) -> Column:
    """A number above 0 and up to 1, from a hash of the key, the seed, the start and the step."""
    text = F.concat_ws("|", key, F.lit(str(seed)), start.cast("string"), F.lit(str(step)))
    digits = F.substring(F.md5(text.cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))


def _squared(point: list[Column], centre: list[Column]) -> Column:
    parts = [(p - c) * (p - c) for p, c in zip(point, centre, strict=True)]
    return sum(parts[1:], parts[0])


def _with_starts(points: DataFrame, starts: list[Start], member: list[Column]) -> DataFrame:
    """Every point once for each start of a fit that it is part of, with the centres c0_0, c0_1, ..."""
    rows = []
    for s in starts:
        cells = [F.lit(v).cast("bigint").alias(f"c{j}_{i}") for j, centre in enumerate(s.centres) for i, v in enumerate(centre)]
        rows.append(F.struct(F.lit(s.fit).alias("fit"), F.lit(s.number).alias("start"), *cells))
    every = points.select("*", F.inline(F.array(*rows)))
    taken = F.lit(False)
    for fit, part in enumerate(member):
        taken = F.when(F.col("fit") == fit, part).otherwise(taken)
    return every.where(taken)


def _centres(count: int, dimensions: int) -> list[list[Column]]:
    return [[F.col(f"c{j}_{i}") for i in range(dimensions)] for j in range(count)]


def _seed(points: DataFrame, key: str, starts: list[Start], member: list[Column], k: int, dimensions: int, seed: int) -> None:
    """k centres for every start; where there are fewer distinct points the first comes again."""
    point = [F.col(f"q{i}") for i in range(dimensions)]
    for step in range(k):
        near = [_squared(point, c) for c in _centres(step, dimensions)]
        distance = F.least(*near) if len(near) > 1 else near[0] if near else F.lit(1).cast("bigint")
        race = F.when(distance > 0, -F.log(draw(F.col(key), seed, F.col("start"), step)) / distance)
        best = (
            _with_starts(points, starts, member)
            .withColumn("race", race)
            .where("race IS NOT NULL")
            .groupBy("fit", "start")
            .agg(F.min(F.struct("race", key, *point)).alias("best"))
        )
        found = {(r["fit"], r["start"]): r["best"] for r in best.collect()}  # a row per start
        for s in starts:
            row = found.get((s.fit, s.number))
            s.centres.append(s.centres[0] if row is None else tuple(row[f"q{i}"] for i in range(dimensions)))


def _nearest(distances: list[Column]) -> tuple[Column, Column]:
    """The least distance and the first place that has it."""
    least = F.least(*distances)
    place = F.lit(len(distances) - 1)
    for j in range(len(distances) - 2, -1, -1):
        place = F.when(distances[j] == least, j).otherwise(place)
    return least, place


def _move(points: DataFrame, starts: list[Start], member: list[Column], k: int, dimensions: int) -> None:
    """One step of every start: points go to their nearest centre, centres to the mean of theirs."""
    point = [F.col(f"q{i}") for i in range(dimensions)]
    near = [F.col(f"d{j}") for j in range(k)]
    measured = _with_starts(points, starts, member).select(
        "fit", "start", *point, *[_squared(point, c).alias(f"d{j}") for j, c in enumerate(_centres(k, dimensions))]
    )
    least, place = _nearest(near)
    sums = (
        measured.select("fit", "start", *point, least.alias("least"), place.alias("place"))
        .groupBy("fit", "start", "place")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("least").alias("cost"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(point)])
    )
    means = [F.floor((2 * F.col(f"s{i}") + F.col("n")) / (2 * F.col("n"))).alias(f"m{i}") for i in range(dimensions)]
    rows = sums.select("fit", "start", "place", "cost", *means).collect()  # k rows per start
    found = {(r["fit"], r["start"], r["place"]): r for r in rows}
    for s in starts:
        own = [found.get((s.fit, s.number, j)) for j in range(k)]
        s.cost = sum(r["cost"] for r in own if r)
        moved = [tuple(r[f"m{i}"] for i in range(dimensions)) if r else s.centres[j] for j, r in enumerate(own)]
        s.done, s.centres = _at_rest(s.centres, moved), moved


def _at_rest(before: list[tuple[int, ...]], after: list[tuple[int, ...]]) -> bool:
    return sum((a - b) ** 2 for one, other in zip(before, after, strict=True) for a, b in zip(one, other, strict=True)) <= REST


def _cells(points: DataFrame, member: list[Column], dimensions: int) -> tuple[DataFrame, bool]:
    """At most CELLS rows q0, q1, ..., n, m0, m1, ... (which fits they are of), and whether they are the points.

    A cell is a cube whose edge is doubled until there are so few; it stands for its points by their mean.
    """
    names = [f"q{i}" for i in range(dimensions)]
    flags = [m.alias(f"m{i}") for i, m in enumerate(member)]
    if points.count() <= CELLS:
        return points.select(*names, F.lit(1).cast("long").alias("n"), *flags), True
    size = SCALE // 100
    grid = points.select(*[F.col(c).alias(f"s_{c}") for c in names], *names, F.lit(1).cast("long").alias("n"), *flags)
    while True:
        own = [F.floor(F.col(c) / size).alias(f"g_{c}") for c in names]
        sums = [F.sum(f"s_{c}").alias(f"s_{c}") for c in names]
        grid = grid.groupBy(*own, *[f"m{i}" for i in range(len(member))]).agg(F.sum("n").alias("n"), *sums)
        grid = written(grid.withColumns({c: F.floor(F.col(f"s_{c}") / F.col("n")) for c in names}), "kmeans-cells")
        if grid.count() <= CELLS:
            return grid.select(*names, "n", *[f"m{i}" for i in range(len(member))]), False
        size *= 2


def _settle(k: int, dimensions: int):
    """The steps of one start on its cells: its centres at rest, and their cost before the last move."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[[f"q{i}" for i in range(dimensions)]].to_numpy(np.int64)
        n = frame["n"].to_numpy(np.int64)
        first = frame.iloc[0]
        centres = [tuple(int(first[f"c{j}_{i}"]) for i in range(dimensions)) for j in range(k)]
        for _ in range(MOST_STEPS):
            distance = ((x[:, None, :] - np.array(centres, np.int64)[None]) ** 2).sum(2)
            place = distance.argmin(1)
            cost = int((distance[np.arange(len(x)), place] * n).sum())
            before, centres = centres, list(centres)
            for j in range(k):
                own = place == j
                count = int(n[own].sum())
                if count:
                    sums = (x[own] * n[own, None]).sum(0)
                    centres[j] = tuple(int(v) for v in np.floor((2 * sums + count) / (2 * count)))
            if _at_rest(before, centres):
                break
        flat = [v for c in centres for v in c]
        return pd.DataFrame({"fit": [first["fit"]], "start": [first["start"]], "cost": [cost], "centres": [flat]})

    return run


def fit(points: DataFrame, key: str, member: list[Column], k: int, starts: int, seed: int, dimensions: int) -> list[list[tuple[int, ...]]]:
    """Per fit the centres of its best start (least cost, then first), in order.

    points: key and q0, q1, ... as whole numbers; it is passed over once a step, so it should be a written
    table. member: for each fit, which points it is of. Centres are the means rounded to whole numbers; the cost is
    that before their last move, which is a small one.
    """
    every = [Start(f, s) for f in range(len(member)) for s in range(starts)]
    _seed(points, key, every, member, k, dimensions, seed)
    cells, exact = _cells(points, member, dimensions)
    flags = [F.col(f"m{i}") for i in range(len(member))]
    # One task per start, each with all cells that are its fit's.
    settled = _with_starts(cells, every, flags).groupBy("fit", "start").applyInPandas(
        _settle(k, dimensions), "fit int, start int, cost long, centres array<long>"
    )
    for row in settled.collect():
        s = every[row["fit"] * starts + row["start"]]
        s.centres = [tuple(row["centres"][j * dimensions : (j + 1) * dimensions]) for j in range(k)]
        s.cost, s.done = row["cost"], exact
    for _ in range(MOST_STEPS):
        moving = [s for s in every if not s.done]
        if not moving:
            break
        _move(points, moving, member, k, dimensions)
    best = [min((s for s in every if s.fit == f), key=lambda s: (s.cost, s.number)) for f in range(len(member))]
    return [sorted(s.centres) for s in best]


def label(centres: list[tuple[int, ...]]) -> Column:
    """The place of the nearest of the centres, the first of equally near ones."""
    point = [F.col(f"q{i}") for i in range(len(centres[0]))]
    distances = [_squared(point, [F.lit(v).cast("bigint") for v in c]) for c in centres]
    return _nearest(distances)[1].cast("bigint")
