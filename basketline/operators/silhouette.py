"""Euclidean silhouettes without comparing all pairs.

The points are put into the cells of a tree: a cube, its eight (in three dimensions) halves, and so on, down to
cells of at most LEAF points. Pairs of cells are met from the top down. Where two are far enough apart, the distances
from any point x of the one to the points y of the other are a polynomial of x: with v the way between the centres,
u its direction, and h = x - y - v, they add up over y as |v| + u h + (h h - (u h)^2) / 2 |v|, which takes the number,
mean and second moments of the y. Pairs that are not are replaced by their halves; leaves that are left are compared
point by point. The polynomials of a leaf and of the cells around it are added up, so a point takes one per cluster.

The error of that sum, per point, is at most K r^3 / (d - r)^2, with r half the sum of the diagonals of the boxes
around what is in both cells, and d the distance of their centres: K = 1 / (3 sqrt 3) is a sixth of the largest third derivative of a distance, 2 / sqrt 3. Cells
are far apart where that is within the tolerance. Cells whose diagonal is within the tolerance are not halved; they go
by their mean. So mean distances are right to the tolerance, and the silhouette of a point to
silhouette_bound, which is 0 where only points were compared.

Each round of the descent is one join by cell. Rows grow with the number of leaves, not with the pairs of points.
Leaves are scored in blocks of up to BLOCK points, to which the points around them travel once.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketline.session import scratch_path, written

LEAF = 48
#: Up to so many points in all are compared with each other.
EXACT = 1024
#: Points that are scored together.
BLOCK = 8192
#: Halvings of the cube along each axis.
LEVELS = 20
#: Mean distances are right to this, in the unit of the points.
TOLERANCE = 0.005
#: Pairs of cells opened, or summed, by a task.
OPENED, SUMMED = 50_000, 1_000_000
_K = 1 / (3 * math.sqrt(3))


def _cell(vector: Column, low: list[float], side: float) -> Column:
    """The cell of a point at the last level: a one, then the bits of its coordinates in turn."""
    d = len(low)
    places = [F.least(F.floor((vector[i] - low[i]) / side * (1 << LEVELS)), F.lit((1 << LEVELS) - 1)) for i in range(d)]
    bits = [
        F.shiftleft(F.shiftright(place.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint")), bit * d + i)
        for bit in range(LEVELS)
        for i, place in enumerate(places)
    ]
    return reduce(Column.bitwiseOR, bits, F.lit(1 << (d * LEVELS)))


def _middle(cell: Column, level: Column, d: int) -> list[Column]:
    """The centre of a cell, the cube being 0 to 1."""
    out = []
    for i in range(d):
        bits = [F.shiftleft(F.shiftright(cell, bit * d + i).bitwiseAND(F.lit(1).cast("bigint")), bit) for bit in range(LEVELS + 1)]
        place = reduce(Column.bitwiseOR, bits)
        # The leading one of a cell is the next bit of the first axis.
        place = place - (F.pow(F.lit(2.0), level) if i == 0 else 0)
        out.append((place + 0.5) / F.pow(F.lit(2.0), level))
    return out


def _ancestors(rows: DataFrame, cell: str, d: int, levels: int = LEVELS) -> DataFrame:
    """Every row once per cell, down to a level, that its cell lies in: node, level."""
    up = F.explode(F.sequence(F.lit(LEVELS - levels), F.lit(LEVELS))).alias("up")
    rows = rows.select("*", up)
    node = F.expr(f"shiftright({cell}, up * {d})")
    return rows.withColumns({"node": node, "level": F.lit(LEVELS) - F.col("up")}).drop("up")


def _tree(fine: DataFrame, d: int, leaf: int, levels: int = LEVELS) -> DataFrame:
    """The cells: node, level, parent, n and is_leaf. A cell is there if the one above has more than `leaf` points."""
    counts = fine.groupBy("cell").agg(F.sum("n").alias("n"))
    counts = written(_ancestors(counts, "cell", d, levels).groupBy("node", "level").agg(F.sum("n").alias("n")), "cells")
    split = (F.col("n") > leaf) & (F.col("level") < levels)
    inner = counts.where(split).select(F.col("node").alias("parent"))
    rows = counts.withColumns({"parent": F.expr(f"shiftright(node, {d})"), "is_leaf": ~split})
    root = rows.where("level = 0")
    return written(rows.where("level > 0").join(inner, "parent", "left_semi").unionByName(root), "tree")


def _moments(fine: DataFrame, tree: DataFrame, d: int, levels: int = LEVELS) -> DataFrame:
    """Per cell and label: n, mean, second moments about it, and the least and greatest coordinates."""
    sums = ["n", *[f"s{i}" for i in range(d)], *[f"p{i}{j}" for i in range(d) for j in range(d)]]
    found = _ancestors(fine, "cell", d, levels).join(tree.select("node"), "node", "left_semi")
    ends = [f(f"{c}{i}").alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]
    found = found.groupBy("node", "label").agg(*[F.sum(c).alias(c) for c in sums], *ends)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(d)]
    about = [F.col(f"p{i}{j}") - mean[i] * F.col(f"s{j}") for i in range(d) for j in range(d)]
    names = [f"{c}{i}" for c in ("lo", "hi") for i in range(d)]
    return written(found.select("node", "label", "n", F.array(*mean).alias("v"), F.array(*about).alias("m"), *names), "moments")


def _boxes(moments: DataFrame, d: int, low: list[float]) -> DataFrame:
    """Centre (from the corner of the cube) and radius of what is in each cell."""
    least, most = ([f(f"{c}{i}") - low[i] for i in range(d)] for c, f in (("lo", F.min), ("hi", F.max)))
    squares = [(b - a) * (b - a) for a, b in zip(least, most, strict=True)]
    radius = F.sqrt(reduce(Column.__add__, squares)) / 2
    places = [((a + b) / 2).alias(f"c{i}") for i, (a, b) in enumerate(zip(least, most, strict=True))]
    return written(moments.groupBy("node").agg(radius.alias("radius"), *places), "boxes")


def _descend(tree: DataFrame, d: int, side: float, tolerance: float, boxes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of cells (target, node): those that go by a polynomial, of any level, and leaves that do not.

    boxes: centre and radius of what is in each cell; without them a cell is taken as full.
    """
    spark, folder = tree.sparkSession, scratch_path(tree.sparkSession, "descent")
    axes = [f"c{i}" for i in range(d)]
    if boxes is None:
        radius = F.lit(math.sqrt(d) / 2 * side) / F.pow(F.lit(2.0), F.col("level"))
        places = [(place * side).alias(name) for place, name in zip(_middle(F.col("node"), F.col("level"), d), axes, strict=True)]
        known = tree.select("node", "parent", "level", (F.col("is_leaf") | (2 * radius <= tolerance)).alias("done"), radius.alias("radius"), *places)
    else:
        known = tree.select("node", "parent", "level", F.col("is_leaf").alias("done")).join(boxes, "node")
    # The halves of every cell; a cell that is not halved stands for itself.
    below = known.where("level > 0").unionByName(known.where("done").withColumn("parent", F.col("node"))).drop("level")
    below = written(below, "halves")
    targets, nodes = (below.select(*[F.col(c).alias(f"{side_}_{c}") for c in below.columns]) for side_ in ("t", "s"))
    opened = tree.where("level = 0").select(F.col("node").alias("target"), "node")
    schema, step, count = "target long, node long, kind string", 0, 1
    while count:
        pairs = opened.repartition(-(-count // OPENED), "target", "node")
        pairs = pairs.join(targets, F.col("target") == F.col("t_parent")).join(nodes, F.col("node") == F.col("s_parent"))
        away = [F.col(f"t_{c}") - F.col(f"s_{c}") for c in axes]
        r = F.col("t_radius") + F.col("s_radius")
        least = F.sqrt(sum((a * a for a in away[1:]), away[0] * away[0])) - r
        series = (least > 0) & (F.lit(_K) * r * r * r <= F.lit(tolerance) * least * least)
        kind = F.when(series, "far").when(F.col("t_done") & F.col("s_done"), "near").otherwise("open")
        found = pairs.select(F.col("t_node").alias("target"), F.col("s_node").alias("node"), kind.alias("kind"))
        found.write.partitionBy("kind").parquet(f"{folder}/{step}")
        opened = spark.read.schema(schema).parquet(f"{folder}/{step}").where("kind = 'open'").drop("kind")
        step, count = step + 1, opened.count()
    every = reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{folder}/{i}") for i in range(step)])
    return tuple(every.where(F.col("kind") == name).select("target", "node") for name in ("far", "near"))


def _polynomials(d: int, low: list[float]):
    """The distances from a point x of a target to all points of a cell and cluster, as factors of 1, x and x x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy().astype(float)
            mean = batch.column("v").flatten().to_numpy().reshape(-1, d) - np.array(low)
            about = batch.column("m").flatten().to_numpy().reshape(-1, d, d)
            here, there = (np.stack([batch.column(f"{c}{i}").to_numpy() for i in range(d)], 1) for c in ("t", "c"))
            v = here - there
            distance = np.sqrt((v**2).sum(1))
            u = v / distance[:, None]
            q = (np.eye(d) - u[:, :, None] * u[:, None, :]) / (2 * distance[:, None, None])
            off = there - mean
            spread = about + n[:, None, None] * off[:, :, None] * off[:, None, :]
            constant = n * (distance + (u * off).sum(1)) + (q * spread).sum((1, 2))
            slope = n[:, None] * (u + 2 * (q @ off[:, :, None])[:, :, 0])
            q = q * n[:, None, None]
            bent = (q @ here[:, :, None])[:, :, 0]
            constant += ((bent - slope) * here).sum(1)
            slope -= 2 * bent
            factors = np.concatenate([constant[:, None], slope, q.reshape(-1, d * d)], 1)
            columns = [batch.column("target"), batch.column("label"), *(pa.array(c) for c in factors.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["target", "label", *(f"p{i}" for i in range(factors.shape[1]))])

    return run


def _far_sums(far: DataFrame, tree: DataFrame, moments: DataFrame, boxes: DataFrame, d: int, low: list[float]) -> DataFrame:
    """Per leaf and cluster the polynomial of all cells that go by one: leaf, label and p."""
    names = [f"p{i}" for i in range(1 + d + d * d)]
    dealt = far.repartition(-(-max(far.count(), 1) // SUMMED), "target")
    axes = [f"c{i}" for i in range(d)]
    own = boxes.select(F.col("node").alias("target"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(axes)])
    cells = moments.join(boxes, "node").select("node", "label", "n", "v", "m", *axes)
    rows = dealt.join(own, "target").join(cells, "node").drop("node")
    rows = rows.mapInArrow(_polynomials(d, low), "target long, label long, " + ", ".join(f"{c} double" for c in names))
    own = written(rows.groupBy("target", "label").agg(*[F.sum(c).alias(c) for c in names]), "polynomials")
    above = F.explode(F.sequence(F.lit(0), F.col("level"))).alias("up")
    leaves = tree.where("is_leaf").select(F.col("node").alias("leaf"), "level", above)
    leaves = leaves.select("leaf", F.expr(f"shiftright(leaf, up * {d})").alias("target"))
    sums = leaves.join(own, "target").groupBy("leaf", "label").agg(*[F.sum(c).alias(c) for c in names])
    return sums.select("leaf", "label", F.array(*names).alias("p"))


def _score(names: list[str], labels: list[int], sizes: list[int], d: int, error: float, low: list[float]):
    """Silhouettes of the points of a block, or of a part of it, from what its leaves meet: points and cells of the
    leaves around (v, n times), which leaves these are (near), and polynomials (p)."""
    place = {label: i for i, label in enumerate(labels)}

    def rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy().reshape(-1, width)

    def run(points: pa.Table, sources: pa.Table) -> pa.Table:
        given = points.select(names)
        x = rows(points.column("_v"), d)
        own = np.array([place[v] for v in points.column("_label").to_pylist()], np.int64)
        total = np.zeros((len(x), len(labels)))
        exact = np.ones(len(x), bool)
        leaf = points.column("_leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        found, first = np.unique(leaf[order], return_index=True)
        of_leaf = dict(zip(found.tolist(), np.split(order, first[1:]), strict=True))

        met = sources.filter(pc.is_valid(sources.column("v"))).sort_by("leaf")
        v, n = rows(met.column("v"), d), met.column("n").to_numpy().astype(float)
        kinds = np.zeros((len(v), len(labels)))
        kinds[np.arange(len(v)), [place[k] for k in met.column("label").to_pylist()]] = n
        plain = met.column("plain").to_numpy(zero_copy_only=False).astype(bool)
        cells, starts = np.unique(met.column("leaf").to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(v))
        around = sources.filter(pc.is_valid(sources.column("near")))
        for target, near in zip(around.column("leaf").to_pylist(), around.column("near"), strict=True):
            at = of_leaf.get(target)
            if at is None:
                continue
            where = np.searchsorted(cells, np.sort(near.values.to_numpy()))
            lengths = ends[where] - starts[where]
            took = np.arange(lengths.sum()) + np.repeat(starts[where] - np.cumsum(lengths) + lengths, lengths)
            exact[at] &= not plain[took].any()
            for some in np.array_split(at, -(-len(at) // 256)):
                for part in np.array_split(took, -(-len(took) // 4096)):
                    squares = sum((x[some, i, None] - v[None, part, i]) ** 2 for i in range(d))
                    total[some] += np.sqrt(squares) @ kinds[part]
        far = sources.filter(pc.is_valid(sources.column("p")))
        if far.num_rows:
            factors = rows(far.column("p"), 1 + d + d * d)
            for target, label, p in zip(far.column("leaf").to_pylist(), far.column("label").to_pylist(), factors, strict=True):
                at = of_leaf.get(target)
                if at is not None:
                    y = x[at] - np.array(low)
                    total[at, place[label]] += p[0] + y @ p[1 : d + 1] + ((y @ p[d + 1 :].reshape(d, d)) * y).sum(1)
                    exact[at] = False
        count = np.array(sizes, float)
        at = np.arange(len(x))
        inner = total[at, own] / np.maximum(count[own] - 1, 1)
        outer = total / count
        outer[at, own] = np.inf
        outer = outer.min(1)
        most = np.maximum(inner, outer)
        alone = (count[own] == 1) | (most == 0)
        score = np.where(alone, 0.0, (outer - inner) / np.where(alone, 1.0, most))
        # A sum over n points is off by n errors at most; the own cluster's mean divides by n - 1.
        off = error * count[own] / np.maximum(count[own] - 1, 1)
        bound = np.where(alone, 0.0, np.minimum(2.0, 2 * off / np.maximum(most - 2 * off, 1e-300)))
        bound = np.where(exact, 0.0, bound)
        return given.append_column("silhouette", pa.array(score)).append_column("silhouette_bound", pa.array(bound))

    return run


def silhouettes(points: DataFrame, label: str, vector: str = "scaled", dimensions: int = 3, tolerance: float = TOLERANCE, leaf: int = LEAF) -> DataFrame:
    """Add silhouette and silhouette_bound (how far it may be off) to points.

    vector: an array of so many numbers, none null; label: a whole number. A point alone in its cluster has
    silhouette 0. There must be two clusters at least; their number is that of a segmentation, as the sizes of
    all are known to every task. Equal points count each. An empty table stays empty.
    """
    d = dimensions
    spark = points.sparkSession
    others = [c for c in points.columns if c not in ("silhouette", "silhouette_bound")]
    schema = points.select(*others).schema.add("silhouette", "double").add("silhouette_bound", "double")
    box = points.agg(*[f(F.col(vector)[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("low", F.min), ("high", F.max))]).first()
    if box["low0"] is None:
        return spark.createDataFrame([], schema)
    low = [box[f"low{i}"] for i in range(d)]
    side = max(box[f"high{i}"] - box[f"low{i}"] for i in range(d)) or 1.0
    kept = [F.col(c).alias(f"f{i}") for i, c in enumerate(others)]
    coordinates = F.transform(vector, lambda x: x.cast("double"))
    given = points.select(*kept, F.col(label).cast("bigint").alias("_label"), coordinates.alias("_v"))
    given = written(given.withColumn("_cell", _cell(F.col("_v"), low, side)), "placed")

    v = [F.col("_v")[i] for i in range(d)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(v[i]).alias(f"s{i}") for i in range(d)]]
    sums += [F.sum(v[i] * v[j]).alias(f"p{i}{j}") for i in range(d) for j in range(d)]
    sums += [f(v[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]
    fine = written(given.groupBy(F.col("_cell").alias("cell"), F.col("_label").alias("label")).agg(*sums), "finest")
    # Below this level cells are no wider than the tolerance.
    levels = max(0, min(LEVELS, math.ceil(math.log2(side * math.sqrt(d) / tolerance))))
    sizes = {r["label"]: r["n"] for r in fine.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row per cluster
    labels = sorted(sizes)
    leaf = EXACT if leaf == LEAF and sum(sizes.values()) <= EXACT else leaf
    tree = _tree(fine, d, leaf, levels)

    # A block is the widest cell of up to BLOCK points, or a leaf of the last level with more, dealt out in parts.
    ends = tree.where("is_leaf").select("node", "level", "n")
    above = F.explode(F.sequence(F.lit(0), F.col("level"))).alias("up")
    wide = ends.select(F.col("node").alias("leaf"), F.col("n").alias("own"), above).withColumn("node", F.expr(f"shiftright(leaf, up * {d})"))
    wide = wide.join(tree.select("node", "n"), "node").where((F.col("n") <= BLOCK) | (F.col("up") == 0))
    blocks = wide.groupBy("leaf").agg(F.min("node").alias("block"), F.ceil(F.max("own") / BLOCK).cast("int").alias("parts"))
    blocks = written(blocks, "blocks")
    homes = _ancestors(fine.select("cell").distinct(), "cell", d, levels).join(ends, ["node", "level"])
    homes = homes.select(F.col("cell").alias("_cell"), F.col("node").alias("_leaf")).join(blocks, F.col("_leaf") == F.col("leaf"))
    placed = given.join(homes.drop("leaf"), "_cell")
    part = F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")
    placed = written(placed.withColumn("_part", part), "placed")

    moments = _moments(fine, tree, d, levels)
    boxes = _boxes(moments, d, low)
    far, near = _descend(tree, d, side, tolerance, boxes)
    # What a leaf is to others: its points, equal ones together, or its mean where it is of the last level.
    last = ends.where(F.col("level") == levels).select("node")
    cells = moments.join(last, "node").select(F.col("node").alias("leaf"), "label", "n", "v", (F.col("n") > 1).alias("plain"))
    ones = placed.join(last, placed["_leaf"] == last["node"], "left_anti").groupBy(F.col("_leaf").alias("leaf"), F.col("_label").alias("label"), F.col("_v").alias("v"))
    ones = ones.agg(F.count(F.lit(1)).alias("n")).select("leaf", "label", "n", "v", F.lit(False).alias("plain"))
    met = written(near.join(blocks, F.col("target") == F.col("leaf")).select("target", "block", F.col("node").alias("leaf")), "near")
    lent = met.select("block", "leaf").distinct().join(cells.unionByName(ones), "leaf")
    lists = met.groupBy("block", F.col("target").alias("leaf")).agg(F.collect_list("leaf").alias("near"))
    sums = _far_sums(far, tree, moments, boxes, d, low).join(blocks.select("leaf", "block"), "leaf")
    sources = lent.unionByName(lists, allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)
    # Only a block that is a single leaf has parts; each of them meets the same.
    shares = blocks.groupBy("block").agg(F.explode(F.sequence(F.lit(0), F.max("parts") - 1)).alias("part"))
    sources = sources.join(shares, "block").select("block", "part", "leaf", "label", "n", "v", "plain", "near", "p")
    run = _score([f"f{i}" for i in range(len(others))], labels, [sizes[k] for k in labels], d, max(tolerance, side * math.sqrt(d) / (1 << LEVELS)), low)
    asked = placed.select(*[f"f{i}" for i in range(len(others))], "_label", "_v", "_leaf", "block", "_part")
    found = asked.groupBy("block", "_part").cogroup(sources.groupBy("block", "part"))
    named = spark.createDataFrame([], schema).toDF(*[f"f{i}" for i in range(len(others))], "silhouette", "silhouette_bound").schema
    scored = found.applyInArrow(run, named)
    return scored.toDF(*others, "silhouette", "silhouette_bound")


def silhouette_euclidean(points: DataFrame, label: str, vector: str = "scaled", dimensions: int = 3, tolerance: float = TOLERANCE, leaf: int = LEAF) -> DataFrame:
    """One row: the mean silhouette and the bound of its error; null without points."""
    scored = silhouettes(points.select(label, vector), label, vector, dimensions, tolerance, leaf)
    return scored.agg(F.avg("silhouette").alias("silhouette"), F.avg("silhouette_bound").alias("silhouette_bound"))
