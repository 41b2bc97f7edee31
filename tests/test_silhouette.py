import random

import numpy as np
import pytest

from basketline.operators import kmeans, silhouette
from pyspark.sql import functions as F


def plain(points, labels):
    """Silhouettes from all pairs."""
    x, labels = np.array(points, float), np.array(labels)
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    kinds = sorted(set(labels))
    means = np.stack([distance[:, labels == k].mean(1) for k in kinds], 1)
    out = []
    for i, own in enumerate(labels):
        size = (labels == own).sum()
        a = distance[i, labels == own].sum() / max(size - 1, 1)
        b = min(means[i, j] for j, k in enumerate(kinds) if k != own)
        out.append(0.0 if size == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


def clouds(kind):
    draw = np.random.default_rng(8)
    if kind == "clusters":
        points = np.concatenate([draw.normal(c, 0.4, (150, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, -2))])
        labels = np.repeat([7, 8, 9], 150)
        labels[::17] = 8
    elif kind == "tail":
        points = np.concatenate([np.abs(draw.standard_t(1.5, (400, 3))), [[900.0, 0, 0], [0, 0, 350.0]]])
        labels = (points[:, 0] > 1).astype(int) + 2 * (points[:, 2] > 2)
    else:
        points = np.concatenate([np.repeat([[1.0, 2, 3]], 200, 0), np.repeat([[1.0, 2, 3.5]], 60, 0), [[9.0, 9, 9]], draw.normal(0, 1, (40, 3))])
        labels = np.concatenate([np.zeros(200), np.ones(60), [2], draw.integers(0, 2, 40)]).astype(int)
    return points.tolist(), labels.tolist()


@pytest.mark.parametrize("kind, leaf, tolerance", [("clusters", 4, 0.05), ("clusters", 1024, 0.005), ("tail", 24, 0.005), ("copies", 4, 0.005)])
def test_within_the_bound(spark, kind, leaf, tolerance):
    points, labels = clouds(kind)
    rows = [(i, p, c) for i, (p, c) in enumerate(zip(points, labels, strict=True))]
    frame = spark.createDataFrame(rows, "id int, scaled array<double>, c int")
    got = silhouette.silhouettes(frame, "c", tolerance=tolerance, leaf=leaf).orderBy("id").collect()
    want = plain(points, labels)
    score, bound = (np.array([r[n] for r in got]) for n in ("silhouette", "silhouette_bound"))
    assert len(score) == len(want)
    assert (np.abs(score - want) <= bound + 1e-9).all()
    if leaf > len(points):
        assert (bound == 0).all()
    else:
        assert (bound > 0).any()
        # In the mean it is much nearer than the bound says.
        assert abs(score.mean() - want.mean()) < tolerance / 5


def test_one_axis_and_odd_input(spark):
    rows = [([0.0], 0, "x"), ([1.0], 0, "x"), ([10.0], 1, "x"), ([11.0], 1, "x")]
    frame = spark.createDataFrame(rows, "v array<double>, c long, f0 string")
    got = silhouette.silhouettes(frame, "c", vector="v", dimensions=1)
    assert sorted(round(r["silhouette"], 6) for r in got.collect()) == sorted(round(1 - a, 6) for a in (1 / 10.5, 1 / 9.5, 1 / 9.5, 1 / 10.5))
    assert got.columns == ["v", "c", "f0", "silhouette", "silhouette_bound"]
    assert silhouette.silhouettes(frame.limit(0), "c", vector="v", dimensions=1).count() == 0
    assert silhouette.silhouette_euclidean(frame.limit(0), "c", vector="v", dimensions=1).first()["silhouette"] is None
    same = spark.createDataFrame([([1.0], i % 2) for i in range(6)], "v array<double>, c long")
    assert {r["silhouette"] for r in silhouette.silhouettes(same, "c", vector="v", dimensions=1).collect()} == {0.0}


def test_rows_do_not_grow_with_pairs(spark):
    """Sources that the leaves meet, for four times the points, are about four times as many, and not sixteen."""
    sizes = []
    for n in (1500, 6000):
        draw = np.random.default_rng(3)
        rows = [(p.tolist(),) for p in draw.uniform(0, 60, (n, 2))]
        frame = spark.createDataFrame(rows, "v array<double>")
        box = 60.0
        cell = silhouette._cell(F.col("v"), [0.0, 0.0], box)
        fine = frame.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        tree = silhouette._tree(fine, 2, 8)
        far, near = silhouette._descend(tree, 2, box, 3.0)
        sizes.append(far.count() + near.count())
    assert sizes[1] < 7 * sizes[0]


def test_most_points_are_not_compared(spark, monkeypatch):
    """Cells with many points within reach of each other are halved before their points are compared."""
    seen, plain_descend = [], silhouette._descend
    monkeypatch.setattr(silhouette, "_descend", lambda tree, *rest: seen.append((tree, plain_descend(tree, *rest))) or seen[0][1])
    draw = np.random.default_rng(5)
    points = draw.normal(0, 1, (3000, 2))
    labels = (points[:, 0] > 0.3).astype(int)
    frame = spark.createDataFrame([(p.tolist(), c) for p, c in zip(points, labels.tolist(), strict=True)], "scaled array<double>, c int")
    got = silhouette.silhouette_euclidean(frame, "c", dimensions=2, tolerance=0.02).first()["silhouette"]
    assert abs(got - plain(points, labels).mean()) < 0.001
    tree, (_, near) = seen[0]
    n = {r["node"]: r["n"] for r in tree.collect()}
    assert sum(n[r["target"]] * n[r["node"]] for r in near.collect()) < len(points) ** 2 / 2


# K-Means


def plain_fit(rows, key, k, starts, seed):
    """The same draws and steps, point by point."""
    import hashlib
    import math

    def u(name, start, step):
        digits = hashlib.md5(f"{name}|{seed}|{start}|{step}".encode()).hexdigest()[:13]
        return (int(digits, 16) + 1) / float(1 << 52)

    def squared(p, c):
        return sum((a - b) ** 2 for a, b in zip(p, c, strict=True))

    best = None
    for start in range(starts):
        centres = []
        for step in range(k):
            races = []
            for name, p in rows:
                d = min((squared(p, c) for c in centres), default=1)
                if d:
                    races.append((-math.log(u(name, start, step)) / d, name, p))
            centres.append(min(races)[2] if races else centres[0])
        while True:
            groups, cost = [[] for _ in centres], 0
            for _, p in rows:
                d = [squared(p, c) for c in centres]
                cost += min(d)
                groups[d.index(min(d))].append(p)
            moved = [tuple((2 * sum(v) + len(g)) // (2 * len(g)) for v in zip(*g, strict=True)) if g else c for g, c in zip(groups, centres, strict=True)]
            way = sum(squared(a, b) for a, b in zip(moved, centres, strict=True))
            centres = moved
            if way <= kmeans.REST:
                break
        if best is None or cost < best[0]:
            best = (cost, sorted(centres))
    return best[1]


def test_fit_equals_plain_steps_however_points_are_dealt(spark):
    draw = random.Random(6)
    rows = [(f"c{i:03}", tuple(draw.choice([-9000, 0, 4000]) + draw.randrange(-2500, 2500) for _ in range(2))) for i in range(160)]
    frame = spark.createDataFrame([(n, *p) for n, p in rows], "id string, q0 long, q1 long")
    found = []
    for parts in (1, 7):
        dealt = frame.repartition(parts).cache()
        # The second fit is of a part of the points, as a refit is.
        found.append(kmeans.fit(dealt, "id", [F.lit(True), F.col("id") < "c100"], 4, 3, 11, 2))
        dealt.unpersist()
    assert found[0] == found[1]
    assert found[0][0] == plain_fit(rows, "id", 4, 3, 11)
    assert found[0][1] == plain_fit([r for r in rows if r[0] < "c100"], "id", 4, 3, 11)


def test_cells_lead_to_the_steps_over_all_points(spark, monkeypatch):
    """With fewer cells than points the last steps are taken over all points, down to about the same cost."""
    draw = random.Random(3)
    rows = [(f"c{i:04}", *(draw.choice([-20000, 0, 15000]) + draw.randrange(-3000, 3000) for _ in range(2))) for i in range(900)]
    frame = spark.createDataFrame(rows, "id string, q0 long, q1 long").cache()
    exact = kmeans.fit(frame, "id", [F.lit(True)], 5, 4, 2, 2)[0]
    monkeypatch.setattr(kmeans, "CELLS", 150)
    found = kmeans.fit(frame, "id", [F.lit(True)], 5, 4, 2, 2)[0]

    def cost(centres):
        return sum(min((r[1] - a) ** 2 + (r[2] - b) ** 2 for a, b in centres) for r in rows)

    assert cost(found) <= 1.02 * cost(exact)


def test_fewer_points_than_centres(spark):
    frame = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9)], "id string, q0 long")
    centres = kmeans.fit(frame, "id", [F.lit(True)], 3, 2, 1, 1)[0]
    assert {r["c"] for r in frame.select(kmeans.label(centres).alias("c")).collect()} <= {0, 1, 2}
    assert set(centres) == {(5,), (9,)}
