"""Growth by tiles, hulls of volumes, and k-means points against plain versions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import distance, grow, prompts, seeds, tiles


def table(spark, arrays):
    """Dense tables of images, given as dicts of arrays."""
    parts = []
    for i, columns in enumerate(arrays):
        at = np.indices(next(iter(columns.values())).shape).reshape(3, -1)
        parts.append(pd.DataFrame({"img_id": i, "z": at[0], "y": at[1], "x": at[2]} | {k: v.ravel() for k, v in columns.items()}).astype("int32"))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def dense(df, shapes, column="label"):
    out = [np.zeros(s, int) for s in shapes]
    for r in df.select("img_id", "z", "y", "x", column).collect():
        out[r[0]][r[1], r[2], r[3]] = r[4]
    return out


def hop(label, passes, rule, ids):
    new = label.copy()
    for at in np.argwhere((label == 0) & passes):
        near = [label[tuple(at + d)] for d in (*np.eye(3, dtype=int), *-np.eye(3, dtype=int)) if (at + d >= 0).all() and (at + d < label.shape).all()]
        near = [n for n in near if n > 0 and (ids is None or n in ids)]
        if near:
            new[tuple(at)] = max(near) if rule == "max" else min(near)
    return new


@pytest.fixture(scope="module")
def images():
    draw = np.random.default_rng(1)
    out = []
    for shape in ((7, 9, 13), (1, 11, 6), (4, 4, 4)):
        v = draw.integers(0, 100, shape)
        label = np.where(draw.random(shape) < 0.03, draw.integers(1, 5, shape), 0)
        out.append({"v": v, "label": label})
    return out


@pytest.mark.parametrize("rule, ids, size, hops", [("max", None, 4, 3), ("min", [1, 3], 5, 5), ("max", None, 32, 8)])
def test_growth_by_tiles(spark, images, rule, ids, size, hops):
    cells = table(spark, images)
    got, log = grow.grow(cells, [60, 30], [4, 7], rule, ids=ids, boundary=F.col("x") == 3, hops=hops, tile=size, still=50)
    want, counts = [], {}
    for image in images:
        label, k = image["label"], 0
        for low, steps in ((60, 4), (30, 7)):
            passes = (image["v"] >= low) & (np.arange(label.shape[2]) != 3)
            for step in range(steps):
                label = hop(label, passes, rule, ids)
                counts[low, step + 1] = counts.get((low, step + 1), np.zeros(2, int)) + [(label > 0).sum(), ((label > 0) | passes).sum()]
        want.append(label)
    for a, b in zip(dense(got, [i["v"].shape for i in images]), want):
        assert (a == b).all()
    assert log == [(*k, *map(int, v)) for k, v in counts.items()]


def test_to_the_end_and_saves(spark, images):
    cells, saved = table(spark, images), {}
    got, log = grow.grow(cells, [50], hops=2, tile=4)
    want = []
    for image in images:
        label, before = image["label"], None
        while before is None or (label != before).any():
            before, label = label, hop(label, image["v"] >= 50, "max", None)
        want.append(label)
    for a, b in zip(dense(got, [i["v"].shape for i in images]), want):
        assert (a == b).all()
    grow.grow(cells, [50, 20], [3, 2], every=[2, 1], save=lambda low, k, df: saved.setdefault((low, k), df.where("label > 0").count()), tile=4)
    assert list(saved) == [(50, 2), (50, 3), (20, 1), (20, 2)]
    assert list(saved.values()) == sorted(saved.values())


def test_early_end_within_a_round(spark):
    v = np.full((1, 1, 30), 9)
    label = np.zeros_like(v)
    label[0, 0, 0] = 1
    label[0, 0, 3] = 2
    got, log = grow.grow(table(spark, [{"v": v, "label": label}]), [5], [20], still=1, least=2, hops=8)
    # Two cells are gained at first, from the third hop on one: fewer than two, and it ends there.
    assert log[-1][1] < 8 and dense(got, [v.shape])[0].astype(bool).sum() == log[-1][2]


def test_nothing_to_grow(spark, images):
    empty = table(spark, [{"v": images[2]["v"], "label": np.zeros((4, 4, 4), int)}])
    got, log = grow.grow(empty, [0], [9])
    assert got.where("label > 0").count() == 0 and log[-1] == (0, 9, 0, 64)
    assert grow.grow(empty.limit(0), [0], [2])[0].count() == 0


def test_tiles_round_trip(spark, images):
    cells = table(spark, images)
    back = tiles.untiled(tiles.tiled(cells, ["v", "label"], 4), ["v", "label"], 4)
    assert back.exceptAll(cells).count() == 0 and cells.exceptAll(back).count() == 0


def inside(points, p):
    """By planes through all triples of points: p isn't beyond any that has all points on one side."""
    for a, b, c in itertools.combinations(points, 3):
        n = np.cross(b - a, c - a)
        if n.any():
            side = (points - a) @ n
            if (side <= 0).all() and (p - a) @ n > 0 or (side >= 0).all() and (p - a) @ n < 0:
                return False
    return True


@pytest.mark.parametrize("seed", range(5))
def test_hull_by_half_spaces(seed):
    draw = np.random.default_rng(seed)
    points = np.unique(draw.integers(0, 4 + seed, (11, 3)), axis=0)
    faces = distance.hull(points)
    for f in faces:
        a, b, c = points[f]
        assert ((points - a) @ np.cross(b - a, c - a) <= 0).all()
    for p in draw.integers(-1, 5 + seed, (40, 3)):
        within = all((p - points[f[0]]) @ np.cross(points[f[1]] - points[f[0]], points[f[2]] - points[f[0]]) <= 0 for f in faces)
        assert within == inside(points, p)


def test_hull_volumes(spark, monkeypatch):
    draw = np.random.default_rng(4)
    label = np.zeros((9, 8, 7), int)
    label[1:5, 1:5, 1:5] = 1  # centres span a cube of 3
    label[6:8, 0, :] = 2  # flat
    label[8, 7, 6] = 3
    loose = draw.random(label.shape) < 0.05
    label[loose & (label == 0)] = 4
    cells = table(spark, [{"label": label}])
    whole = {r.label: r.volume6 for r in distance.hull_volumes(cells).collect()}
    assert whole[1] == 6 * 27 and whole[2] == 0 and whole[3] == 0
    points = np.argwhere(label == 4)
    faces = distance.hull(points)
    a, b, c = (points[faces[:, k]] for k in range(3))
    assert whole[4] == int((a * np.cross(b, c)).sum())
    monkeypatch.setattr(distance, "SLAB", 2)
    monkeypatch.setattr(distance, "MERGED", 2)
    assert {r.label: r.volume6 for r in distance.hull_volumes(cells).collect()} == whole


def test_hull_limit(spark):
    label = np.zeros((3, 9, 20), int)
    label[:, 1:8, 1:8] = label[:, 1:8, 12:19] = 1
    label[1, 4, 8:12] = 1  # a bridge, which an erosion cuts
    cells = table(spark, [{"v": label}])
    split = lambda **k: seeds.adaptive(cells, 1, 1, **k)[0].select("label").distinct().count()
    volume = distance.hull_volumes(cells.withColumn("label", F.col("v"))).first().volume6 // 6
    assert split() == 2 and split(hull_limit=(volume, volume)) == 2
    assert split(hull_limit=(volume + 1, None)) == 1 and split(hull_limit=(None, volume - 1)) == 1


def test_kmeans_by_loops(spark):
    draw = np.random.default_rng(2)
    label = np.where(draw.random((3, 12, 12)) < 0.4, draw.integers(1, 4, (3, 12, 12)), 0)
    label[0, 0, :2] = 9  # fewer cells than centres
    cells = table(spark, [{"label": label}]).where("label > 0")
    first = {}
    for r in prompts.drawn(cells, ["label"]).where("k <= 4").orderBy("k").collect():
        first.setdefault(r.label, []).append((r.z * 1024, r.y * 1024, r.x * 1024))
    want = set()
    for k, centres in first.items():
        own = np.argwhere(label == k) * 1024
        for _ in range(6 if len(own) > 4 else 0):
            near = np.array([[((p - c) ** 2).sum() for c in np.array(centres)] for p in own]).argmin(1)
            centres = [tuple(own[near == i].sum(0) // (near == i).sum()) if (near == i).any() else c for i, c in enumerate(centres)]
        want |= {(k, *[int(x + 512) // 1024 for x in c]) for c in centres}
    got = prompts.sample_kmeans(cells, 4, ["label"], 6)
    assert {(r.label, r.z, r.y, r.x) for r in got.collect()} == want
    made = prompts.volume_prompts(table(spark, [{"label": label, "v": label}]), 4, 2, "kmeans", {1: {"method": "random"}}).toPandas()
    assert set(made.query("class_id == 1 and label").sample_method) == {"random"} and set(made.query("class_id == 2 and label").sample_method) == {"kmeans"}
