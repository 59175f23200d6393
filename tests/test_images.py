"""Operators on images against plain NumPy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.model import BITS, KEY
from voxloom.operators import components as cc
from voxloom.operators import grow, holes, morphology, seeds
from voxloom.sources import tiff


def table(spark, image, column="v"):
    rows = [(0, *map(int, at), int(image[at])) for at in np.ndindex(image.shape)]
    return spark.createDataFrame(rows, f"img_id int, z int, y int, x int, {column} int")


def volume(df, shape, column):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def flood(mask, connectivity):
    """Least cell number of each component."""
    out = np.full(mask.shape, -1)
    for start in zip(*np.nonzero(mask)):
        if out[start] >= 0:
            continue
        number = (((int(start[0]) << BITS) + int(start[1])) << BITS) + int(start[2])
        out[start], todo = number, [start]
        while todo:
            at = todo.pop()
            for d in cc.offsets(connectivity):
                near = tuple(a + b for a, b in zip(at, d))
                if all(0 <= a < n for a, n in zip(near, mask.shape)) and mask[near] and out[near] < 0:
                    out[near] = number
                    todo.append(near)
    return out


@pytest.mark.parametrize("connectivity, tile", [(1, 64), (2, 3), (3, 2)])
def test_components(spark, connectivity, tile):
    mask = np.random.default_rng(connectivity).random((5, 7, 8)) < 0.35
    got = cc.components(table(spark, mask.astype(int)).where("v = 1"), connectivity, tile=tile)
    want = flood(mask, connectivity)
    found = {(r.z, r.y, r.x): r.root for r in got.collect()}
    assert found == {tuple(map(int, at)): int(want[at]) for at in zip(*np.nonzero(mask))}


def test_components_of_nothing_and_of_one(spark):
    empty = table(spark, np.zeros((1, 2, 2), int))
    assert cc.components(empty.where("v = 1")).count() == 0
    assert [r.root for r in cc.components(empty.where("y = 1 and x = 1")).collect()] == [(1 << BITS) + 1]


def shifted(mask, d, fill):
    out = np.full(mask.shape, fill)
    at = np.indices(mask.shape)
    near = tuple(a + b for a, b in zip(at, d))
    ok = np.all([(n >= 0) & (n < s) for n, s in zip(near, mask.shape)], axis=0)
    out[ok] = mask[tuple(n[ok] for n in near)]
    return out


@pytest.mark.parametrize("name", ["ball", "ball_XZ", "Y", "2YZ_1X", "cube"])
def test_erosion_and_dilation(spark, name):
    mask = np.random.default_rng(4).random((4, 6, 6)) < 0.7
    eroded, dilated = mask.copy(), ~mask
    for axes in morphology.FOOTPRINTS[name]:
        steps = [tuple(s if a == b else 0 for b in "zyx") for a in axes for s in (-1, 1)]
        eroded = np.all([eroded, *(shifted(eroded, d, True) for d in steps)], axis=0)
        dilated = np.any([dilated, *(shifted(dilated, d, False) for d in steps)], axis=0)
    df = table(spark, mask.astype(int)).withColumn("on", F.col("v") == 1)
    assert (volume(morphology.erode(df, name), mask.shape, "on") == eroded).all()
    assert (volume(morphology.dilate(df.withColumn("on", ~F.col("on")), name), mask.shape, "on") == dilated).all()
    assert not (eroded & ~mask).any()


def test_distance_is_city_block(spark):
    mask = np.random.default_rng(5).random((3, 6, 7)) < 0.9
    off = np.argwhere(~mask)
    want = {at: min(int(np.abs(off - np.array(at)).sum(1).min()), 10**6) for at in np.ndindex(mask.shape)}
    df = morphology.city_block(table(spark, mask.astype(int)).withColumn("on", F.col("v") == 1))
    assert {(r.z, r.y, r.x): r.distance for r in df.collect()} == want


def test_growth_keeps_labels_and_stays_in_the_threshold(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 10, (3, 8, 8))
    label = np.where(rng.random(v.shape) < 0.05, rng.integers(1, 5, v.shape), 0)
    df = table(spark, v).join(table(spark, label, "label"), KEY)
    now = label.copy()
    for _ in range(3):
        near = np.max([shifted(now, d, 0) for d in cc.offsets(1)], axis=0)
        now = np.where(now > 0, now, np.where(v >= 4, near, 0))
    out, log = grow.grow(df, [4], [3])
    assert (volume(out, v.shape, "label") == now).all()
    assert log[-1][2] == int((now > 0).sum())
    assert (now[label > 0] == label[label > 0]).all() and ((now == label) | (v >= 4)).all()


def test_holes(spark):
    label = np.zeros((1, 7, 7), int)
    label[0, 1:6, 1:6] = 2
    label[0, 2, 2] = 0
    label[0, 4, 4] = 1
    label[0, 0, 6] = 1
    got = volume(holes.fill_holes(table(spark, label, "label")), label.shape, "label")
    want = label.copy()
    want[0, 2, 2] = want[0, 4, 4] = 2
    assert (got == want).all()


def test_adaptive_splits_what_erosion_parts(spark):
    v = np.zeros((1, 5, 13), int)
    v[0, 0:5, 0:5] = v[0, 0:5, 8:13] = 9
    v[0, 2, 5:8] = 9  # a bridge one cell wide
    out, lineage = seeds.adaptive(table(spark, v), 5, 1)
    sizes = sorted(r["count"] for r in out.groupBy("label").count().collect())
    steps = lineage.collect()
    assert len(sizes) == 2 and {r.parent for r in steps} == {1} and sorted(r.child for r in steps) == [2, 3]
    assert {(r.root, r.leaf) for r in seeds.descendants(lineage, 1).collect()} == {(1, 2), (1, 3)}


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32"])
def test_tiff_round_trip(spark, tmp_path, dtype):
    image = (np.random.default_rng(1).random((3, 4, 5)) * 200).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff.encode(image))
    (tmp_path / "b.tif").write_bytes(b"no image")
    assert (np.stack(list(tiff.pages(tiff.encode(image)))) == image).all()
    rows = tiff.read(spark, str(tmp_path)).collect()
    good = [r for r in rows if r.error is None]
    assert len(good) == image.size and all(r.v == float(image[r.z, r.y, r.x]) for r in good)
    assert [r.path.endswith("b.tif") for r in rows if r.error] == [True]


def test_components_dont_depend_on_partitions(spark):
    mask = np.random.default_rng(9).random((3, 9, 9)) < 0.4
    df = table(spark, mask.astype(int)).where("v = 1")
    a, b = (sorted(map(tuple, cc.components(df.repartition(n), 3, tile=4).collect())) for n in (1, 7))
    assert a == b
    assert sum(r["size"] for r in cc.sizes(cc.components(df)).collect()) == mask.sum()


def test_offsets():
    assert [len(cc.offsets(k)) for k in (1, 2, 3)] == [6, 18, 26]
    assert len(set(itertools.chain(cc.offsets(3)))) == 26


def test_distances_and_hulls(spark):
    from voxloom.operators import distance

    mask = np.random.default_rng(11).random((3, 6, 7)) < 0.85
    off = np.argwhere(~mask)
    want = {at: int(((off - np.array(at)) ** 2).sum(1).min()) for at in np.ndindex(mask.shape)}
    df = table(spark, mask.astype(int)).withColumn("on", F.col("v") == 1)
    assert {(r.z, r.y, r.x): r.d for r in distance.squared_distance(df).collect()} == want
    label = np.zeros((1, 6, 6), int)
    label[0, 1:5, 1:4] = 1  # 3 x 2 between centres
    label[0, 0, :] = 2  # flat
    assert {r.label: r.area2 for r in distance.hulls(table(spark, label, "label")).collect()} == {1: 12, 2: 0}


def test_descending_thresholds_stay_connected(spark):
    v = np.array([[[9, 9, 5, 0, 5, 9, 5, 0, 5]]])
    got = volume(seeds.descent(table(spark, v), 8, 4, 1, 2), v.shape, "label")
    assert got.tolist() == [[[1, 1, 1, 0, 2, 2, 2, 0, 0]]]


def test_adaptive_by_threshold(spark):
    v = np.array([[[9, 9, 5, 9, 9, 0, 6, 6]]])
    out, lineage = seeds.adaptive_by_threshold(table(spark, v), [4, 8])
    sizes = sorted(r["count"] for r in out.groupBy("label").count().collect())
    assert sizes == [2, 2, 2] and lineage.count() == 2


def test_adaptive_seeds_with_a_list_of_segments(spark):
    v = np.zeros((1, 7, 20), int)
    v[0, 1:6, 1:6] = v[0, 1:6, 9:14] = 9  # two blocks and a bridge of one cell
    v[0, 3, 6:9] = 9
    v[0, 3, 16] = 9  # a crumb
    cells = table(spark, v)
    split, lineage = seeds.adaptive(cells, 5, 1)
    assert len(np.unique(volume(split, v.shape, "label"))) == 4 and lineage.count() == 2
    one, none = seeds.adaptive(cells, 5, 1, top=[1, 1])  # a single child doesn't split its parent
    assert len(np.unique(volume(one, v.shape, "label"))) == 2 and none.count() == 0
    large, _ = seeds.adaptive(cells, 5, 1, top=[9, 2], min_size=2)
    assert len(np.unique(volume(large, v.shape, "label"))) == 3
    kept, none = seeds.adaptive(cells, 5, 1, size_limit=(None, 10))
    assert none.count() == 0
    assert len(np.unique(volume(seeds.adaptive_by_threshold(cells, [5, 8], 1, top=[3, 3], patience=1)[0], v.shape, "label"))) == 3
