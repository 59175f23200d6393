"""Models held by workers, and merged meshes."""

import numpy as np
import pytest

from voxloom.model import KEY
from voxloom.operators import predict, surface


def slices(spark, image):
    return spark.createDataFrame([(0, *map(int, at), int(image[at])) for at in np.ndindex(image.shape)], "img_id int, z int, y int, x int, v int")


def test_a_model_is_made_once_in_a_task(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 30, (40, 6, 7))
    points = spark.createDataFrame([(0, z, c, 2 * c, 3, 1) for z in range(40) if z % 4 for c in (1, 2)], "img_id int, slice int, class_id int, px int, py int, sign int")
    log = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(log, uuid.uuid4().hex), "w").close()

        def model(prompts):
            assert len(prompts) <= 5
            return [np.stack([p.image == p.image[p.points[0][1], p.points[0][0]], p.image < 3, np.zeros(p.image.shape, bool)]) for p in prompts]

        return model

    found = predict.infer_with(slices(spark, image), points, make, batch=5)
    got = {tuple(r) for r in found.collect()}
    want = set()
    for z in range(40):
        for c in (1, 2) if z % 4 else ():
            for m, mask in enumerate((image[z] == image[z, 3, 2 * c], image[z] < 3)):
                want |= {(0, z, int(y), int(x), c, m) for y, x in np.argwhere(mask)}
    assert got == want
    assert 1 <= len(list(tmp_path.iterdir())) <= found.rdd.getNumPartitions()


def test_a_mask_to_start_from(spark):
    image = np.zeros((2, 5, 5), int)
    image[0, 2, 2] = 9
    points = spark.createDataFrame([(0, 0, 1, 2, 2, 1), (0, 1, 1, 0, 0, 1)], "img_id int, slice int, class_id int, px int, py int, sign int")
    start = spark.createDataFrame([(0, 0, 4, 1, 1), (0, 1, 3, 3, 2)], "img_id int, z int, y int, x int, class_id int")
    got = predict.infer_with(slices(spark, image), points, predict.of_each(predict.near_values(1, 0)), start)
    assert {tuple(r) for r in got.collect()} == {(0, 0, 2, 2, 1, 0), (0, 0, 4, 1, 1, 0), (0, 1, 0, 0, 1, 0)}  # class 2 has no prompt there
    assert predict.infer_with(slices(spark, image), points.limit(0), predict.of_each(predict.near_values())).count() == 0


@pytest.mark.parametrize("slab", [64, 3])
def test_merged_ply(spark, tmp_path, monkeypatch, slab):
    monkeypatch.setattr(surface, "SLAB", slab)
    label = np.zeros((5, 6, 7), int)
    label[1:3, 1:4, 2:5] = 1
    label[3:5, 2, 2] = 2
    cells = spark.createDataFrame([(k, *map(int, at), int(label[at])) for k in (0, 1) for at in np.ndindex(label.shape)], "img_id int, z int, y int, x int, label int")
    faces = surface.faces(cells.select(*KEY, "label"))
    surface.write_lines(surface.merged_ply(faces, 1), str(tmp_path / "mesh"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "mesh").glob("part-*"))).splitlines()
    n = next(int(x.split()[-1]) for x in lines if x.startswith("element vertex"))
    at = lines.index("end_header") + 1
    points = [tuple(map(float, x.split())) for x in lines[at : at + n]]
    squares = [list(map(int, x.split()[1:])) for x in lines[at + n :]]
    want = sorted((r.label, *sorted(zip(r.x2, r.y2, r.z2))) for r in faces.where("img_id = 1").collect())
    assert len(squares) == len(want) == next(int(x.split()[-1]) for x in lines if x.startswith("element face"))
    assert sorted(sorted(tuple(2 * c for c in points[k]) for k in s) for s in squares) == sorted(sorted(map(tuple, w[1:])) for w in want)
    edges = {}
    for s in squares:
        for a, b in zip(s, s[1:] + s[:1]):
            edges[frozenset((a, b))] = edges.get(frozenset((a, b)), 0) + 1
    assert set(edges.values()) == {2} and n - len(edges) + len(squares) == 4  # two closed surfaces
