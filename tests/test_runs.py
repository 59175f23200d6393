"""Runs from parameter files, held against the operators on the same cells."""

import json

import numpy as np
import pytest
import yaml

from voxloom.operators import cells as C
from voxloom.operators import grow, seeds
from voxloom.plans import runs
from voxloom.sources import manifests, stacks, tiff


def blobs():
    z, y, x = np.indices((6, 14, 22))
    far = np.minimum((z - 3) ** 2 + (y - 6) ** 2 + (x - 6) ** 2, (z - 3) ** 2 + (y - 7) ** 2 + (x - 14) ** 2)
    return np.clip(250 - 9 * far, 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    wall = np.zeros((6, 14, 22), np.uint8)
    wall[:, 7, :] = 1
    (folder / "img.tif").write_bytes(tiff.encode(list(blobs())))
    (folder / "wall.tif").write_bytes(tiff.encode(list(wall)))
    return folder


def read(path):
    return np.stack(list(tiff.pages(path.read_bytes())))


def of(df, shape=(6, 14, 22)):
    out = np.zeros(shape, int)
    for r in df.where("label > 0").collect():
        out[r.z, r.y, r.x] = r.label
    return out


def rows(folder):
    return [json.loads(x) for p in sorted(folder.glob("log/*.json")) for x in p.read_text().splitlines()]


def test_seeds_adaptive_and_growth(spark, place):
    shared = {"img_path": "img.tif", "workspace": str(place), "output_folder": "out"}
    (place / "s.yaml").write_text(yaml.safe_dump({**shared, "thresholds": [120, 200], "erosion_steps": 1, "segments": 5, "footprints": ["ball", "X"], "num_threads": 2}))
    folder = runs.run(spark, "seeds", str(place / "s.yaml"))
    out = place / "out" / "img"
    assert folder == str(out) and sorted(p.name for p in out.glob("*.tif")) == [f"img_seed_{a}_None_{f}.tif" for a in (120, 200) for f in ("X", "ball")]
    cells = stacks.read_stack(spark, str(place / "img.tif")).selectExpr("img_id", "z", "y", "x", "cast(v as int) v")
    assert (read(out / "img_seed_200_None_ball.tif") == of(seeds.seeds(cells, 200, None, 1, 5))).all()
    assert {(r["low"], r["footprint"]) for r in rows(out)} == {(a, f) for a in (120, 200) for f in ("ball", "X")}

    (place / "a.yaml").write_text(yaml.safe_dump({**shared, "output_folder": "adapt", "thresholds": 100, "erosion_steps": 2, "segments": 9, "boundary_path": "wall.tif", "split_convex_hull_limit": [1, None]}))
    runs.run(spark, "adaptive", str(place / "a.yaml"))
    want, _ = seeds.adaptive(cells, 100, 2, 9, boundary=cells["y"] == 7, hull_limit=(1, None))
    assert (read(place / "adapt/img/img_FINAL_adaptive_seed.tif") == of(C.reorder(want, 1))).all()

    given = {**shared, "output_folder": "grown", "seg_path": "out/img/img_seed_200_None_ball.tif", "thresholds": [150, 60], "dilation_steps": [3, 4], "touch_rule": "stop", "save_every_n_iters": 2, "min_growth_size": 0}
    (place / "g.json").write_text(json.dumps(given))
    runs.run(spark, "grow", str(place / "g.json"))
    own = cells.join(stacks.read_stack(spark, str(out / "img_seed_200_None_ball.tif")).selectExpr("img_id", "z", "y", "x", "cast(v as int) label"), ["img_id", "z", "y", "x"])
    assert (read(place / "grown/img/FINAL_img.tif") == of(grow.grow(own, [150, 60], [3, 4])[0])).all()
    assert len(list((place / "grown/img").glob("INTER_*.tif"))) == len(rows(place / "grown/img")) == 3  # the last threshold is full after two hops

    manifest = spark.createDataFrame([("img.tif", 100), ("none.tif", 100)], "img_path string, thresholds int")
    got = {r.img_path: r for r in runs.run_manifest(spark, "adaptive", manifest, {"workspace": str(place), "output_folder": "many", "erosion_steps": 1, "segments": 3}).collect()}
    assert got["img.tif"].error is None and "FileNotFound" in got["none.tif"].error
    assert (place / "many/img/img_FINAL_adaptive_seed.tif").exists()


def test_faults_are_named_before_anything_runs(spark, place):
    (place / "bad.yaml").write_text(yaml.safe_dump({"img_path": "img.tif", "workspace": str(place), "output_folder": "bad", "thresholds": [9, 5], "erosion_steps": -1}))
    with pytest.raises(ValueError, match="erosion_steps: out of.*segments: missing"):
        runs.run(spark, "seeds", str(place / "bad.yaml"))
    assert not (place / "bad").exists()
    assert manifests.merged({"a": 1}, {"b": 2}) == {"a": 1, "b": 2}
