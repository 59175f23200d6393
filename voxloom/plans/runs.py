"""From a parameter file to results: seeds, adaptive seeds and growth, each from a stack to stacks, a log and the parameters used."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY
from ..operators import cells as C
from ..operators import grow as G
from ..operators import morphology as M
from ..operators import seeds as S
from ..operators.components import onto, written
from ..sources.files import append_log
from ..sources.stacks import read_stack, write_stack
from . import config

#: Footprints of seeds where none are given, for volumes and for single slices.
VOLUME_FOOTPRINTS = ["ball", "ball_XY", "ball_YZ", "ball_XZ"]
SLICE_FOOTPRINTS = ["disk", "X", "Y"]


def _list(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _path(params: Mapping[str, Any], name: str) -> str | None:
    """A file of the parameters, within the workspace unless it says where it is."""
    return params[name] and os.path.join(params["workspace"] or "", params[name])


def _image(spark: SparkSession, params: Mapping[str, Any], with_seeds: bool = False) -> tuple[DataFrame, Column | None]:
    """The image's cells, with label from seg_path if asked, and a condition for boundary cells if there is a boundary file. Files of other shapes are an error."""
    cells = read_stack(spark, _path(params, "img_path")).withColumn("v", F.col("v").cast("int"))
    n = None
    for name, column in (("seg_path", "label"), ("boundary_path", "_wall")):
        if name == "seg_path" and not with_seeds or not params.get(name):
            continue
        n = cells.count() if n is None else n
        other = read_stack(spark, _path(params, name)).select(*KEY, F.col("v").cast("int").alias(column))
        both = written(cells.join(other, KEY), "image")
        if both.count() != n or other.count() != n:
            raise ValueError(f"{name} has another shape than img_path")
        cells = both
    return cells if n else written(cells, "image"), F.col("_wall") != 0 if params.get("boundary_path") else None


def _folder(spark: SparkSession, params: Mapping[str, Any]) -> tuple[str, str]:
    base = params.get("base_name") or os.path.splitext(os.path.basename(params["img_path"]))[0]
    folder = os.path.join(_path(params, "output_folder"), base)
    os.makedirs(folder, exist_ok=True)
    config.save(spark, os.path.join(folder, "parameters"), params)
    return folder, base


def _save(cells: DataFrame, labels: DataFrame, path: str) -> None:
    """labels on the image's cells as a stack of 8 bits where they fit, else 16."""
    most = labels.agg(F.max("label")).first()[0] or 0
    write_stack(onto(cells, labels.where("label > 0")), path, "label", "uint8" if most <= 255 else "uint16")


def seeds(spark: SparkSession, given: Mapping[str, Any]) -> str:
    """A stack of seeds for every pair of thresholds and every footprint, and a log of sizes after each erosion. Returns the folder."""
    params = config.checked("seeds", given)
    pairs = config.thresholds(_list(params["thresholds"]), params["upper_thresholds"] and _list(params["upper_thresholds"]), rising=True)
    cells, wall = _image(spark, params)
    if wall is not None:
        cells = cells.withColumn("v", F.when(wall, -1).otherwise(F.col("v")))  # below every threshold
    deep = cells.agg(F.max("z")).first()[0] > 0
    names = _list(params["footprints"]) if params["footprints"] else VOLUME_FOOTPRINTS if deep else SLICE_FOOTPRINTS
    if bad := [n for n in names if n not in M.FOOTPRINTS]:
        raise ValueError(f"unknown footprints: {', '.join(bad)}")
    folder, base = _folder(spark, params)

    def one(case: tuple[int, int | None, str]) -> None:
        low, high, name = case
        found = S.seeds(cells, low, high, params["erosion_steps"], params["segments"], name)
        _save(cells, written(found, "seeds"), os.path.join(folder, f"{base}_seed_{low}_{high}_{name}.tif"))

    cases = [(*pair, name) for pair in pairs for name in names]
    with ThreadPoolExecutor(params["num_threads"]) as pool:
        list(pool.map(one, cases))
    if params["erosion_steps"]:
        lows, highs = zip(*pairs)
        log = S.grid(cells, list(lows), names, params["segments"], params["erosion_steps"], list(highs) if any(highs) else None)
        append_log(log, os.path.join(folder, "log"))
    return folder


def adaptive(spark: SparkSession, given: Mapping[str, Any]) -> str:
    """One stack of seeds, split by erosions or by thresholds, and the lineage as a log. Returns the folder."""
    params = config.checked("adaptive", given)
    pairs = config.thresholds(_list(params["thresholds"]), params["upper_thresholds"] and _list(params["upper_thresholds"]), rising=True)
    steps = params["erosion_steps"]
    by_erosion = config.adaptive_mode(params["thresholds"]) == "erosion"
    top = config.segment_list(params["segments"], steps if by_erosion else None, len(pairs), params["init_segments"], params["last_segments"])
    names = config.footprints(params["footprints"], steps, list(M.FOOTPRINTS)) if params["footprints"] else None
    cells, wall = _image(spark, params)
    shared = {
        "top": top[:-1], "share": params["min_split_ratio"], "total": params["min_split_total_ratio"], "patience": params["no_split_max_iter"] or None, "boundary": wall, "footprints": names,
        "size_limit": tuple(params["split_size_limit"]), "hull_limit": tuple(params["split_convex_hull_limit"]),
    }
    lows, highs = (list(x) for x in zip(*pairs))
    if by_erosion:
        found, lineage = S.adaptive(cells, lows[0], steps, high=highs[0], **shared)
    else:
        found, lineage = S.adaptive_by_threshold(cells, lows, steps, highs=highs if any(highs) else None, **shared)
    folder, base = _folder(spark, params)
    found = written(C.reorder(found, params["min_size"], top[-1], params["sort"]), "seeds")
    _save(cells, found, os.path.join(folder, f"{base}_FINAL_adaptive_seed.tif"))
    append_log(lineage, os.path.join(folder, "log"))
    return folder


def grow(spark: SparkSession, given: Mapping[str, Any]) -> str:
    """The grown labels, intermediate stacks as often as asked, and the log of sizes. Returns the folder."""
    params = config.checked("grow", given)
    pairs = config.thresholds(_list(params["thresholds"]), params["upper_thresholds"] and _list(params["upper_thresholds"]), rising=False)
    steps = _list(params["dilation_steps"])
    if not params["grow_to_end"] and len(steps) != len(pairs):
        raise ValueError("as many dilation_steps as thresholds are needed")
    cells, wall = _image(spark, params, with_seeds=True)
    folder, base = _folder(spark, params)
    lows, highs = (list(x) for x in zip(*pairs))
    save, every = None, None
    if params["save_every_n_iters"]:
        every = [params["save_every_n_iters"]] * len(pairs)
        save = lambda low, k, df: _save(cells, df, os.path.join(folder, f"INTER_{base}_{low}_{highs[lows.index(low)]}_{k}.tif"))
    found, log = G.grow(
        cells, lows, None if params["grow_to_end"] else steps, "max" if params["touch_rule"] == "stop" else "overwrite", highs if any(highs) else None,
        params["no_growth_max_iter"], params["min_growth_size"], params["to_grow_ids"], wall, every, save,
    )
    found = written(found, "grown")
    final = _path(params, "final_grow_output_folder") or folder
    os.makedirs(final, exist_ok=True)
    _save(cells, C.reorder(found) if params["is_sort"] else found, os.path.join(final, f"FINAL_{base}.tif"))
    append_log(spark.createDataFrame(log, "threshold int, hop int, grown long, reachable long"), os.path.join(folder, "log"))
    return folder


KINDS: dict[str, Callable[[SparkSession, Mapping[str, Any]], str]] = {"seeds": seeds, "adaptive": adaptive, "grow": grow}


def run(spark: SparkSession, kind: str, path: str) -> str:
    """A run of the kind with the parameters of a YAML or JSON file; every fault of the file is named before anything runs."""
    return KINDS[kind](spark, config.load(spark, path))


def run_manifest(spark: SparkSession, kind: str, rows: DataFrame, shared: Mapping[str, Any], at_once: int = 2) -> DataFrame:
    """A run for each row of a manifest, with the parameters that all share; faults of a row are its result."""
    from ..sources import manifests

    return manifests.run(rows, lambda row: KINDS[kind](spark, manifests.merged(row, shared)), at_once)
