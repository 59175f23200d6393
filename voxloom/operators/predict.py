"""An outside model behind prompts: any function of slices and their prompts.

Slices travel as bytes, one row for each class that has prompts there, and a task hands its rows to the model in batches; the model
is made once in a task, where its first batch comes, so weights are loaded as often as there are tasks and not slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (image, points (n, 2) as x y, signs (n,)) -> mask
Predictor = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Prompt:
    """A slice and what is asked of it: points (n, 2) as x y, signs (n,), and the mask to start from, if there is one."""

    image: np.ndarray
    points: np.ndarray
    signs: np.ndarray
    start: np.ndarray | None


#: Answers each prompt of a batch with masks (m, ny, nx), the likeliest first.
Model = Callable[[list[Prompt]], list[np.ndarray]]


def near_values(tolerance: int = 10, radius: int = 4) -> Predictor:
    """A stand-in without a model: cells near a positive point with about its intensity, and nearer to it than to any negative one."""

    def predict(image: np.ndarray, points: np.ndarray, signs: np.ndarray) -> np.ndarray:
        y, x = np.indices(image.shape)
        far = [(x - px) ** 2 + (y - py) ** 2 for px, py in points]
        bad = np.min([d for d, s in zip(far, signs) if s == 0], axis=0) if (signs == 0).any() else np.full(image.shape, 1 << 30)
        mask = np.zeros(image.shape, bool)
        for (px, py), s, d in zip(points, signs, far):
            if s == 1:
                mask |= (d <= radius * radius) & (np.abs(image - image[py, px]) <= tolerance) & (d < bad)
        return mask

    return predict


def of_each(*predictors: Predictor) -> Callable[[], Model]:
    """A model that answers with a mask of each predictor; cells of the mask to start from belong to all of them."""

    def model(prompts: list[Prompt]) -> list[np.ndarray]:
        masks = [np.stack([p(x.image, x.points, x.signs) for p in predictors]) for x in prompts]
        return [m if x.start is None else m | x.start for m, x in zip(masks, prompts)]

    return lambda: model


def _packed(cells: DataFrame, by: list[str], column: str, kind: str) -> DataFrame:
    """`by`, ny, nx and the column's cells of each slice as bytes."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((int(part["y"].max()) + 1, int(part["x"].max()) + 1), kind)
        dense[part["y"], part["x"]] = part[column]
        return pd.DataFrame({**{c: [part[c].iloc[0]] for c in by}, "ny": [dense.shape[0]], "nx": [dense.shape[1]], column: [dense.tobytes()]})

    return cells.select(*by, "y", "x", column).groupBy(*by).applyInPandas(pack, ", ".join(f"{c} int" for c in [*by, "ny", "nx"]) + f", {column} binary")


def infer(cells: DataFrame, points: DataFrame, predictor: Predictor) -> DataFrame:
    """img_id, z, y, x, class_id of the masks that the predictor gives for each class's prompts (img_id, slice, class_id, px, py, sign) of a z slice."""
    return infer_with(cells, points, of_each(predictor)).drop("mask")


def infer_with(cells: DataFrame, points: DataFrame, make: Callable[[], Model], start: DataFrame | None = None, batch: int = 16) -> DataFrame:
    """img_id, z, y, x, class_id, mask: cells of all masks that the model gives for each class's prompts of a z slice; masks count from 0.

    make: gives the model; called once in a task. start: cells (img_id, z, y, x, class_id) of the masks to start from. batch: prompts
    that the model gets at once. Slices without prompts aren't shown to it.
    """
    asked = points.groupBy("img_id", F.col("slice").alias("z"), "class_id").agg(F.sort_array(F.collect_list(F.struct("px", "py", "sign"))).alias("points"))  # a class's prompts of a slice
    rows = _packed(cells, ["img_id", "z"], "v", "int64").join(asked, ["img_id", "z"])
    if start is None:
        rows = rows.withColumn("start", F.lit(None).cast("binary")).withColumns({"sy": F.lit(0), "sx": F.lit(0)})
    else:
        first = _packed(start.select("img_id", "z", "y", "x", "class_id").withColumn("start", F.lit(True)), ["img_id", "z", "class_id"], "start", "bool")
        rows = rows.join(first.withColumnsRenamed({"ny": "sy", "nx": "sx"}), ["img_id", "z", "class_id"], "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            for at in range(0, len(part), batch):
                own, prompts = part.iloc[at : at + batch], []
                for r in own.itertuples(index=False):
                    image = np.frombuffer(r.v, np.int64).reshape(r.ny, r.nx)
                    mask = None
                    if r.start is not None:
                        mask, (sy, sx) = np.zeros(image.shape, bool), (int(r.sy), int(r.sx))
                        mask[:sy, :sx] = np.frombuffer(r.start, bool).reshape(sy, sx)
                    prompts.append(Prompt(image, np.array([[p["px"], p["py"]] for p in r.points]), np.array([p["sign"] for p in r.points]), mask))
                model = model or make()
                for r, masks in zip(own.itertuples(index=False), model(prompts)):
                    m, y, x = np.nonzero(masks)
                    yield pd.DataFrame({"img_id": r.img_id, "z": r.z, "y": y, "x": x, "class_id": r.class_id, "mask": m}).astype("int32")

    return rows.select("img_id", "z", "class_id", "ny", "nx", "v", "points", "start", "sy", "sx").mapInPandas(run, "img_id int, z int, y int, x int, class_id int, mask int")
