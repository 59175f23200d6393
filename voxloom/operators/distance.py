"""Euclidean distances and hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AXES, KEY

_FAR = 1 << 40


def squared_distance(cells: DataFrame, column: str = "on") -> DataFrame:
    """Squared Euclidean distance of each cell to the nearest where column is false; very large where an image has none.

    One axis after another: along a line, the least of the others' distance so far plus the squared step. A line is an array,
    so a task holds lines, not images.
    """
    rows = cells.select(*KEY, F.when(F.col(column), F.lit(_FAR)).otherwise(F.lit(0)).cast("long").alias("d"))
    for axis in AXES:
        others = [a for a in AXES if a != axis]
        lines = rows.groupBy("img_id", *others).agg(F.sort_array(F.collect_list(F.struct(F.col(axis).cast("long").alias("at"), F.col("d")))).alias("line"))
        best = F.transform("line", lambda p: F.struct(p["at"].alias("at"), F.array_min(F.transform("line", lambda q: q["d"] + (q["at"] - p["at"]) * (q["at"] - p["at"]))).alias("d")))
        rows = lines.select("img_id", *others, F.explode(best).alias("p")).select("img_id", *others, F.col("p.at").cast("int").alias(axis), "p.d")
    return rows.select(*KEY, F.least("d", F.lit(_FAR)).alias("d"))


def centres(cells: DataFrame) -> DataFrame:
    """The deepest cell of each image's foreground (`on`), the first in raster order of equals, and its squared depth."""
    far = squared_distance(cells).where("d > 0")
    return far.groupBy("img_id").agg(F.max_by(F.struct("z", "y", "x"), F.struct("d", -F.col("z"), -F.col("y"), -F.col("x"))).alias("c"), F.max("d").alias("d")).select("img_id", "c.*", "d")


def hulls(cells: DataFrame) -> DataFrame:
    """img_id, label, z, twice the area of the convex hull of each label's cell centres in each slice; 0 for fewer than 3 or flat ones.

    Only the ends of each row go into a hull, so what one task holds grows with a label's height, not its area.
    """
    ends = cells.where("label > 0").groupBy("img_id", "label", "z", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))

    def hull(part: pd.DataFrame) -> pd.DataFrame:
        points = sorted({(int(x), int(y)) for y, a, b in zip(part["y"], part["x0"], part["x1"]) for x in (a, b)})

        def chain(seq):
            out: list[tuple[int, int]] = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out[:-1]

        ring = chain(points) + chain(points[::-1]) if len(points) > 2 else []
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1])))
        return pd.DataFrame({"img_id": [part["img_id"].iloc[0]], "label": [part["label"].iloc[0]], "z": [part["z"].iloc[0]], "area2": [area]})

    return ends.groupBy("img_id", "label", "z").applyInPandas(hull, "img_id int, label int, z int, area2 long")


#: Cells along z of a first group of a label's points, and groups that are merged into one.
SLAB = 32
MERGED = 8


def hull(points: np.ndarray) -> np.ndarray | None:
    """Faces (n, 3) of the convex hull of points (n, 3) of whole numbers, as places in points, outer sides alike; None for flat ones.

    Points are added one by one: the faces that see a new point go, and it is joined with the edges around them. Sides are told
    by whole numbers, so points in a face's plane don't see it.
    """
    p = points.astype(np.int64)
    line_ = np.cross(p - p[0], p[np.abs(p - p[0]).sum(1).argmax()] - p[0])
    if len(p) < 4 or not line_.any():
        return None
    b, c = int(np.abs(p - p[0]).sum(1).argmax()), int(np.abs(line_).sum(1).argmax())
    plane = (p - p[0]) @ np.cross(p[b] - p[0], p[c] - p[0])
    if not plane.any():
        return None
    d = int(np.abs(plane).argmax())
    faces = np.array([(0, b, c), (0, c, d), (0, d, b), (b, d, c)])
    if plane[d] > 0:
        faces = faces[:, ::-1]
    for i in range(len(p)):
        one = p[faces[:, 0]]
        sees = ((p[i] - one) * np.cross(p[faces[:, 1]] - one, p[faces[:, 2]] - one)).sum(1) > 0
        if sees.any():
            own = faces[sees]
            edges = {(a, b) for f in own.tolist() for a, b in zip(f, f[1:] + f[:1])}
            faces = np.concatenate([faces[~sees], [(a, b, i) for a, b in edges if (b, a) not in edges]])
    return faces


def hull_volumes(cells: DataFrame) -> DataFrame:
    """img_id, label, volume6: six times the volume of the convex hull of each label's cell centres, 0 for fewer than four and flat ones.

    Only the ends of each row go in. Slabs along z are reduced to the corners of their own hulls, and these are merged a few
    at a time until one group a label is left, so no task gets more than a few groups' corners.
    """
    ends = cells.where("label > 0").groupBy("img_id", "label", "z", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    at = ends.select("img_id", "label", F.expr(f"z div {SLAB}").alias("slab"), "z", "y", F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"))
    most = at.agg(F.max("slab")).first()[0] or 0

    def corners(part: pd.DataFrame) -> pd.DataFrame:
        faces = hull(part[["z", "y", "x"]].to_numpy())
        return part if faces is None else part.iloc[np.unique(faces)]

    while most > 0:
        at = at.groupBy("img_id", "label", "slab").applyInPandas(corners, at.schema).withColumn("slab", F.expr(f"slab div {MERGED}"))
        most //= MERGED

    def volume(part: pd.DataFrame) -> pd.DataFrame:
        points = part[["z", "y", "x"]].to_numpy().astype(np.int64)
        faces, six = hull(points), 0
        if faces is not None:
            a, b, c = (points[faces[:, k]] - points[0] for k in range(3))
            six = int((a * np.cross(b, c)).sum())
        return pd.DataFrame({"img_id": [part["img_id"].iloc[0]], "label": [part["label"].iloc[0]], "volume6": [abs(six)]})

    return at.groupBy("img_id", "label").applyInPandas(volume, "img_id int, label int, volume6 long")
