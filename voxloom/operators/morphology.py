"""Morphology on dense tables by windows along axes.

A unit ball is the union of unit segments along the axes, so an erosion is the AND of three one-dimensional minima and a
dilation the OR of three maxima; k erosions by the ball are one comparison with the city-block distance to the background.
Beyond an image's ends cells count as foreground for erosion and as background for dilation, which is what frames give.
No joins; one shuffle an axis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, KEY, line

#: Axes of each step of a footprint, by name. `cube` and `square` of size 1 are single cells: no step.
FOOTPRINTS = {
    "ball": ["zyx"],
    "disk": ["zyx"],
    "ball_XY": ["yx"],
    "ball_XZ": ["zx"],
    "ball_YZ": ["zy"],
    "X": ["x"],
    "Y": ["y"],
    "Z": ["z"],
    "2XZ_1Y": ["zx", "zx", "y"],
    "2XY_1Z": ["yx", "yx", "z"],
    "2YZ_1X": ["zy", "zy", "x"],
    "cube": [],
    "square": [],
}
#: Axes of footprints that are boxes of `size` cells on each side.
BOXES = {"cube": "zyx", "square": "yx"}
_FAR = 1 << 28


def _spread(cells: DataFrame, axes: str, how, column: str) -> DataFrame:
    hits = [how(column).over(line(a).rowsBetween(-1, 1)) for a in axes]
    both = F.least if how is F.min else F.greatest
    return cells.withColumn(column, both(*hits) if len(hits) > 1 else hits[0])


def _box(cells: DataFrame, axes: str, low: int, high: int, how, column: str) -> DataFrame:
    """A box is the sum of segments along its axes: one window an axis, one after another."""
    for a in axes:
        cells = cells.withColumn(column, how(column).over(line(a).rowsBetween(low, high)))
    return cells


def erode(cells: DataFrame, footprint: str = "ball", times: int = 1, column: str = "on", size: int = 1) -> DataFrame:
    """column (boolean) eroded. Whole balls go by one distance transform. size: of a `cube` or `square`; an even one reaches one cell further back."""
    cells = cells.withColumn(column, F.col(column).cast("int"))
    if footprint in BOXES:
        for _ in range(times if size > 1 else 0):
            cells = _box(cells, BOXES[footprint], -(size // 2), size - 1 - size // 2, F.min, column)
    elif footprint in ("ball", "disk") and times > 1:
        cells = city_block(cells, column, "_d").withColumn(column, (F.col("_d") > times).cast("int")).drop("_d")
    else:
        for _ in range(times):
            for axes in FOOTPRINTS[footprint]:
                cells = _spread(cells, axes, F.min, column)
    return cells.withColumn(column, F.col(column) == 1)


def dilate(cells: DataFrame, footprint: str = "ball", times: int = 1, column: str = "on", size: int = 1) -> DataFrame:
    """column (boolean) dilated; size as in erode(), an even box reaches one cell further on."""
    cells = cells.withColumn(column, F.col(column).cast("int"))
    for _ in range(times):
        if footprint in BOXES:
            cells = _box(cells, BOXES[footprint], -(size - 1 - size // 2), size // 2, F.max, column) if size > 1 else cells
            continue
        for axes in FOOTPRINTS[footprint]:
            cells = _spread(cells, axes, F.max, column)
    return cells.withColumn(column, F.col(column) == 1)


def opened(cells: DataFrame, times: int = 1, column: str = "on") -> DataFrame:
    return dilate(erode(cells, "ball", times, column), "ball", times, column)


def closed(cells: DataFrame, times: int = 1, column: str = "on") -> DataFrame:
    return erode(dilate(cells, "ball", times, column), "ball", times, column)


def city_block(cells: DataFrame, column: str = "on", name: str = "distance") -> DataFrame:
    """City-block distance to the nearest cell where column is 0; large where the image has none."""
    cells = cells.withColumn(name, F.when(F.col(column).cast("int") == 1, _FAR).otherwise(0))
    for a in AXES:
        back, on = line(a).rowsBetween(Window.unboundedPreceding, 0), line(a).rowsBetween(0, Window.unboundedFollowing)
        near = F.least(F.col(a) + F.min(F.col(name) - F.col(a)).over(back), F.min(F.col(name) + F.col(a)).over(on) - F.col(a))
        cells = cells.withColumn(name, F.least(name, near).cast("int"))
    return cells


def gap(cells: DataFrame, width: int, closing: int, contact: bool = False) -> DataFrame:
    """Cells between masks `a` and `b`: in both of them dilated `width` times and in the closing of their union, but in neither. contact: or where both reach in one step."""
    cells = cells.select(*KEY, "a", "b", F.col("a").alias("wide_a"), F.col("b").alias("wide_b"), (F.col("a") | F.col("b")).alias("both"), F.col("a").alias("near_a"), F.col("b").alias("near_b"))
    for c in ("wide_a", "wide_b"):
        cells = dilate(cells, "ball", width, c)
    cells = closed(cells, closing, "both")
    hit = F.col("wide_a") & F.col("wide_b") & F.col("both")
    if contact:
        for c in ("near_a", "near_b"):
            cells = dilate(cells, "ball", 1, c)
        hit = hit | (F.col("near_a") & F.col("near_b"))
    return cells.where(hit & ~F.col("a") & ~F.col("b")).select(*KEY)


def dilate_labels(cells: DataFrame, times: int = 1) -> DataFrame:
    """Each label dilated by the ball; where several reach a cell the highest wins, also over a lower label."""
    for _ in range(times):
        cells = _spread(cells, "zyx", F.max, "label")
    return cells


def erode_labels(cells: DataFrame, times: int = 1) -> DataFrame:
    """Each label eroded by the ball: a cell stays if all its neighbours have its label."""
    for _ in range(times):
        ends = [f("label").over(line(a).rowsBetween(-1, 1)) == F.col("label") for a in AXES for f in (F.min, F.max)]
        same = ends[0]
        for e in ends[1:]:
            same = same & e
        cells = cells.withColumn("label", F.when(same, F.col("label")).otherwise(0))
    return cells


def one_label(cells: DataFrame, label: int, how) -> DataFrame:
    """how (of a table with the boolean `on`) applied to one label; the other labels stay on top."""
    cells = how(cells.withColumn("on", F.col("label") == label))
    rest = F.when(F.col("label") == label, 0).otherwise(F.col("label"))
    return cells.withColumn("label", F.when(rest > 0, rest).when(F.col("on"), label).otherwise(0).cast("int")).drop("on")
