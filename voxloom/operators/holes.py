"""Holes: parts of the background that don't reach an image's border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AXES, KEY, matched
from .components import TILE, components

ROOT = ["img_id", "value", "root"]
#: What lies in one tile of a component: at most TILE ** 3 cells, however large the component is.
PIECE = [*ROOT, "tz", "ty", "tx"]


def _cut(parts: DataFrame) -> DataFrame:
    return parts.withColumns({f"t{a}": F.expr(f"{a} div {TILE}") for a in AXES})


def _of_roots(parts: DataFrame, pieces: DataFrame, roots: DataFrame) -> DataFrame:
    """Cells of the given components; both sides by pieces, so that a large component is dealt over tasks."""
    return matched(parts, pieces.select(*PIECE).join(roots.select(*ROOT).hint("merge"), ROOT), PIECE, "left_semi")


def fill_holes(cells: DataFrame) -> DataFrame:
    """label where holes of each label's complement (by faces) belong to the label; of several labels the highest takes a cell.

    A hole lies inside its label's box and doesn't reach the box's faces, so only the cells of the boxes are looked at. In
    an image of one slice only the sides count.
    """
    box = cells.where("label > 0").groupBy("img_id", F.col("label").alias("of")).agg(*[f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("low", F.min), ("high", F.max))])
    inside = box
    for a in AXES:
        inside = inside.withColumn(a, F.explode(F.sequence(f"{a}_low", f"{a}_high")))
    rest = matched(inside.select("img_id", "of", *AXES), cells.select(*KEY, "label"), KEY).where("label <> of")
    parts = _cut(components(rest, 1, F.col("of")))
    reach = lambda again: [f(f"{a}_{n}" if again else a).alias(f"{a}_{n}") for a in AXES for n, f in (("first", F.min), ("last", F.max))]
    pieces = parts.groupBy(*PIECE).agg(*reach(False))
    whole = pieces.groupBy(*ROOT).agg(*reach(True))
    deep = cells.groupBy("img_id").agg((F.max("z") > F.min("z")).alias("deep"))
    ends = whole.join(box.withColumn("value", F.col("of").cast("long")).drop("of").hint("merge"), ["img_id", "value"]).join(deep, "img_id")
    faces = [(F.col(f"{a}_first") == F.col(f"{a}_low")) | (F.col(f"{a}_last") == F.col(f"{a}_high")) for a in AXES]
    closed = ends.where(~((F.col("deep") & faces[0]) | faces[1] | faces[2]))
    holes = _of_roots(parts, pieces, closed).groupBy(*KEY).agg(F.max("value").cast("int").alias("hole"))
    return matched(cells, holes, KEY, "left").select(*KEY, F.greatest("label", F.coalesce("hole", F.lit(0))).alias("label"))


def fill_small_holes(cells: DataFrame, area: int, axis: str | None = None) -> DataFrame:
    """Components (by faces) of the complement of each label with fewer cells than `area` and than a quarter of the image become the label; the highest label wins.

    axis: each slice across it counts as an image. A part of fewer than `area` cells beside a label lies within `area` cells of its box, and
    one that reaches further has more, so only the cells of the boxes and that far around are looked at.
    """
    own = cells.where("label > 0")
    group = ["img_id", *([axis] if axis else [])]
    free = [a for a in AXES if a != axis]
    box = own.groupBy(*group, F.col("label").alias("of")).agg(*[f(a).alias(f"{a}_{n}") for a in free for n, f in (("low", F.min), ("high", F.max))])
    ends = cells.groupBy(*group).agg(F.count("*").alias("cells"), *[F.max(a).alias(f"{a}_end") for a in free])
    inside = box.join(ends, group)
    for a in free:
        inside = inside.withColumn(a, F.explode(F.sequence(F.greatest(F.col(f"{a}_low") - area, F.lit(0)), F.least(F.col(f"{a}_high") + area, F.col(f"{a}_end")))))
    rest = matched(inside.select("img_id", "of", *AXES), cells.select(*KEY, "label"), KEY).where("label <> of")
    n = 1 << 20
    kind = F.col("of").cast("long") * n + F.col(axis) if axis else F.col("of").cast("long")  # slices apart
    parts = _cut(components(rest, 1, kind))
    pieces = parts.groupBy(*PIECE).agg(F.count("*").alias("n"))
    whole = pieces.groupBy(*ROOT).agg(F.sum("n").alias("n"))
    whole = whole.withColumn(axis, F.expr(f"cast(value % {n} as int)")) if axis else whole
    size = whole.join(ends.select(*group, "cells").hint("merge"), group).where(f"n < {area} and 4 * n < cells")
    of = F.expr(f"cast(value div {n} as int)") if axis else F.col("value").cast("int")
    small = _of_roots(parts, pieces, size).groupBy(*KEY).agg(F.max(of).alias("hole"))
    return matched(cells, small, KEY, "left").select(*KEY, F.coalesce("hole", "label").alias("label"))
