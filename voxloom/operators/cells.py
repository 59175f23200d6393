"""Operators that look at one cell at a time: thresholds, masks, labels set, merged, mapped and moved. No shuffle unless two images meet."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AXES, KEY, dealt, filled, raster


def within(low: float | None = None, high: float | None = None, strict: bool = False, column: str = "v") -> Column:
    """low <= v <= high, either end open; strict: low < v."""
    test = F.lit(True)
    if low is not None:
        test = F.col(column) > low if strict else F.col(column) >= low
    return test if high is None else test & (F.col(column) <= high)


def threshold(cells: DataFrame, low: float | None = None, high: float | None = None, strict: bool = False) -> DataFrame:
    return cells.where(within(low, high, strict))


def without_boundary(cells: DataFrame, boundary: DataFrame, column: str = "label") -> DataFrame:
    """0 where boundary (rows of img_id, z, y, x) has a cell."""
    marks = boundary.select(*KEY).distinct().withColumn("at_boundary", F.lit(True))
    return cells.join(marks, KEY, "left").withColumn(column, F.when(F.col("at_boundary"), 0).otherwise(F.col(column))).drop("at_boundary")


def set_label(cells: DataFrame, sources: Iterable[int], to: int) -> DataFrame:
    return cells.withColumn("label", F.when(F.col("label").isin(*sources), to).otherwise(F.col("label")))


def keep_labels(cells: DataFrame, ids: Iterable[int], keep: bool = True) -> DataFrame:
    chosen = F.col("label").isin(*ids)
    return cells.withColumn("label", F.when(chosen if keep else ~chosen, F.col("label")).otherwise(0))


def map_classes(cells: DataFrame, classes: Mapping[int, str], scheme: list[str]) -> DataFrame:
    """class_id: a label's class by its place in the scheme from 1; 0 for labels without a class. The mapping is a small dictionary by hand."""
    known = {label: scheme.index(name) + 1 for label, name in classes.items() if name in scheme}
    if not known:
        return cells.withColumn("class_id", F.lit(0))
    table = F.create_map(*[F.lit(x).cast("int") for pair in known.items() for x in pair])
    return cells.withColumn("class_id", F.coalesce(F.try_element_at(table, F.col("label")), F.lit(0)))


def clean_image(cells: DataFrame, ids: Iterable[int]) -> DataFrame:
    """Intensity 0 where the label is one of ids."""
    return cells.withColumn("v", F.when(F.col("label").isin(*ids), 0).otherwise(F.col("v")))


def crop(cells: DataFrame, box: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Cells of the half-open box by axis (-1: to the end), moved to begin at 0."""
    for axis, (low, high) in box.items():
        cells = cells.where((F.col(axis) >= low) & (F.lit(high == -1) | (F.col(axis) < high))).withColumn(axis, F.col(axis) - low)
    return cells


def swap_axes(cells: DataFrame, a: str, b: str) -> DataFrame:
    names = {a: b, b: a}
    return cells.select(*[F.col(c).alias(names.get(c, c)) for c in cells.columns])


def block_mean(cells: DataFrame, by: int) -> DataFrame:
    """Mean intensity, rounded down, of blocks of by cells on each axis."""
    return cells.groupBy("img_id", *[F.expr(f"{a} div {by}").cast("int").alias(a) for a in AXES]).agg(F.expr("cast(sum(v) div count(*) as int)").alias("v"))


def stride(cells: DataFrame, step: int, axis: str = "z") -> DataFrame:
    """Every step-th slice, numbered anew."""
    return cells.where(F.col(axis) % step == 0).withColumn(axis, F.expr(f"cast({axis} div {step} as int)"))


def blank_between(cells: DataFrame, step: int, axis: str = "z", column: str = "v") -> DataFrame:
    """0 in all slices but every step-th."""
    return cells.withColumn(column, F.when(F.col(axis) % step == 0, F.col(column)).otherwise(0))


def slices(cells: DataFrame, axis: str, low: int, high: int, column: str = "v") -> DataFrame:
    """2-D slices across an axis in [low, high): slice, row, col and the value; the other axes keep their order."""
    rows = [a for a in AXES if a != axis]
    return cells.where((F.col(axis) >= low) & (F.col(axis) < high)).select("img_id", F.col(axis).alias("slice"), F.col(rows[0]).alias("row"), F.col(rows[1]).alias("col"), column)


#: Six colours for labels 1 to 6, in turn beyond; background is black.
PALETTE = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255)]


def background(cells: DataFrame) -> DataFrame:
    """Cells without a label that have an intensity: where background points may be drawn."""
    return cells.where((F.col("label") == 0) & (F.col("v") > 0))


def narrowed(cells: DataFrame) -> DataFrame:
    """Adds dtype, the integer type that an image's labels are written in: uint8 where it has at most 255 different values (0 too), else uint16."""
    different = cells.groupBy("img_id").agg(F.countDistinct("label").alias("n"))
    kinds = different.select("img_id", F.when(F.col("n") <= 255, "uint8").otherwise("uint16").alias("dtype"))
    return cells.join(kinds, "img_id")


def has_labels(cells: DataFrame, ids: Iterable[int]) -> DataFrame:
    """img_id, label, present: whether an image has each of ids."""
    found = [F.max((F.col("label") == i).cast("int")).alias(f"_{i}") for i in ids]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), (F.col(f"_{i}") == 1).alias("present")) for i in ids]))
    return cells.groupBy("img_id").agg(*found).select("img_id", rows.alias("r")).select("img_id", "r.label", "r.present")


def palette(cells: DataFrame) -> DataFrame:
    at = F.when(F.col("label") > 0, (F.col("label") - 1) % len(PALETTE) + 1).otherwise(0)
    table = F.array(*[F.array(*map(F.lit, c)) for c in [(0, 0, 0), *PALETTE]])
    colour = F.get(table, at)
    return cells.select(*KEY, *[F.get(colour, F.lit(i)).alias(n) for i, n in enumerate(("r", "g", "b"))])


def merge_images(first: DataFrame, second: DataFrame, keep_first: Iterable[int], keep_second: Iterable[int], offset: int) -> DataFrame:
    """Chosen labels of two images in one: the first image's where it has one, else the second's plus offset."""
    a, b = keep_labels(first, keep_first).select(*KEY, F.col("label").alias("a")), keep_labels(second, keep_second).select(*KEY, F.col("label").alias("b"))
    other = F.when(F.col("b") > 0, F.col("b") + offset).otherwise(0)
    return a.join(b, KEY, "full").select(*KEY, F.when(F.coalesce("a", F.lit(0)) > 0, F.col("a")).otherwise(F.coalesce(other, F.lit(0))).cast("int").alias("label"))


def overlaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cells that each pair of labels of two images shares."""
    a, b = first.where("label > 0").select(*KEY, F.col("label").alias("a")), second.where("label > 0").select(*KEY, F.col("label").alias("b"))
    return a.join(b, KEY).groupBy("img_id", "a", "b").agg(F.count("*").alias("size"))


def merged_by_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Labels of the second image that one label of the first touches become the least of them; of several such labels of the first, the largest decides."""
    touched = overlaps(first, second).groupBy("img_id", "a").agg(F.collect_set("b").alias("all"), F.min("b").alias("low")).where(F.size("all") > 1)
    rule = touched.select("img_id", "a", "low", F.explode("all").alias("label")).groupBy("img_id", "label").agg(F.max_by("low", "a").alias("to"))
    return second.join(rule, ["img_id", "label"], "left").select(*KEY, F.coalesce("to", "label").alias("label"))


def normalise_8bit(cells: DataFrame) -> DataFrame:
    """(v - min) / (max - min) * 255 of each image, rounded down; 0 for a constant image."""
    ends = cells.groupBy("img_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    scaled = F.expr("case when high > low then (v - low) * 255 div (high - low) else 0 end")
    return cells.join(ends, "img_id").select(*KEY, scaled.cast("int").alias("v"))


def image_info(cells: DataFrame) -> DataFrame:
    v = F.col("v").cast("double")
    return cells.groupBy("img_id").agg(F.count("*").alias("cells"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"))


def label_info(cells: DataFrame) -> DataFrame:
    return cells.where("label > 0").groupBy("img_id", "label").agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))


def bounding_box(cells: DataFrame, margin: int = 0) -> DataFrame:
    """The box of the foreground with a margin, within the image. cells: dense, with label."""
    on = F.col("label") > 0
    parts = [F.greatest(F.min(F.when(on, F.col(a))) - margin, F.min(a)).alias(f"{a}_low") for a in AXES] + [F.least(F.max(F.when(on, F.col(a))) + margin, F.max(a)).alias(f"{a}_high") for a in AXES]
    return cells.groupBy("img_id").agg(*parts, F.count(F.when(on, 1)).alias("cells")).where("cells > 0").drop("cells")


def stamp(centres: DataFrame, radius: int, flat: bool = False) -> DataFrame:
    """Cells within radius of each centre (img_id, z, y, x): a ball, or a disk in the centre's slice."""
    for axis in AXES:
        reach = 0 if flat and axis == "z" else radius
        centres = centres.withColumn(f"d{axis}", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    inside = F.col("dz") ** 2 + F.col("dy") ** 2 + F.col("dx") ** 2 <= radius * radius
    return centres.where(inside).select("img_id", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES]).distinct()


def reorder(cells: DataFrame, least: int = 0, top: int | None = None, renumber: bool = True) -> DataFrame:
    """Labels by size, ties by label: the top largest, then those of at least `least` cells, numbered from 1 (or as they were)."""
    from pyspark.sql import Window

    by = Window.partitionBy("img_id").orderBy(F.desc("size"), "label")
    sizes = cells.where("label > 0").groupBy("img_id", "label").agg(F.count("*").alias("size")).withColumn("rank", F.row_number().over(by))
    sizes = (sizes if top is None else sizes.where(F.col("rank") <= top)).where(F.col("size") >= least)
    new = F.row_number().over(by) if renumber else F.col("label")
    table = sizes.select("img_id", "label", new.cast("int").alias("to"))
    return cells.join(table, ["img_id", "label"], "left").select(*KEY, F.coalesce("to", F.lit(0)).alias("label"))


def demo_image(centres: DataFrame, size: int) -> DataFrame:
    """Blobs that fade with the squared distance, on a square of size x size a row of (img_id, cy, cx, r, peak): the brightest blob shows."""
    blobs = dealt(centres, ["img_id"]).withColumn("dy", F.explode_outer(F.expr("sequence(-r, r)"))).withColumn("dx", F.explode_outer(F.expr("sequence(-r, r)")))
    lit = blobs.select("img_id", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"), F.expr("peak - peak * (dy * dy + dx * dx) div (r * r)").alias("lit"))
    shape = (1, size, size)
    cell = F.when(F.col("lit") > 0, raster([F.lit(0), F.col("y"), F.col("x")], shape)).otherwise(-1)
    seen = lit.select("img_id", cell.alias("cell"), "lit").groupBy("img_id", "cell").agg(F.max("lit").cast("int").alias("v"))
    return filled(seen, shape)
