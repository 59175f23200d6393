"""Surfaces and skeletons of labels, by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, KEY, line
from .components import written


def faces(cells: DataFrame) -> DataFrame:
    """img_id, label and the corners (z2, y2, x2 arrays of four, doubled) of the unit squares between a label's cells and others, image ends included."""
    out = None
    for axis in AXES:
        others = [a for a in AXES if a != axis]
        for step, near in ((1, F.lead), (-1, F.lag)):
            seen = cells.withColumn("_n", F.coalesce(near("label").over(line(axis)), F.lit(0))).where("label > 0 and _n <> label")
            corners = [(-1, -1), (-1, 1), (1, 1), (1, -1)]
            place = {axis: F.array(*[2 * F.col(axis) + step] * 4)} | {a: F.array(*[2 * F.col(a) + c[i] for c in corners]) for i, a in enumerate(others)}
            rows = seen.select("img_id", "label", *[place[a].alias(f"{a}2") for a in AXES])
            out = rows if out is None else out.unionByName(rows)
    return out


#: Vertices of one value of z2 divided by this are numbered together.
SLAB = 64


def numbered_vertices(faces: DataFrame) -> DataFrame:
    """img_id, label, z2, y2, x2, number: the corners of all labels' squares once each, numbered from 0 in an image by label, z2, y2, x2.

    Slabs of a label are numbered on their own, and begin where the slabs and labels before them end, by running totals of counts.
    """
    corner = F.explode(F.arrays_zip("z2", "y2", "x2")).alias("c")
    points = written(faces.select("img_id", "label", corner).select("img_id", "label", "c.*").distinct().withColumn("slab", F.expr(f"z2 div {SLAB}")), "vertices")
    slabs = points.groupBy("img_id", "label", "slab").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("img_id").orderBy("label", "slab")) - F.col("n")  # a row for each slab of a label
    inside = F.row_number().over(Window.partitionBy("img_id", "label", "slab").orderBy("z2", "y2", "x2")) - 1
    placed = points.withColumn("k", inside).join(slabs.withColumn("before", before).drop("n"), ["img_id", "label", "slab"])
    return placed.select("img_id", "label", "z2", "y2", "x2", (F.col("before") + F.col("k")).alias("number"))


def merged_ply(faces: DataFrame, img_id: int) -> DataFrame:
    """The lines of one PLY file of all labels of an image, with kind and n that give their order: write them with write_lines().

    Labels keep vertices of their own, as meshes of several files do when they are put into one.
    """
    own = faces.where(F.col("img_id") == img_id).withColumn("square", F.struct("label", "z2", "y2", "x2"))
    points = numbered_vertices(own)
    half = lambda c: F.format_string("%s", (F.col(c) / 2).cast("string"))
    vertices = points.select(F.lit(1).alias("kind"), "number", F.concat_ws(" ", half("x2"), half("y2"), half("z2")).alias("line"))
    corners = own.select("label", "square", F.posexplode(F.arrays_zip("z2", "y2", "x2")).alias("at", "c")).select("label", "square", "at", "c.*")
    joined = corners.join(points.drop("img_id"), ["label", "z2", "y2", "x2"]).groupBy("square").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("c"))  # four
    squares = joined.select(F.lit(2).alias("kind"), F.array_min("c.number").alias("number"), F.concat(F.lit("4 "), F.array_join(F.transform("c", lambda c: c["number"].cast("string")), " ")).alias("line"))
    lines = written(vertices.unionByName(squares), "ply")
    n = {r["kind"]: r["n"] for r in lines.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    head = ["ply", "format ascii 1.0", f"element vertex {n.get(1, 0)}", "property float x", "property float y", "property float z", f"element face {n.get(2, 0)}", "property list uchar int vertex_indices", "end_header"]
    first = lines.sparkSession.createDataFrame([(0, k, line_) for k, line_ in enumerate(head)], "kind int, number long, line string")
    return first.unionByName(lines)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in the order of kind and number as text files whose names are in that order; put end to end they are the file."""
    lines.repartitionByRange("kind", "number", "line").sortWithinPartitions("kind", "number", "line").select("line").write.text(path)


def skeleton(cells: DataFrame, column: str = "on") -> DataFrame:
    """column thinned in each z slice to lines of one cell, by the parallel two-pass thinning of Zhang and Suen.

    A round is two passes of windows along x and y and a written table; it ends when nothing changes, after about as many
    rounds as the thickest part has cells across.
    """
    rows = cells.select(*KEY, F.col(column).cast("int").alias("p"))
    x, y = line("x"), line("y")
    before, count = None, -1
    while before != count:
        for first in (True, False):
            seen = rows.withColumns({"w": F.coalesce(F.lag("p").over(x), F.lit(0)), "e": F.coalesce(F.lead("p").over(x), F.lit(0))})
            ring = {"n": F.lag("p"), "ne": F.lag("e"), "nw": F.lag("w"), "s": F.lead("p"), "se": F.lead("e"), "sw": F.lead("w")}
            seen = seen.withColumns({k: F.coalesce(v.over(y), F.lit(0)) for k, v in ring.items()})
            order = ["n", "ne", "e", "se", "s", "sw", "w", "nw", "n"]
            total = sum((F.col(c) for c in order[:-1]), F.lit(0))
            turns = sum((((F.col(a) == 0) & (F.col(b) == 1)).cast("int") for a, b in zip(order, order[1:])), F.lit(0))
            a, b = (("n", "e", "s"), ("e", "s", "w")) if first else (("n", "e", "w"), ("n", "s", "w"))
            free = lambda t: F.col(t[0]) * F.col(t[1]) * F.col(t[2]) == 0
            gone = (F.col("p") == 1) & total.between(2, 6) & (turns == 1) & free(a) & free(b)
            rows = seen.select(*KEY, F.when(gone, 0).otherwise(F.col("p")).alias("p"))
        rows = written(rows, "thinned")
        before, count = count, rows.where("p = 1").count()
    return rows.where("p = 1").select(*KEY)
