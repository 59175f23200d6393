"""Connected components of cells, and what is built on their sizes.

Two levels: each tile of an image (and value) is labelled on its own, then labels of neighbouring tiles that touch are linked,
and components of that much smaller graph give the roots. A component's root is the least cell number in it, so
results don't depend on the tiling. Connectivity 1, 2 and 3 are neighbours by faces, edges and corners.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import BITS, KEY, cell_id, dealt, matched

#: Cells on each side of a tile: at most 64 ** 3 cells of one value in one task at a time.
TILE = 64

_own: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir; where that is unset and Spark runs on one machine, in one folder for the application."""
    spark: SparkSession = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="voxloom-")
        folder = _own[app]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    steps = (-1, 0, 1)
    return [(a, b, c) for a in steps for b in steps for c in steps if 1 <= abs(a) + abs(b) + abs(c) <= connectivity]


def _label_tile(part: pd.DataFrame, connectivity: int) -> pd.DataFrame:
    """root of each cell of one value within one tile: least cell number by repeated minima over neighbours and jumps to the root's root."""
    low = part[["z", "y", "x"]].min()
    at = tuple(part[a].to_numpy() - low[a] + 1 for a in ("z", "y", "x"))
    shape = tuple(int(a.max()) + 2 for a in at)
    n = len(part)
    order = np.lexsort(at[::-1])
    at = tuple(a[order] for a in at)
    number = np.full(shape, n, np.int64)
    number[at] = np.arange(n)
    near = [(number[tuple(a + d for a, d in zip(at, o))]) for o in offsets(connectivity)]
    near = [np.where(b < n, b, np.arange(n)) for b in near]
    root, before = np.arange(n), None
    while before is None or (root != before).any():
        before = root
        best = root.copy()
        for b in near:
            np.minimum(best, root[b], out=best)
        np.minimum.at(best, root, best)  # a root takes the best of its cells
        root = best[best]
        root = root[root]
    cell = (((part["z"].to_numpy().astype(np.int64) << BITS) + part["y"].to_numpy()) << BITS) + part["x"].to_numpy()
    cell = cell[order]
    return pd.DataFrame({"img_id": part["img_id"].to_numpy()[order], "value": part["value"].to_numpy()[order], "z": part["z"].to_numpy()[order], "y": part["y"].to_numpy()[order], "x": part["x"].to_numpy()[order], "root": cell[root]})


def _least(edges: DataFrame) -> DataFrame:
    """Components of (img_id, u, v) by alternating stars; see any account of large-star and small-star."""
    by = ["img_id"]
    edges = written(edges.where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "seams")
    before, now = None, (edges.count(), 0)
    while now[0] and now != before:
        both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*by, "u"]).where("v > m").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(*by, "u", F.col("m").alias("v")))
        edges = written(small.distinct(), "seams")
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("img_id", "u", "v").cast("decimal(38,0)")).alias("s")).first()
        before, now = now, (row["n"], row["s"])
    return edges


def components(cells: DataFrame, connectivity: int = 3, value: Column | None = None, tile: int = TILE) -> DataFrame:
    """Cells (foreground rows only; the rest are background) with `value` and `root`. Neighbours of unequal values aren't linked."""
    rows = cells.select(*KEY, (F.lit(1) if value is None else value).cast("long").alias("value"))
    corner = [F.expr(f"{a} div {tile}").alias(f"t{a}") for a in ("z", "y", "x")]
    place = ["img_id", "value", "tz", "ty", "tx"]
    tiled = dealt(rows.select("*", *corner), place).groupBy(*place)
    local = tiled.applyInPandas(lambda part: _label_tile(part, connectivity), "img_id int, value long, z int, y int, x int, root long")
    edge = F.greatest(*[F.when((F.col(a) % tile == 0) | (F.col(a) % tile == tile - 1), 1).otherwise(0) for a in ("z", "y", "x")]) == 1
    local = written(local, "tiles")
    if not any(local.agg(*[F.max(F.expr(f"{a} div {tile}")).alias(a) for a in ("z", "y", "x")]).first()):
        return local
    border = local.where(edge).withColumn("cell", cell_id())
    steps = F.array(*[F.lit((a << 2 * BITS) + (b << BITS) + c).cast("long") for a, b, c in offsets(connectivity)])
    moved = border.select("img_id", "value", F.col("root").alias("u"), F.explode(F.transform(steps, lambda d: F.col("cell") + d)).alias("cell"))
    links = _least(matched(moved, border.select("img_id", "value", "cell", F.col("root").alias("v")), ["img_id", "value", "cell"]).select("img_id", "u", "v"))
    named = local.join(links.select("img_id", F.col("u").alias("root"), F.col("v").alias("low")), ["img_id", "root"], "left")
    return named.select("img_id", "value", "z", "y", "x", F.coalesce("low", "root").alias("root"))


def sizes(labelled: DataFrame, by: str = "root") -> DataFrame:
    return labelled.groupBy("img_id", by).agg(F.count("*").alias("size"))


def ranked(labelled: DataFrame, by: str = "root") -> DataFrame:
    """sizes with rank 1 for the largest; ties go to the least root."""
    return sizes(labelled, by).withColumn("rank", F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("size"), by)))


def relabelled(labelled: DataFrame, top: int | None = None, least: int = 0, by: str = "root") -> DataFrame:
    """Cells of the `top` largest components with at least `least` cells, with labels 1, 2, ... by size."""
    keep = ranked(labelled, by).where(F.col("size") >= least)
    keep = keep if top is None else keep.where(F.col("rank") <= top)
    return labelled.join(keep, ["img_id", by]).select(*KEY, F.col("rank").cast("int").alias("label"))


def onto(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """The dense table with labels where labelled has them, 0 elsewhere."""
    return cells.select(*KEY).join(labelled.select(*KEY, "label"), KEY, "left").select(*KEY, F.coalesce("label", F.lit(0)).cast("int").alias("label"))


def filtered(cells: DataFrame, least: int, top: int) -> DataFrame:
    """Cells of each label's `top` largest components (by edges) of at least `least` cells."""
    own = components(cells.where("label > 0"), 2, F.col("label"))
    size = own.groupBy("img_id", "value", "root").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy("img_id", "value").orderBy(F.desc("size"), "root"))
    keep = size.withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("size") >= least))
    return own.join(keep, ["img_id", "value", "root"]).select(*KEY, F.col("value").cast("int").alias("label"))


def split_label(cells: DataFrame, label: int, top: int | None = None, keep: bool = True, only: bool = False) -> DataFrame:
    """The dense table with the components (by edges) of one label as labels beyond the image's last, by size; a single component stays as it is.

    keep: the largest keeps the label, else all get new ones. top: how many components to keep; the cells of the others are free. only: all
    other labels go.
    """
    ranks = relabelled(components(cells.where(F.col("label") == label), 2), top).withColumnRenamed("label", "k")
    last = cells.groupBy("img_id").agg(F.max("label").alias("last"), F.lit(True).alias("there"))
    ranks = ranks.withColumn("n", F.max("k").over(Window.partitionBy("img_id")))
    new = F.when((F.col("n") == 1) | (F.lit(keep) & (F.col("k") == 1)), F.lit(label)).otherwise(F.col("last") + F.col("k") - int(keep))
    rest = F.when(F.col("label") == label, 0).otherwise(0 if only else F.col("label"))
    return cells.join(last, "img_id").join(ranks, KEY, "left").select(*KEY, F.coalesce(F.when(F.col("k").isNotNull(), new), rest).cast("int").alias("label"))


def split_all(cells: DataFrame, top: int | None = None) -> DataFrame:
    """The dense table with all components (by edges) of all labels, numbered by size; top: of each label, how many to keep."""
    own = components(cells.where("label > 0"), 2, F.col("label"))
    size = own.groupBy("img_id", "value", "root").agg(F.count("*").alias("size"))
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("img_id", "value").orderBy(F.desc("size"), "root"))
        size = size.withColumn("rank", rank).where(F.col("rank") <= top)
    k = F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("size"), "value", "root"))
    return onto(cells, own.join(size.withColumn("label", k.cast("int")), ["img_id", "value", "root"]))
