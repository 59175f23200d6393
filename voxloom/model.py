"""Images as tables of cells.

A cell table has img_id, z, y, x and a value `v` (intensity) or `label` (0 is background). 2-D images have z = 0. Tables are
dense: every cell of an image's box has a row, which is what frames over neighbours rely on. All operators work on many
images at once; img_id leads every partitioning, and an axis line of one image is the most that a window sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["img_id", "z", "y", "x"]
AXES = ("z", "y", "x")
#: Cells of one image have ids z, y, x in raster order, with room for 2 ** 20 values each of y and x, and 2 ** 22 of z.
BITS = 20


def cell_id() -> Column:
    """The raster number of a cell in its image; neighbours differ by a constant for each direction."""
    z, y, x = (F.col(a).cast("long") for a in AXES)
    return F.shiftleft(F.shiftleft(z, BITS) + y, BITS) + x


def line(axis: str):
    """Windows along an axis: all cells of one image that differ in that coordinate only, in order."""
    return Window.partitionBy("img_id", *[a for a in AXES if a != axis]).orderBy(axis)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D images of 64 columns, 64 rows of them a photo, from the components of the vectors in embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return rows.select(
        F.expr("cast(vec_id div 64 as int)").alias("img_id"), F.lit(0).alias("z"), (F.col("vec_id") % 64).cast("int").alias("y"), "x", F.floor((F.col("e").cast("double") + 1.0) * 127.5).cast("int").alias("v")
    )


#: Cells along each axis of the images that volumes() makes.
VOLUME = (7, 16, 16)


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-D images of 7 x 16 x 16 cells, one for 2048 order keys, from the mean quantities in lineitem; cells without any are 0. One shuffle, by image."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = [F.col("l_linenumber") - 1, F.col("l_orderkey") % VOLUME[1], F.col("l_partkey") % VOLUME[2]]
    rows = items.withColumn("img_id", F.expr("cast(l_orderkey div 2048 as int)")).select("img_id", raster(place, VOLUME).alias("cell"), F.col("l_quantity").cast("long").alias("q"))
    return filled(dealt(rows, ["img_id"]).groupBy("img_id", "cell").agg(F.expr("cast(sum(q) * 5 div count(*) as int)").alias("v")), VOLUME)


def raster(place: list[Column], shape: tuple[int, int, int]) -> Column:
    """The number of the cell at z, y, x of an image of that shape; -1 for a row that is in no cell of it."""
    inside = F.col("img_id").isNotNull()
    for p, n in zip(place, shape):
        inside = inside & p.between(0, n - 1)
    return F.when(inside, (place[0] * shape[1] + place[1]) * shape[2] + place[2]).otherwise(-1).cast("int")


def filled(some: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The dense table of all images in `some` (img_id, cell by raster(), v; one row a cell), with v 0 in cells without a row.

    A row makes its own cell and the empty ones up to the next row's: no join with a grid, and an image's cells are all that a window sees.
    """
    order = Window.partitionBy("img_id").orderBy("cell")
    first = F.when(F.lag("cell").over(order).isNull(), 0).otherwise(F.col("cell"))
    runs = some.select("img_id", "cell", "v", first.alias("low"), F.lead("cell", 1, shape[0] * shape[1] * shape[2]).over(order).alias("high")).where("low < high")
    cells = runs.select("img_id", F.explode(F.sequence("low", F.col("high") - 1)).alias("at"), "cell", "v")
    axes = [F.expr(e).cast("int").alias(a) for a, e in zip(AXES, (f"at div {shape[1] * shape[2]}", f"at div {shape[2]} % {shape[1]}", f"at % {shape[2]}"))]
    return cells.select("img_id", *axes, F.when(F.col("at") == F.col("cell"), F.coalesce("v", F.lit(0))).otherwise(0).alias("v"))


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows by columns in as many parts as a shuffle has.

    Cells are so alike that many millions of them are few bytes in a shuffle; Spark would put them into one task, but leaves parts
    whose number is given as they are.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, by, how) for tables of cells of which either may be larger than Spark takes it for, as it is after an explode: dealt, sorted and merged, never broadcast."""
    return dealt(left, by).join(right.hint("merge"), by, how)


def segments(cells: DataFrame, least: int = 100) -> DataFrame:
    """A segmentation of an image for operators on labels: blocks of 4 x 4 columns numbered 1 to 5, where intensity reaches `least`."""
    block = (F.expr("x div 4") + F.expr("y div 4") + F.col("z")) % 5 + 1
    return cells.select(*KEY, "v", F.when(F.col("v") >= least, block).otherwise(0).cast("int").alias("label"))
