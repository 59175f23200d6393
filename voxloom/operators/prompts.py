"""Prompts for outside models, and the fusion of their answers.

Samples are drawn in the order of a hash of the cell's number, so they are the same at every run and partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, KEY, cell_id, matched
from .components import components


def lot() -> Column:
    """A cell's place in the draw: a multiplicative hash of its number."""
    return ((cell_id() % 1048573) * 2654435761) % 4294967296


def drawn(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells with k, their place from 1 in the draw of their group of img_id and `by`."""
    order = Window.partitionBy("img_id", *by).orderBy("lot", "cell")
    return cells.withColumns({"lot": lot(), "cell": cell_id()}).withColumn("k", F.row_number().over(order)).drop("lot", "cell")


def sample(cells: DataFrame, n: int, by: list[str]) -> DataFrame:
    """n cells of each group of img_id and `by`, or all where there are no more."""
    return drawn(cells, by).where(F.col("k") <= n).drop("k")


#: Parts of a cell in which centres are counted, so that sums are whole numbers in any order.
FINE = 1024


def sample_kmeans(cells: DataFrame, n: int, by: list[str], rounds: int = 10) -> DataFrame:
    """img_id, `by`, z, y, x of n centres of each group's cells by Lloyd's steps, rounded to cells; all cells where there are no more than n.

    A step is one aggregation over all groups of all images: each cell finds the nearest of its group's centres (the first of equals)
    beside it, and sums of cells give the new ones. Centres begin at the first cells drawn; one that gets no cell stays. Equal centres of a group give one row.
    """
    from .components import written

    group = ["img_id", *by]
    own = written(cells.select(*group, *AXES), "points")
    first = drawn(own, by).where(F.col("k") <= n)
    centres = written(first.select(*group, "k", *[(F.col(a) * FINE).cast("long").alias(f"c{a}") for a in AXES]), "centres")
    few = own.groupBy(*group).agg((F.count("*") <= n).alias("few"))
    many = written(own.join(few.where("not few").drop("few"), group), "points")
    for _ in range(rounds):
        listed = centres.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("k", "cz", "cy", "cx"))).alias("centres"))  # n at most
        far = lambda c: sum(((F.col(a) * FINE - c[f"c{a}"]) * (F.col(a) * FINE - c[f"c{a}"]) for a in AXES), F.lit(0).cast("long"))
        nearest = F.array_min(F.transform("centres", lambda c: F.struct(far(c).alias("d"), c["k"].alias("k"))))["k"]
        sums = many.join(listed, group).withColumn("k", nearest).groupBy(*group, "k").agg(F.count("*").alias("n"), *[F.sum(F.col(a).cast("long")).alias(f"s{a}") for a in AXES])
        moved = centres.join(sums, [*group, "k"], "left")
        centres = written(moved.select(*group, "k", *[F.coalesce(F.expr(f"s{a} * {FINE} div n"), F.col(f"c{a}")).alias(f"c{a}") for a in AXES]), "centres")
    rounded = [F.expr(f"cast((c{a} + {FINE // 2}) div {FINE} as int)").alias(a) for a in AXES]
    return centres.select(*group, *rounded).distinct()


def sample_grid(cells: DataFrame, per_axis: int = 2) -> DataFrame:
    """One cell of each label from each part of a grid over the label's box."""
    box = cells.where("label > 0").groupBy("img_id", "label").agg(*[f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("low", F.min), ("high", F.max))])
    part = [F.expr(f"cast(({a} - {a}_low) * {per_axis} div ({a}_high - {a}_low + 1) as int)").alias(f"g{a}") for a in AXES]
    rows = cells.where("label > 0").join(box, ["img_id", "label"]).select(*KEY, "label", *part)
    return sample(rows, 1, ["label", "gz", "gy", "gx"]).select(*KEY, "label")


def others(own: DataFrame, n: int, by: list[str], each: bool = False) -> DataFrame:
    """For each label of a group n cells of its other labels, of all together or (each) of every one; class_id is the label that they are against.

    The draw's order is the same for every pool, so the first n of all others are among the first n of each: labels meet labels'
    first n cells, not all cells.
    """
    first = drawn(own, [*by, "label"]).where(F.col("k") <= n)
    classes = own.select("img_id", *by, F.col("label").alias("class_id")).distinct()
    seen = first.drop("k").join(classes, ["img_id", *by]).where("label <> class_id")
    return seen if each else sample(seen, n, [*by, "class_id"])


def point_prompts(cells: DataFrame, axis: str, positives: int, negatives: int, each: bool = False) -> DataFrame:
    """Points of each slice across an axis and each of its labels: `positives` in it (label 1), `negatives` in all other labels of the slice or (each) in every one (label 0)."""
    rows, cols = [a for a in AXES if a != axis]
    own = cells.where("label > 0")
    yes = sample(own.withColumn("class_id", F.col("label")), positives, [axis, "class_id"]).withColumn("sign", F.lit(1))
    no = others(own, negatives, [axis], each).withColumn("sign", F.lit(0))
    columns = ["img_id", F.col(axis).alias("slice"), "class_id", F.col(cols).alias("px"), F.col(rows).alias("py"), "sign"]
    return yes.select(columns).unionByName(no.select(columns))


def volume_prompts(cells: DataFrame, positives: int = 5, negatives: int = 5, method: str = "random", settings: dict[int, dict] | None = None, background: bool = True, other: bool = True, each: bool = False, nonzero: bool = False) -> DataFrame:
    """Point prompts of a volume's classes: img_id, class_id, x, y, z, label, point_type, sample_method.

    settings: n_pos, n_neg and method by class, where they differ from the others'. method: random or kmeans, of positive points.
    Negative points of a class are n_neg of the background, and n_neg of all other classes (negative_other) or of each of them
    (negative_class<k>); their sample_method says random. nonzero: cells of intensity 0 aren't taken for the background, nor
    (each) for other classes. The pools are drawn once, and classes take from their heads.
    """
    settings = settings or {}
    values = lambda key, default: {k: s.get(key, default) for k, s in settings.items() if s.get(key, default) != default}

    def setting(key: str, default):
        out = F.lit(default)
        for k, v in values(key, default).items():
            out = F.when(F.col("class_id") == k, v).otherwise(out)
        return out

    own = cells.where("label > 0")
    classes = own.select("img_id", F.col("label").alias("class_id")).distinct().withColumns({"n_pos": setting("n_pos", positives), "n_neg": setting("n_neg", negatives), "method": setting("method", method)})
    columns = ["img_id", "class_id", "x", "y", "z", "label", "point_type", "sample_method"]
    made = lambda df, sign, kind, how: df.select("img_id", "class_id", "x", "y", "z", F.lit(sign).alias("label"), kind.alias("point_type"), how.alias("sample_method"))

    ranked = drawn(own.select(*KEY, F.col("label").alias("class_id")), ["class_id"]).where(F.col("k") <= max([positives, *values("n_pos", positives).values()]))
    out = made(ranked.join(classes, ["img_id", "class_id"]).where("method = 'random' and k <= n_pos"), True, F.lit("positive"), F.lit("random"))
    for n in {positives, *values("n_pos", positives).values()} if "kmeans" in {method, *values("method", method).values()} else ():
        means = own.select(*KEY, F.col("label").alias("class_id")).join(classes.where(f"method = 'kmeans' and n_pos = {n}").select("img_id", "class_id"), ["img_id", "class_id"])
        out = out.unionByName(made(sample_kmeans(means, n, ["class_id"]), True, F.lit("positive"), F.lit("kmeans")))
    most = max([negatives, *values("n_neg", negatives).values()])
    if background and most:
        pool = cells.where("label = 0 and v <> 0" if nonzero else "label = 0")
        head = drawn(pool.select(*KEY), []).where(F.col("k") <= most)
        out = out.unionByName(made(head.join(classes, "img_id").where("k <= n_neg"), False, F.lit("negative_bg"), F.lit("random")))
    if other and most:
        pool = (own.where("v <> 0") if nonzero and each else own).select(*KEY, "label")
        seen = drawn(pool, ["label"]).where(F.col("k") <= most).join(classes, "img_id").where("label <> class_id and k <= n_neg")
        if each:
            out = out.unionByName(made(seen, False, F.concat(F.lit("negative_class"), F.col("label").cast("string")), F.lit("random")))
        else:
            first = drawn(seen.drop("k"), ["class_id"]).where("k <= n_neg")
            out = out.unionByName(made(first, False, F.lit("negative_other"), F.lit("random")))
    return out.select(columns)


def box_prompts(cells: DataFrame) -> DataFrame:
    """The box of each 2-D component (by corners) of each label in each z slice."""
    own = cells.where("label > 0")
    n = 1 << 20
    parts = components(own, 3, F.col("label").cast("long") * n + F.col("z"))  # a slice's cells are linked with each other only
    ends = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    return parts.groupBy("img_id", F.col("z").alias("slice"), F.expr(f"cast(value div {n} as int)").alias("class_id"), "root").agg(*ends).drop("root")


def prompt_groups(points: DataFrame) -> DataFrame:
    """Points of one slice and class as one prompt; batch: all classes of the slice have as many points."""
    listed = points.groupBy("img_id", "slice", "class_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", F.lpad("px", 4, "0"), F.lpad("py", 4, "0"), "sign"))), ";").alias("points"))
    by = Window.partitionBy("img_id", "slice")
    return listed.withColumn("batch", F.min("n").over(by) == F.max("n").over(by))


def lift(points: DataFrame, axis: str) -> DataFrame:
    """Slice points as cells of the volume."""
    rows, cols = [a for a in AXES if a != axis]
    return points.select("img_id", F.col("slice").alias(axis), F.col("py").alias(rows), F.col("px").alias(cols), "class_id", "sign").select(*KEY, "class_id", "sign")


def invalid_prompts(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Prompts (cells) that lie outside their image."""
    return matched(points, cells.select(*KEY), KEY, "left_anti")


def vote_per_class(votes: DataFrame, order: list[int], least: int = 2) -> DataFrame:
    """votes: cells with label, a row for each voter. Classes with `least` votes at a cell hold; the first in order shows."""
    held = votes.where("label > 0").groupBy(*KEY, "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("label"))
    return held.withColumn("place", place).where("place > 0").groupBy(*KEY).agg(F.min_by("label", "place").alias("label"))


def vote_majority(votes: DataFrame, cells: DataFrame | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The most frequent label of a cell, background included; the least of equals. cells: intensities v; where they aren't within low and high the label is 0."""
    counts = votes.groupBy(*KEY, "label").agg(F.count("*").alias("n"))
    found = counts.groupBy(*KEY).agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("back"))).alias("label"))
    if cells is None or low is None and high is None:
        return found
    holds = F.lit(True) if low is None else F.col("v") >= low
    holds = holds if high is None else holds & (F.col("v") <= high)
    return found.join(cells.select(*KEY, "v"), KEY).select(*KEY, F.when(holds, F.col("label")).otherwise(0).cast("int").alias("label"))


def compose(votes: DataFrame, order: list[int], last: bool = False, ignore: Iterable[int] = ()) -> DataFrame:
    """The label that comes first in order, or last, of those at a cell; ignore: labels that don't count."""
    votes = votes.where(~F.col("label").isin(list(ignore))) if ignore else votes
    placed = votes.where("label > 0").withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("label"))).where("place > 0")
    return placed.groupBy(*KEY).agg((F.max_by if last else F.min_by)("label", "place").alias("label"))


def numbered_classes(names: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """class_name and label, from 1 in the order of names, of the classes in a column `class_name`."""
    different = names.where(~F.col("class_name").isin(list(ignore))) if ignore else names
    return different.select("class_name").distinct().withColumn("label", F.row_number().over(Window.orderBy("class_name")).cast("int"))  # a row a class


def paint_lowest(masks: DataFrame) -> DataFrame:
    """masks: cells with class_id; the lowest class of a cell shows."""
    return masks.groupBy(*KEY).agg(F.min("class_id").alias("label"))


def mesh_vertices(cells: DataFrame) -> DataFrame:
    """Vertices of the surface of each label at half height: midpoints of the edges between a cell in it and one that isn't, doubled to whole numbers."""
    from ..model import line

    out = None
    for axis in AXES:
        seen = cells.withColumn("next", F.lead("label").over(line(axis))).where("next <> label")
        for mine in ("label", "next"):
            rows = seen.where(F.col(mine) > 0).select("img_id", F.col(mine).alias("label"), *[(2 * F.col(a) + (1 if a == axis else 0)).alias(f"{a}2") for a in AXES])
            out = rows if out is None else out.unionByName(rows)
    return out
