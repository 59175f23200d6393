"""Seeds: thresholds, erosions and components over a grid of parameters, in one job each.

A row of the grid is a copy of the image's cells that pass; all erosions by balls come from one city-block distance.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, KEY, line
from .components import components, relabelled
from .distance import hull_volumes
from .morphology import city_block, erode


def seeds(cells: DataFrame, low: int, high: int | None = None, erosions: int = 1, top: int | None = None, footprint: str = "ball", strict: bool = False, connectivity: int = 3) -> DataFrame:
    """Labels by size of the components that are left after `erosions` steps."""
    from .cells import within

    on = erode(cells.withColumn("on", within(low, high, strict)), footprint, erosions)
    return relabelled(components(on.where("on"), connectivity), top)


def sweep(cells: DataFrame, lows: list[int], erosions: int, top: int, strict: bool = False) -> DataFrame:
    """img_id, low, erosion, rank, size of the `top` largest components for each threshold and 0 to `erosions` balls."""
    on = cells.withColumn("low", F.explode(F.array(*map(F.lit, lows))))
    on = on.withColumn("on", F.col("v") > F.col("low") if strict else F.col("v") >= F.col("low"))
    # One image for each threshold: the number of the threshold goes into img_id and out again.
    n = len(lows)
    at = F.array_position(F.array(*map(F.lit, lows)), F.col("low")).cast("int") - 1
    far = city_block(on.withColumn("img_id", F.col("img_id") * n + at), "on", "d")
    left = far.withColumn("erosion", F.explode(F.sequence(F.lit(0), F.lit(erosions)))).where("d > erosion")
    parts = components(left, 3, F.col("erosion"))
    size = parts.groupBy("img_id", F.col("value").cast("int").alias("erosion"), "root").agg(F.count("*").alias("size"))
    by = Window.partitionBy("img_id", "erosion").orderBy(F.desc("size"), "root")
    found = size.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    threshold = F.get(F.array(*map(F.lit, lows)), F.col("img_id") % n)
    return found.select(F.expr(f"cast(img_id div {n} as int)").alias("img_id"), threshold.alias("low"), "erosion", "rank", "size")


def seed_log(swept: DataFrame) -> DataFrame:
    """One row a threshold and erosion: how many components were kept, and their sizes from the largest."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "size")))
    return swept.groupBy("img_id", "low", "erosion").agg(F.count("*").alias("n_components"), F.sum("size").alias("cells"), F.array_join(F.transform(listed, lambda s: s["size"].cast("string")), ",").alias("sizes"))


#: Limits of what may split: (least, most), None for no limit.
Limit = tuple[int | None, int | None]
NO_LIMIT: Limit = (None, None)


def split_step(parents: DataFrame, children: DataFrame, share: float = 0.0, total: float = 0.0, size_limit: Limit = NO_LIMIT, hull_limit: Limit = NO_LIMIT) -> DataFrame:
    """One step of adaptive splitting: parents and children are cell tables with label > 0; gives the cells' new labels.

    A parent with two children or more, which together cover at least `total` of it, and of a size and hull within the limits,
    goes; its children that cover more than `share` of it get fresh labels by (parent, child), and paint their whole component.
    """
    return _split(parents, children, split_rule(parents, children, share, total, size_limit, hull_limit))


def _split(parents: DataFrame, children: DataFrame, rule: DataFrame) -> DataFrame:
    kept = parents.join(rule.select("img_id", F.col("parent").alias("label")).distinct(), ["img_id", "label"], "left_anti")
    fresh = children.join(rule.where("chosen").select("img_id", F.col("child").alias("label"), "to"), ["img_id", "label"]).groupBy(*KEY).agg(F.max("to").alias("to"))
    return kept.join(fresh, KEY, "full").select(*KEY, F.coalesce("to", "label").cast("int").alias("label"))


def overlap_shares(parents: DataFrame, children: DataFrame) -> DataFrame:
    """img_id, parent, child, cells in both, and the share of the parent in percent, to 4 digits."""
    both = parents.select(*KEY, F.col("label").alias("parent")).join(children.select(*KEY, F.col("label").alias("child")), KEY)
    size = parents.groupBy("img_id", F.col("label").alias("parent")).agg(F.count("*").alias("size"))
    return both.groupBy("img_id", "parent", "child").agg(F.count("*").alias("shared")).join(size, ["img_id", "parent"]).withColumn("share", F.round(F.col("shared") / F.col("size"), 6) * 100)


def split_rule(parents: DataFrame, children: DataFrame, share: float, total: float, size_limit: Limit = NO_LIMIT, hull_limit: Limit = NO_LIMIT) -> DataFrame:
    """img_id, parent, child, share, chosen, to for the parents that split. hull_limit: of the volume of the parent's hull, of which a flat one has none and doesn't split."""
    low, high = size_limit
    by = Window.partitionBy("img_id", "parent")
    seen = overlap_shares(parents, children).withColumns({"n": F.count("*").over(by), "sum": F.sum("share").over(by)})
    seen = seen.where((F.col("n") >= 2) & (F.col("sum") >= total * 100))
    seen = seen if low is None else seen.where(F.col("size") >= low)
    seen = seen if high is None else seen.where(F.col("size") <= high)
    if hull_limit != NO_LIMIT:
        few = parents.join(seen.select("img_id", F.col("parent").alias("label")).distinct(), ["img_id", "label"], "left_semi")
        volume = F.expr("volume6 div 6")
        within = F.col("volume6") > 0
        within = within if hull_limit[0] is None else within & (volume >= hull_limit[0])
        within = within if hull_limit[1] is None else within & (volume <= hull_limit[1])
        seen = seen.join(hull_volumes(few).where(within).select("img_id", F.col("label").alias("parent")), ["img_id", "parent"], "left_semi")
    most = parents.groupBy("img_id").agg(F.max("label").alias("most"))
    chosen = F.col("share") > share * 100
    count = F.sum(chosen.cast("int")).over(Window.partitionBy("img_id").orderBy("parent", "child"))
    return seen.withColumns({"chosen": chosen, "count": count}).join(most, "img_id").select("img_id", "parent", "child", "share", "chosen", F.when(F.col("chosen"), F.col("most") + F.col("count")).cast("int").alias("to"))


def _at(values, step: int):
    """A setting of one step: of all steps, or of a list by step."""
    return values[step] if isinstance(values, list) else values


def _split_by_steps(masks: Iterator[DataFrame], top: int | list[int] | None, min_size: int, patience: int | None, share: float, total: float, size_limit: Limit, hull_limit: Limit) -> tuple[DataFrame, DataFrame]:
    """Splits the components of the first mask by those of each next one. Returns the labels, by size, and the lineage (step, img_id, parent, child label, share)."""
    from .cells import reorder
    from .components import written

    parts = lambda mask, step: written(relabelled(components(mask), _at(top, step), min_size), "seeds")
    at, lineage, quiet = parts(next(masks), 0), None, 0
    for k, mask in enumerate(masks, 1):
        children = parts(mask, k)
        rule = written(split_rule(at, children, share, total, size_limit, hull_limit), "splits")
        steps = rule.where("chosen").select(F.lit(k).alias("step"), "img_id", "parent", F.col("to").alias("child"), "share")
        lineage = steps if lineage is None else lineage.unionByName(steps)
        if rule.take(1):
            at, quiet = written(_split(at, children, rule), "seeds"), 0
        else:
            quiet += 1
            if patience is not None and quiet >= patience:
                break
    if lineage is None:
        lineage = at.limit(0).select(F.lit(0).alias("step"), "img_id", F.col("label").alias("parent"), F.col("label").alias("child"), F.lit(0.0).alias("share"))
    return reorder(at), lineage


def _eroded(on: DataFrame, times: int, footprints: str | list[str] | None) -> Iterator[DataFrame]:
    """The cells of `on` that are left after 0, 1, ... `times` erosions. footprints: of all erosions or by step; balls, and None, go by one distance transform."""
    from .components import written

    names = [_at(footprints or "ball", k) for k in range(times)]
    if set(names) <= {"ball", "disk"}:
        far = written(city_block(on, "on", "d"), "distance")
        yield from (far.where(F.col("d") > k) for k in range(times + 1))
        return
    at = on
    yield at.where("on")
    for name in names:
        at = written(erode(at, name), "eroded")
        yield at.where("on")


def _mask(cells: DataFrame, low: int, high: int | None, boundary: Column | None) -> DataFrame:
    from .cells import within

    on = within(low, high)
    return cells.withColumn("on", on if boundary is None else on & ~boundary)


def adaptive(
    cells: DataFrame,
    low: int,
    erosions: int,
    top: int | list[int] | None = None,
    share: float = 0.0,
    total: float = 0.0,
    patience: int | None = 3,
    high: int | None = None,
    min_size: int = 0,
    size_limit: Limit = NO_LIMIT,
    hull_limit: Limit = NO_LIMIT,
    boundary: Column | None = None,
    footprints: str | list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Splits the components of a threshold by those left after each erosion. Returns the labels, by size, and the lineage (step, img_id, parent, child label, share).

    Ends after `patience` steps in which nothing splits. top: how many components to keep, of all steps or a list by step, the
    first of no erosion; min_size: of a component; size_limit, hull_limit: of the cells and the hull's volume of a label that may
    split; high: an upper threshold; boundary: cells that belong to nothing; footprints: of all erosions or a list by step.
    """
    return _split_by_steps(_eroded(_mask(cells, low, high, boundary), erosions, footprints), top, min_size, patience, share, total, size_limit, hull_limit)


def descendants(lineage: DataFrame, steps: int) -> DataFrame:
    """img_id, root, leaf: labels that split and those that came of them in the end. A join a step."""
    at = lineage.select("img_id", F.col("parent").alias("root"), "child")
    made = lineage.select("img_id", F.col("child").alias("parent"))
    at = at.join(made.select("img_id", F.col("parent").alias("root")), ["img_id", "root"], "left_anti")
    for _ in range(steps):
        more = lineage.select("img_id", F.col("parent").alias("child"), F.col("child").alias("next"))
        at = at.join(more, ["img_id", "child"], "left").select("img_id", "root", F.coalesce("next", "child").alias("child"))
    return at.distinct().select("img_id", "root", F.col("child").alias("leaf"))


def adaptive_by_threshold(
    cells: DataFrame,
    lows: list[int],
    erosions: int = 0,
    top: int | list[int] | None = None,
    share: float = 0.0,
    total: float = 0.0,
    patience: int | None = None,
    min_size: int = 0,
    highs: list[int] | None = None,
    size_limit: Limit = NO_LIMIT,
    hull_limit: Limit = NO_LIMIT,
    boundary: Column | None = None,
    footprints: str | list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As adaptive(), with rising thresholds in place of erosions (highs: upper ones); each mask is eroded `erosions` times. patience: steps without a split after which it ends; None: goes through all."""

    def masks() -> Iterator[DataFrame]:
        for k, low in enumerate(lows):
            *_, left = _eroded(_mask(cells, low, None if highs is None else highs[k], boundary), erosions, footprints)
            yield left

    return _split_by_steps(masks(), top, min_size, patience, share, total, size_limit, hull_limit)


def grid(cells: DataFrame, lows: list[int], footprints: list[str], top: int, erosions: int = 1, highs: list[int] | None = None, min_size: int = 0) -> DataFrame:
    """img_id, low, footprint, erosion, rank, size for every threshold (highs: upper ones), footprint and 1 to `erosions` erosions.

    The grid is rows: a threshold is an image of its own, and each footprint's erosions follow one another over all of them at once;
    components of all thresholds, footprints and erosions are labelled together.
    """
    n = len(lows)
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    low, high = F.get(F.array(*map(F.lit, lows)), F.col("_low")), F.get(F.array(*map(F.lit, highs or [None] * n)), F.col("_low"))
    on = cells.withColumn("_low", at).withColumn("on", (F.col("v") >= low) & (high.isNull() | (F.col("v") <= high)))
    on = on.select((F.col("img_id") * n + F.col("_low")).alias("img_id"), "z", "y", "x", "on")
    left = None
    for f, name in enumerate(footprints):
        now = on
        for k in range(1, erosions + 1):
            now = erode(now, name)
            rows = now.where("on").select(*KEY, F.lit(f * erosions + k - 1).alias("case"))
            left = rows if left is None else left.unionByName(rows)
    size = components(left, 3, F.col("case")).groupBy("img_id", F.col("value").cast("int").alias("case"), "root").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    by = Window.partitionBy("img_id", "case").orderBy(F.desc("size"), "root")
    found = size.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    name = F.get(F.array(*map(F.lit, footprints)), F.expr(f"cast(case div {erosions} as int)"))
    return found.select(F.expr(f"cast(img_id div {n} as int)").alias("img_id"), F.get(F.array(*map(F.lit, lows)), F.col("img_id") % n).alias("low"), name.alias("footprint"), (F.col("case") % erosions + 1).cast("int").alias("erosion"), "rank", "size")


def plot_series(log: DataFrame) -> DataFrame:
    """One point for each threshold and erosion: series `volume` (cells kept) and `components` (how many)."""
    point = lambda name, column: log.select("img_id", F.lit(name).alias("series"), "low", "erosion", F.col(column).cast("long").alias("value"))
    return point("volume", "cells").unionByName(point("components", "n_components"))


def descent(cells: DataFrame, start: int, target: int, rounds: int, top: int, erosions: int = 0) -> DataFrame:
    """Seeds above `start` (by faces, eroded `erosions` times); then thresholds fall evenly to target, and at each one what is free and above it joins a seed.

    Free cells hang together by faces, and a whole such part goes to a label that it touches: to the highest, since labels
    are painted in order. A round labels the free parts of all images once, whatever the number of labels.
    """
    from .components import onto, written

    on = erode(cells.withColumn("on", F.col("v") > start), "ball", erosions)
    at = written(cells.select(*KEY, "v").join(onto(cells, relabelled(components(on.where("on"), 1), top)), KEY), "descent")
    for i in range(rounds + 1):
        low = start + (target - start) * i // rounds  # whole numbers above the fraction are those above its floor
        free = (F.col("label") == 0) & (F.col("v") > low)
        parts = components(at.where(free), 1)
        seen = F.greatest(*[F.max("label").over(line(a).rowsBetween(-1, 1)) for a in AXES])
        beside = at.withColumn("beside", seen).where(free & (F.col("beside") > 0)).select(*KEY, "beside")
        taken = parts.join(beside, KEY).groupBy("img_id", "root").agg(F.max("beside").alias("to"))
        joined = parts.join(taken, ["img_id", "root"]).select(*KEY, "to")
        at = written(at.join(joined, KEY, "left").select(*KEY, "v", F.coalesce("to", "label").cast("int").alias("label")), "descent")
    return at.select(*KEY, "label")
