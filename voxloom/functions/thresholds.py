"""Thresholds worked out from an image's histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def otsu(cells: DataFrame) -> DataFrame:
    """img_id, threshold: the least value that maximises the variance between the values up to it and those above, one bin a value."""
    counts = cells.groupBy("img_id", "v").agg(F.count("*").alias("n"))
    by = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img_id")
    s = F.col("v").cast("long") * F.col("n")
    seen = counts.withColumns({"n0": F.sum("n").over(by), "s0": F.sum(s).over(by), "n_all": F.sum("n").over(whole), "s_all": F.sum(s).over(whole)})
    d = lambda c: F.col(c).cast("double")
    apart = d("s0") / d("n0") - (d("s_all") - d("s0")) / (d("n_all") - d("n0"))
    seen = seen.where("n_all > n0").withColumn("between", d("n0") * (d("n_all") - d("n0")) * apart * apart)
    return seen.groupBy("img_id").agg(F.max_by("v", F.struct("between", (-F.col("v")).alias("back"))).alias("threshold"))


def threshold_list(base: DataFrame, low: int, high: int, n: int, ascending: bool = True) -> DataFrame:
    """n whole thresholds evenly from low to high percent of base (img_id, threshold): img_id, step, value."""
    at = F.col("step") if ascending else F.lit(n - 1) - F.col("step")
    value = F.expr(f"threshold * {low} / 100.0") + F.expr(f"threshold * {high - low} / 100.0") * at / max(n - 1, 1)
    return base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("img_id", "step", F.floor(F.round(value.cast("double"), 6)).cast("int").alias("value"))


def threshold_pairs(cells: DataFrame, mode: str, low: tuple[float, float], high: tuple[float, float] | None, n: int, least: int = 0, most: int = 255) -> DataFrame:
    """img_id, step, lower, upper: n pairs evenly between (first, last) factors of Otsu's threshold or of the mean, or values as they are; clipped to [least, most]. Without `high` upper is null. A pair whose lower end isn't below its upper one fails the query."""
    if mode == "otsu_factor":
        base = otsu(cells).select("img_id", F.col("threshold").cast("double").alias("base"))
    elif mode == "mean_factor":
        base = cells.groupBy("img_id").agg((F.sum(F.col("v").cast("long")) / F.count("*")).alias("base"))
    else:
        base = cells.select("img_id").distinct().withColumn("base", F.lit(1.0))
    step = lambda ends: F.lit(float(ends[0])) + F.lit(float(ends[1] - ends[0])) * F.col("step") / float(max(n - 1, 1))
    cut = lambda c: F.floor(F.round(F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.col("base") * c)), 6)).cast("int")
    rows = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if high is None:
        return rows.select("img_id", "step", cut(step(low)).alias("lower"), F.lit(None).cast("int").alias("upper"))
    rows = rows.select("img_id", "step", cut(step(low)).alias("lower"), cut(step(high)).alias("upper"))
    fault = F.raise_error(F.format_string("image %d, step %d: lower threshold %d isn't below upper threshold %d", "img_id", "step", "lower", "upper")).cast("int")
    return rows.select("img_id", "step", "lower", F.when(F.col("lower") < F.col("upper"), F.col("upper")).otherwise(fault).alias("upper"))


#: The ends of integer types.
RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 2**32 - 1), "int8": (-128, 127), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1)}


def distinct_levels(cells: DataFrame, low: int, high: int, every: int) -> DataFrame:
    """Every n-th distinct intensity of an image in [low, high], from the least."""
    levels = cells.where(F.col("v").between(low, high)).select("img_id", "v").distinct()
    number = F.row_number().over(Window.partitionBy("img_id").orderBy("v")) - 1
    return levels.withColumn("k", number).where(F.col("k") % every == 0).select("img_id", "v")
