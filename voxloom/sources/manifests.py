"""Batch manifests: CSV rows of parameters, one a file or image, with list cells as "[...]" text; and the pairing of files by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, lists: list[str] = []) -> DataFrame:
    """The manifest's rows; the columns in `lists` become arrays of whole numbers."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({c: number_list(F.col(c)) for c in lists})


def number_list(cell: Column) -> Column:
    """array<int> of "[1, 2]" or "1"; null for anything else."""
    return F.from_json(F.when(F.trim(cell).startswith("["), cell).otherwise(F.concat(F.lit("["), cell, F.lit("]"))), "array<int>")


def merged(row: Mapping[str, object], config: Mapping[str, object]) -> dict[str, object]:
    """Parameters of a row and of the run; a key that both give is an error."""
    row = {k: v for k, v in row.items() if v is not None}
    if both := sorted(set(row) & set(config)):
        raise ValueError(f"given in the manifest and in the config: {', '.join(both)}")
    return {**config, **row}


def run(rows: DataFrame, make: Callable[[Mapping[str, object]], str], at_once: int = 1) -> DataFrame:
    """Each row with output_folder and error from make(row), at_once of them at a time.

    A manifest is a list of runs, each of them a set of Spark jobs, so its rows come to the driver; one bad row doesn't end the batch.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql.types import StringType, StructField, StructType

    def one(row: Row) -> tuple:
        try:
            return (*row, make(row.asDict()), None)
        except Exception as e:  # noqa: BLE001  the row's error is its result
            return (*row, None, f"{type(e).__name__}: {e}")

    with ThreadPoolExecutor(at_once) as pool:
        out = list(pool.map(one, rows.toLocalIterator()))
    return rows.sparkSession.createDataFrame(out, StructType([*rows.schema.fields, StructField("output_folder", StringType()), StructField("error", StringType())]))


def key_of(name: Column, prefix: str = "", suffix: str = "") -> Column:
    """A file name without prefix, suffix and extension."""
    bare = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    bare = F.when(bare.startswith(prefix), F.substring(bare, F.lit(len(prefix) + 1), F.length(bare))).otherwise(bare) if prefix else bare
    return F.when(bare.endswith(suffix), F.substring(bare, F.lit(1), F.length(bare) - len(suffix))).otherwise(bare) if suffix else bare


def matching(names: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Names that begin with prefix and end, before the extension, with suffix; key is what stands between."""
    bare = F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")
    long_enough = F.length(bare) >= len(prefix) + len(suffix)
    return names.where(bare.startswith(prefix) & bare.endswith(suffix) & long_enough).withColumn("key", key_of(F.col("name"), prefix, suffix))


def align_exact(images: DataFrame, others: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """(key, image, other) of files whose names agree without the others' prefix and suffix."""
    a = images.select(key_of(F.col("name")).alias("key"), F.col("name").alias("image"))
    b = others.select(key_of(F.col("name"), prefix, suffix).alias("key"), F.col("name").alias("other"))
    return a.join(b, "key")


def align_sorted(images: DataFrame, others: DataFrame, group: str) -> DataFrame:
    """(group, k, image, other): the k-th image in name order of each group with the k-th other file."""
    k = F.row_number().over(Window.partitionBy(group).orderBy("name"))
    a = images.select(group, F.col("name").alias("image"), k.alias("k"))
    b = others.select(group, F.col("name").alias("other"), k.alias("k"))
    return a.join(b, [group, "k"])
