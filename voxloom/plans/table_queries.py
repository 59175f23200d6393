"""Queries of manifests, file names and files, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import KEY, volumes
from ..operators import prompts as P
from ..sources import manifests as N
from ..sources import tiff
from .cell_queries import SEG, seg
from .oracle import VOLUMES
from .shape_queries import _POINTS

K = "img_id, z, y, x"


def _names(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    name = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit("_"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")))
    images = s.select(F.col("s_nationkey").alias("folder"), F.concat(name, F.lit(".tif")).alias("name"))
    others = s.where("s_acctbal > 0").select(F.col("s_nationkey").alias("folder"), F.concat(F.lit("seg_"), name, F.lit("_final.tif")).alias("name"))
    return images, others


_NAME = "lpad(s_suppkey::VARCHAR, 5, '0') || '_' || lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g'))"


def _manifest(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_set("p_size")), lambda x: x.cast("string")), ", "), F.lit("]")).alias("thresholds"))
    return p.select("p_brand", N.number_list(F.col("thresholds")).alias("t")).select("p_brand", F.size("t").alias("n"), F.array_min("t").alias("low"), F.array_max("t").alias("high"))


def _round_trip(spark, sf):
    """Segmentations as TIFF files and back."""
    files = tiff.write(seg(spark, sf))

    def back(parts):
        import numpy as np
        import pandas as pd

        for part in parts:
            for img, content in zip(part["img_id"], part["content"]):
                for z, image in enumerate(tiff.pages(content)):
                    y, x = np.indices(image.shape)
                    yield pd.DataFrame({"img_id": img, "z": z, "y": y.ravel(), "x": x.ravel(), "label": image.ravel().astype(int)})

    return files.mapInPandas(back, "img_id int, z int, y int, x int, label int")


def _prompt_json(spark, sf):
    points = P.point_prompts(seg(spark, sf), "z", 3, 2)
    text = F.to_json(F.struct(F.array("px", "py").alias("point"), F.col("sign").alias("label"), F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("name")))
    return points.select("img_id", "slice", text.alias("prompt"))


QUERIES = {
    "align_exact": (lambda s, d: N.align_exact(*_names(s, d), "seg_", "_final"), f"SELECT {_NAME} AS key, {_NAME} || '.tif' AS image, 'seg_' || {_NAME} || '_final.tif' AS other FROM supplier WHERE s_acctbal > 0"),
    "align_sorted": (
        lambda s, d: N.align_sorted(*_names(s, d), "folder"),
        f"WITH a AS (SELECT s_nationkey AS folder, {_NAME} || '.tif' AS image, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_NAME}) AS k FROM supplier), b AS (SELECT s_nationkey AS folder, 'seg_' || {_NAME} || '_final.tif' AS other, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_NAME}) AS k FROM supplier WHERE s_acctbal > 0) SELECT * FROM a JOIN b USING (folder, k)",
    ),
    "matching_names": (
        lambda s, d: N.matching(_names(s, d)[1], "seg_0", "_final"),
        f"SELECT s_nationkey AS folder, 'seg_' || {_NAME} || '_final.tif' AS name, substr({_NAME}, 2) AS key FROM supplier WHERE s_acctbal > 0 AND starts_with({_NAME}, '0')",
    ),
    "batch_manifest": (_manifest, "SELECT p_brand, count(DISTINCT p_size)::INT AS n, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand"),
    "tiff_round_trip": (_round_trip, f"WITH {SEG} SELECT {K}, label FROM seg"),
    "prompt_json": (_prompt_json, f"""{_POINTS} SELECT img_id, slice, '{{"point":[' || px || ',' || py || '],"label":' || sign || ',"name":"class_' || class_id || '"}}' AS prompt FROM pts"""),
    "id_chunks": (lambda s, d: volumes(s, d).where("v > 0").select(*KEY, F.ceil(F.col("v") / 25).cast("int").alias("chunk")), f"WITH {VOLUMES} SELECT {K}, ceil(v / 25.0)::INT AS chunk FROM volumes WHERE v > 0"),
}
