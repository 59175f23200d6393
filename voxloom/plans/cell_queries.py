"""Queries of the operators on cells, with DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import thresholds as T
from ..model import KEY, photos, segments, volumes
from ..operators import cells as C
from .oracle import PHOTOS, VOLUMES
from .oracle import segments as seg_sql

K = "img_id, z, y, x"
SEG = f"{VOLUMES}, {seg_sql('volumes')}"
SECOND = "CASE WHEN v >= 120 THEN (x // 5 + y // 3) % 4 + 1 ELSE 0 END::INT"


def seg(spark, sf):
    return segments(volumes(spark, sf))


def second(spark, sf):
    """Another segmentation of the volumes, to meet the first."""
    block = (F.expr("x div 5") + F.expr("y div 3")) % 4 + 1
    return volumes(spark, sf).select(*KEY, F.when(F.col("v") >= 120, block).otherwise(0).cast("int").alias("label"))


def boundary(spark, sf):
    return volumes(spark, sf).where("x = 8")


CLASSES, SCHEME = {1: "bone", 2: "shell", 3: "bone", 9: "none"}, ["shell", "bone"]
CENTRES = "SELECT (ps // 20)::INT AS img_id, ps % 37 % 40 AS cy, p_partkey * 7 % 40 AS cx, 3 + p_size % 5 AS r, 100 + p_size AS peak FROM (SELECT *, p_partkey::INT AS ps FROM part)"


def centres(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.selectExpr("cast(p_partkey div 20 as int) img_id", "cast(p_partkey % 37 % 40 as int) cy", "cast(p_partkey * 7 % 40 as int) cx", "cast(3 + p_size % 5 as int) r", "cast(100 + p_size as int) peak")


_PAL = " ".join(f"WHEN {i} THEN {{}}[{i + 1}]" for i in range(7))


def _palette_sql() -> str:
    table = [(0, 0, 0), *C.PALETTE]
    at = "CASE WHEN label > 0 THEN (label - 1) % 6 + 1 ELSE 0 END"
    return ", ".join(f"([{', '.join(str(c[i]) for c in table)}])[{at} + 1] AS {n}" for i, n in enumerate("rgb"))


PAIRS = lambda base, low, high, n: f"""SELECT img_id, step, lower, upper FROM (SELECT img_id, step::INT AS step,
  floor(round(greatest(0.0::DOUBLE, least(255.0::DOUBLE, base * ({low[0]}::DOUBLE + {low[1] - low[0]}::DOUBLE * step / {float(n - 1)}::DOUBLE))), 6))::INT AS lower,
  floor(round(greatest(0.0::DOUBLE, least(255.0::DOUBLE, base * ({high[0]}::DOUBLE + {high[1] - high[0]}::DOUBLE * step / {float(n - 1)}::DOUBLE))), 6))::INT AS upper FROM ({base}), range(0, {n}) s(step)) WHERE lower < upper"""  # noqa: E731
OTSU = """hist AS (SELECT img_id, v, count(*) AS n FROM photos GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS n0, sum(v::BIGINT * n) OVER w AS s0, sum(n) OVER (PARTITION BY img_id) AS na, sum(v::BIGINT * n) OVER (PARTITION BY img_id) AS sa FROM hist WINDOW w AS (PARTITION BY img_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
btw AS (SELECT img_id, v, n0::DOUBLE * (na::DOUBLE - n0::DOUBLE) * (s0::DOUBLE / n0::DOUBLE - (sa::DOUBLE - s0::DOUBLE) / (na::DOUBLE - n0::DOUBLE)) * (s0::DOUBLE / n0::DOUBLE - (sa::DOUBLE - s0::DOUBLE) / (na::DOUBLE - n0::DOUBLE)) AS b FROM cum WHERE na > n0),
otsu AS (SELECT img_id, v AS threshold FROM btw QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY b DESC, v) = 1)"""
_pick = "CASE WHEN label IN {0} THEN {1} ELSE {2} END"

#: name -> (query, SQL)
QUERIES = {
    "scan_image": (photos, f"WITH {PHOTOS} SELECT * FROM photos"),
    "scan_volume": (volumes, f"WITH {VOLUMES} SELECT * FROM volumes"),
    "image_info": (lambda s, d: C.image_info(volumes(s, d)), f"WITH {VOLUMES} SELECT img_id, count(*) AS cells, min(v) AS low, max(v) AS high, round(avg(v::DOUBLE), 6) AS mean, round(stddev_pop(v::DOUBLE), 6) AS std FROM volumes GROUP BY img_id"),
    "label_info": (lambda s, d: C.label_info(seg(s, d)), f"WITH {SEG} SELECT img_id, label, count(*) AS size, min(v) AS low, max(v) AS high FROM seg WHERE label > 0 GROUP BY ALL"),
    "threshold_lower": (lambda s, d: C.threshold(photos(s, d), 140), f"WITH {PHOTOS} SELECT * FROM photos WHERE v >= 140"),
    "threshold_range": (lambda s, d: C.threshold(photos(s, d), 120, 150), f"WITH {PHOTOS} SELECT * FROM photos WHERE v BETWEEN 120 AND 150"),
    "threshold_strict": (lambda s, d: C.threshold(volumes(s, d), 150, strict=True), f"WITH {VOLUMES} SELECT * FROM volumes WHERE v > 150"),
    "boundary_mask": (lambda s, d: C.without_boundary(seg(s, d), boundary(s, d)), f"WITH {SEG} SELECT {K}, v, CASE WHEN x = 8 THEN 0 ELSE label END AS label FROM seg"),
    "keep_labels": (lambda s, d: C.keep_labels(seg(s, d), [1, 3]), f"WITH {SEG} SELECT {K}, v, {_pick.format('(1, 3)', 'label', '0')} AS label FROM seg"),
    "remove_labels": (lambda s, d: C.keep_labels(seg(s, d), [1, 3], keep=False), f"WITH {SEG} SELECT {K}, v, {_pick.format('(1, 3)', '0', 'label')} AS label FROM seg"),
    "set_label": (lambda s, d: C.set_label(seg(s, d), [2], 7), f"WITH {SEG} SELECT {K}, v, {_pick.format('(2)', '7', 'label')} AS label FROM seg"),
    "merge_labels": (lambda s, d: C.set_label(seg(s, d), [2, 4, 5], 2), f"WITH {SEG} SELECT {K}, v, {_pick.format('(2, 4, 5)', '2', 'label')} AS label FROM seg"),
    "map_classes": (lambda s, d: C.map_classes(seg(s, d), CLASSES, SCHEME), f"WITH {SEG} SELECT *, CASE label WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS class_id FROM seg"),
    "clean_image": (lambda s, d: C.clean_image(seg(s, d), [1, 2]), f"WITH {SEG} SELECT {K}, CASE WHEN label IN (1, 2) THEN 0 ELSE v END AS v, label FROM seg"),
    "crop": (lambda s, d: C.crop(volumes(s, d), {"z": (1, 5), "y": (4, -1)}), f"WITH {VOLUMES} SELECT img_id, z - 1 AS z, y - 4 AS y, x, v FROM volumes WHERE z BETWEEN 1 AND 4 AND y >= 4"),
    "swap_axes": (lambda s, d: C.swap_axes(volumes(s, d), "z", "x"), f"WITH {VOLUMES} SELECT img_id, x AS z, y, z AS x, v FROM volumes"),
    "resample_block": (lambda s, d: C.block_mean(volumes(s, d), 2), f"WITH {VOLUMES} SELECT img_id, z // 2 AS z, y // 2 AS y, x // 2 AS x, (sum(v) // count(*))::INT AS v FROM volumes GROUP BY ALL"),
    "stride": (lambda s, d: C.stride(volumes(s, d), 3), f"WITH {VOLUMES} SELECT img_id, z // 3 AS z, y, x, v FROM volumes WHERE z % 3 = 0"),
    "blank_between": (lambda s, d: C.blank_between(volumes(s, d), 3), f"WITH {VOLUMES} SELECT {K}, CASE WHEN z % 3 = 0 THEN v ELSE 0 END AS v FROM volumes"),
    "slice_axis": (lambda s, d: C.slices(volumes(s, d), "y", 2, 9), f"WITH {VOLUMES} SELECT img_id, y AS slice, z AS \"row\", x AS col, v FROM volumes WHERE y BETWEEN 2 AND 8"),
    "background_mask": (lambda s, d: C.background(seg(s, d)), f"WITH {SEG} SELECT * FROM seg WHERE label = 0 AND v > 0"),
    "narrowed_labels": (lambda s, d: C.narrowed(seg(s, d)), f"WITH {SEG} SELECT s.*, dtype FROM seg s JOIN (SELECT img_id, CASE WHEN count(DISTINCT label) <= 255 THEN 'uint8' ELSE 'uint16' END AS dtype FROM seg GROUP BY img_id) USING (img_id)"),
    "has_labels": (lambda s, d: C.has_labels(segments(volumes(s, d), 230), [1, 5, 9]), f"WITH {VOLUMES}, {seg_sql('volumes', 230)} SELECT img_id, l::INT AS label, bool_or(label = l) AS present FROM seg, (VALUES (1), (5), (9)) t(l) GROUP BY ALL"),
    "palette": (lambda s, d: C.palette(seg(s, d)), f"WITH {SEG} SELECT {K}, {_palette_sql()} FROM seg"),
    "normalize_8bit": (lambda s, d: C.normalise_8bit(photos(s, d)), f"WITH {PHOTOS} SELECT {K}, CASE WHEN hi > lo THEN (v - lo) * 255 // (hi - lo) ELSE 0 END::INT AS v FROM (SELECT *, min(v) OVER (PARTITION BY img_id) AS lo, max(v) OVER (PARTITION BY img_id) AS hi FROM photos)"),
    "bbox": (
        lambda s, d: C.bounding_box(segments(volumes(s, d), 225), 1),
        f"WITH {VOLUMES}, {seg_sql('volumes', 225)}, e AS (SELECT img_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM seg GROUP BY img_id) SELECT s.img_id, greatest(min(z) - 1, any_value(z0)) AS z_low, greatest(min(y) - 1, any_value(y0)) AS y_low, greatest(min(x) - 1, any_value(x0)) AS x_low, least(max(z) + 1, any_value(z1)) AS z_high, least(max(y) + 1, any_value(y1)) AS y_high, least(max(x) + 1, any_value(x1)) AS x_high FROM seg s JOIN e USING (img_id) WHERE label > 0 GROUP BY s.img_id",
    ),
    "merge_images": (lambda s, d: C.merge_images(seg(s, d), second(s, d), [1, 2], [1, 4], 10), f"WITH {SEG} SELECT {K}, CASE WHEN label IN (1, 2) THEN label WHEN {SECOND} IN (1, 4) THEN {SECOND} + 10 ELSE 0 END AS label FROM seg"),
    "merge_into_empty": (lambda s, d: C.merge_images(seg(s, d), second(s, d), range(1, 6), range(1, 5), 20), f"WITH {SEG} SELECT {K}, CASE WHEN label > 0 THEN label WHEN {SECOND} > 0 THEN {SECOND} + 20 ELSE 0 END AS label FROM seg"),
    "overlap_map": (lambda s, d: C.overlaps(seg(s, d), second(s, d)), f"WITH {SEG} SELECT img_id, label AS a, {SECOND} AS b, count(*) AS size FROM seg WHERE label > 0 AND {SECOND} > 0 GROUP BY ALL"),
    "overlap_merge": (
        lambda s, d: C.merged_by_overlap(C.keep_labels(seg(s, d), [1]), second(s, d)),
        f"WITH {SEG}, o AS (SELECT DISTINCT img_id, label AS a, {SECOND} AS b FROM seg WHERE label = 1 AND {SECOND} > 0), t AS (SELECT img_id, a, min(b) AS lo FROM o GROUP BY ALL HAVING count(*) > 1), r AS (SELECT o.img_id, o.b, max_by(t.lo, t.a) AS dst FROM o JOIN t USING (img_id, a) GROUP BY ALL) SELECT s.img_id, z, y, x, coalesce(dst, {SECOND}) AS label FROM seg s LEFT JOIN r ON r.img_id = s.img_id AND r.b = {SECOND}",
    ),
    "reorder_labels": (lambda s, d: C.reorder(seg(s, d)), f"WITH {SEG}, r AS (SELECT img_id, label, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, label) AS k FROM (SELECT img_id, label, count(*) AS n FROM seg WHERE label > 0 GROUP BY ALL)) SELECT {K}, coalesce(k, 0)::INT AS label FROM seg LEFT JOIN r USING (img_id, label)"),
    "reorder_minsize": (
        lambda s, d: C.reorder(seg(s, d), least=130, renumber=False),
        f"WITH {SEG}, r AS (SELECT img_id, label, label AS k FROM seg WHERE label > 0 GROUP BY ALL HAVING count(*) >= 130) SELECT {K}, coalesce(k, 0)::INT AS label FROM seg LEFT JOIN r USING (img_id, label)",
    ),
    "reorder_topn": (
        lambda s, d: C.reorder(seg(s, d), top=3),
        f"WITH {SEG}, r AS (SELECT img_id, label, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, label) AS k FROM (SELECT img_id, label, count(*) AS n FROM seg WHERE label > 0 GROUP BY ALL) QUALIFY k <= 3) SELECT {K}, coalesce(k, 0)::INT AS label FROM seg LEFT JOIN r USING (img_id, label)",
    ),
    "keep_topn_labels": (
        lambda s, d: C.reorder(seg(s, d), top=2, renumber=False),
        f"WITH {SEG}, r AS (SELECT img_id, label, label AS k FROM (SELECT img_id, label, count(*) AS n FROM seg WHERE label > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY n DESC, label) <= 2) SELECT {K}, coalesce(k, 0)::INT AS label FROM seg LEFT JOIN r USING (img_id, label)",
    ),
    "stamp_ball": (lambda s, d: C.stamp(volumes(s, d).where("v >= 240"), 2), f"WITH {VOLUMES} SELECT DISTINCT img_id, z + dz::INT AS z, y + dy::INT AS y, x + dx::INT AS x FROM volumes, range(-2, 3) a(dz), range(-2, 3) b(dy), range(-2, 3) c(dx) WHERE v >= 240 AND dz * dz + dy * dy + dx * dx <= 4"),
    "stamp_disk": (lambda s, d: C.stamp(volumes(s, d).where("v >= 240"), 3, flat=True), f"WITH {VOLUMES} SELECT DISTINCT img_id, z, y + dy::INT AS y, x + dx::INT AS x FROM volumes, range(-3, 4) b(dy), range(-3, 4) c(dx) WHERE v >= 240 AND dy * dy + dx * dx <= 9"),
    "synth_blobs": (
        lambda s, d: C.demo_image(centres(s, d), 40),
        f"WITH c AS ({CENTRES}), g AS (SELECT img_id, y, x FROM (SELECT DISTINCT img_id FROM c), range(0, 40) a(y), range(0, 40) b(x)) SELECT g.img_id, 0 AS z, g.y::INT AS y, g.x::INT AS x, coalesce(max(CASE WHEN (g.y - cy) * (g.y - cy) + (g.x - cx) * (g.x - cx) <= 2 * r * r THEN greatest(0, peak - peak * ((g.y - cy) * (g.y - cy) + (g.x - cx) * (g.x - cx)) // (r * r)) END), 0)::INT AS v FROM g JOIN c USING (img_id) GROUP BY ALL",
    ),
    "otsu": (lambda s, d: T.otsu(photos(s, d)), f"WITH {PHOTOS}, {OTSU} SELECT * FROM otsu"),
    "otsu_list": (lambda s, d: T.threshold_list(T.otsu(photos(s, d)), 80, 120, 5), f"WITH {PHOTOS}, {OTSU} SELECT img_id, step::INT AS step, floor(round(threshold * 80 / 100.0::DOUBLE + threshold * 40 / 100.0::DOUBLE * step / 4, 6))::INT AS value FROM otsu, range(0, 5) r(step)"),
    "threshold_pairs_otsu": (lambda s, d: T.threshold_pairs(photos(s, d), "otsu_factor", (0.5, 1.0), (1.5, 1.2), 6), f"WITH {PHOTOS}, {OTSU} {PAIRS('SELECT img_id, threshold::DOUBLE AS base FROM otsu', (0.5, 1.0), (1.5, 1.2), 6)}"),
    "threshold_pairs_mean": (lambda s, d: T.threshold_pairs(photos(s, d), "mean_factor", (0.5, 1.0), (1.5, 1.2), 6), f"WITH {PHOTOS} {PAIRS('SELECT img_id, sum(v::BIGINT)::DOUBLE / count(*) AS base FROM photos GROUP BY img_id', (0.5, 1.0), (1.5, 1.2), 6)}"),
    "threshold_pairs_lower": (lambda s, d: T.threshold_pairs(photos(s, d), "otsu_factor", (0.5, 1.0), None, 6).where("upper is null").drop("upper"), f"WITH {PHOTOS}, {OTSU} SELECT img_id, step::INT AS step, floor(round(greatest(0.0::DOUBLE, least(255.0::DOUBLE, threshold::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * step / 5.0::DOUBLE))), 6))::INT AS lower FROM otsu, range(0, 6) s(step)"),
    "threshold_pairs_actual": (lambda s, d: T.threshold_pairs(photos(s, d), "actual_values", (100, 140), (300, 180), 5), f"WITH {PHOTOS} {PAIRS('SELECT DISTINCT img_id, 1.0::DOUBLE AS base FROM photos', (100, 140), (300, 180), 5)}"),
    "distinct_levels": (lambda s, d: T.distinct_levels(photos(s, d), 100, 150, 4), f"WITH {PHOTOS} SELECT img_id, v FROM (SELECT img_id, v, row_number() OVER (PARTITION BY img_id ORDER BY v) - 1 AS k FROM (SELECT DISTINCT img_id, v FROM photos WHERE v BETWEEN 100 AND 150)) WHERE k % 4 = 0"),
}
