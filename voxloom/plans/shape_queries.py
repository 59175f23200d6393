"""Queries of morphology, components, seeds, growth, prompts and fusion, with DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import KEY, photos, segments, volumes
from ..operators import cells as C
from ..operators import components as CC
from ..operators import distance as D
from ..operators import grow as G
from ..operators import holes as H
from ..operators import morphology as M
from ..operators import predict as I
from ..operators import prompts as P
from ..operators import seeds as S
from ..operators import surface as U
from .cell_queries import SECOND, SEG, second, seg
from .oracle import PHOTOS, VOLUMES, along, components, shifted
from .oracle import segments as seg_sql

K = "img_id, z, y, x"
LOW = 100


def mask(spark, sf, low=LOW):
    return volumes(spark, sf).withColumn("on", F.col("v") >= low)


def _on(df):
    return df.where("on").select(*KEY)


def _morph(steps: list[str], how: str, low=LOW) -> str:
    return _chain([(axes, how) for axes in steps], low)


def _chain(parts: list[tuple[str, str]], low=LOW) -> str:
    """Steps of (axes, how)."""
    out, name, test = [], "volumes", f"v >= {low}"
    for k, (axes, how) in enumerate(parts):
        out.append(shifted(f"s{k}", name, test, along(axes), how))
        out.append(f"r{k} AS (SELECT {K}, v, hit AS was FROM s{k})")
        name, test = f"r{k}", "was"
    return f"WITH {VOLUMES}, {', '.join(out)} SELECT {K} FROM {name} WHERE was"


def _boxed(reach: list[tuple[int, int, int]], how: str, low: int) -> str:
    return f"WITH {VOLUMES}, {shifted('b', 'volumes', f'v >= {low}', [o for o in reach if any(o)], how)} SELECT {K} FROM b WHERE hit"


A, O = "bool_and", "bool_or"  # noqa: E741
QUERIES: dict = {}
for _name in ("ball", "ball_XY", "ball_XZ", "ball_YZ", "X", "Y", "Z", "2XZ_1Y", "2XY_1Z", "2YZ_1X"):
    QUERIES[f"erode_{_name.removeprefix('ball_')}"] = (lambda s, d, n=_name: _on(M.erode(mask(s, d, 60), n)), _morph(M.FOOTPRINTS[_name], A, 60))
QUERIES |= {
    "erode_ball_twice": (lambda s, d: _on(M.erode(mask(s, d, 40), "ball", 2)), _chain([("zyx", A)] * 2, 40)),
    "erode_cube": (lambda s, d: _on(M.erode(mask(s, d), "cube")), f"WITH {VOLUMES} SELECT {K} FROM volumes WHERE v >= {LOW}"),
    "erode_cube3": (lambda s, d: _on(M.erode(mask(s, d, 40), "cube", size=3)), _boxed([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)], A, 40)),
    "erode_square2": (lambda s, d: _on(M.erode(mask(s, d, 60), "square", size=2)), _boxed([(0, b, c) for b in (-1, 0) for c in (-1, 0)], A, 60)),
    "dilate_square2": (lambda s, d: _on(M.dilate(mask(s, d, 200), "square", size=2)), _boxed([(0, b, c) for b in (0, 1) for c in (0, 1)], O, 200)),
    "dilate_ball": (lambda s, d: _on(M.dilate(mask(s, d, 200))), _chain([("zyx", O)], 200)),
    "open": (lambda s, d: _on(M.opened(mask(s, d, 60))), _chain([("zyx", A), ("zyx", O)], 60)),
    "close": (lambda s, d: _on(M.closed(mask(s, d, 180))), _chain([("zyx", O), ("zyx", A)], 180)),
    "close_iter": (lambda s, d: _on(M.closed(mask(s, d, 200), 2)), _chain([("zyx", O)] * 2 + [("zyx", A)] * 2, 200)),
}

_NEAR = "(SELECT p.img_id, p.z, p.y, p.x, p.v, p.label, max(q.label) AS hi, min(q.label) AS lo FROM {0} p CROSS JOIN (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx) JOIN {0} q ON q.img_id = p.img_id AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)"


def _cc(name: str, foreground: str, connectivity: int = 3) -> str:
    return components(name, foreground, connectivity)


FG = f"SELECT {K}, 1 AS value FROM volumes WHERE v >= 190"
RANK = "rk AS (SELECT img_id, root, size, row_number() OVER (PARTITION BY img_id ORDER BY size DESC, root) AS k FROM (SELECT img_id, root, count(*) AS size FROM cc GROUP BY ALL))"
CCV = f"WITH RECURSIVE {VOLUMES}, {_cc('cc', FG)}, {RANK}"


def parts(spark, sf, low=190, connectivity=3):
    return CC.components(volumes(spark, sf).where(F.col("v") >= low), connectivity)


def _gap(a: int, b: int, width: int, closing: int, contact: bool) -> str:
    def grown(name: str, test: str, how: list[str]) -> str:
        out, source = [], "m"
        for k, h in enumerate(how):
            out.append(shifted(f"{name}s{k}", source, test, along("zyx"), h))
            out.append(f"{name}{k} AS (SELECT {K}, a, b, hit AS was FROM {name}s{k})")
            source, test = f"{name}{k}", "was"
        return ", ".join(out)

    near = f", {grown('na', 'a', [O])}, {grown('nb', 'b', [O])}" if contact else ""
    join = f" JOIN na0 USING ({K}) JOIN nb0 USING ({K})" if contact else ""
    test = " OR (na0.was AND nb0.was)" if contact else ""
    w, c = width - 1, 2 * closing - 1
    return f"WITH {SEG}, m AS (SELECT {K}, label = {a} AS a, label = {b} AS b FROM seg), {grown('wa', 'a', [O] * width)}, {grown('wb', 'b', [O] * width)}, {grown('cl', 'a OR b', [O] * closing + [A] * closing)}{near} SELECT {K} FROM m JOIN wa{w} USING ({K}) JOIN wb{w} USING ({K}) JOIN cl{c} USING ({K}){join} WHERE ((wa{w}.was AND wb{w}.was AND cl{c}.was){test}) AND NOT m.a AND NOT m.b"


def _gaps(spark, sf, contact):
    m = seg(spark, sf).select(*KEY, (F.col("label") == 1).alias("a"), (F.col("label") == 4).alias("b"))
    return M.gap(m, 2, 1, contact)


QUERIES |= {
    "gap_between": (lambda s, d: _gaps(s, d, False), _gap(1, 4, 2, 1, False)),
    "gap_between_contact": (lambda s, d: _gaps(s, d, True), _gap(1, 4, 2, 1, True)),
    "label_dilate": (lambda s, d: M.dilate_labels(seg(s, d)).select(*KEY, "label"), f"WITH {SEG} SELECT {K}, hi AS label FROM {_NEAR.format('seg')}"),
    "label_erode": (lambda s, d: M.erode_labels(segments(volumes(s, d), 30)).select(*KEY, "label"), f"WITH {VOLUMES}, {seg_sql('volumes', 30)} SELECT {K}, CASE WHEN hi = lo THEN label ELSE 0 END AS label FROM {_NEAR.format('seg')}"),
    "label_open": (
        lambda s, d: M.dilate_labels(M.erode_labels(segments(volumes(s, d), 30))).select(*KEY, "label"),
        f"WITH {VOLUMES}, {seg_sql('volumes', 30)}, e AS MATERIALIZED (SELECT {K}, v, CASE WHEN hi = lo THEN label ELSE 0 END AS label FROM {_NEAR.format('seg')}) SELECT {K}, hi AS label FROM {_NEAR.format('e')}",
    ),
    "label_close": (
        lambda s, d: M.erode_labels(M.dilate_labels(seg(s, d))).select(*KEY, "label"),
        f"WITH {SEG}, e AS MATERIALIZED (SELECT {K}, v, hi AS label FROM {_NEAR.format('seg')}) SELECT {K}, CASE WHEN hi = lo THEN label ELSE 0 END AS label FROM {_NEAR.format('e')}",
    ),
    "label_dilate_one": (
        lambda s, d: M.one_label(seg(s, d), 2, M.dilate).select(*KEY, "label"),
        f"WITH {SEG}, e AS (SELECT {K}, v, CASE WHEN label = 2 THEN 1 ELSE 0 END AS label FROM seg), n AS (SELECT {K}, hi FROM {_NEAR.format('e')}) SELECT {K}, CASE WHEN label NOT IN (0, 2) THEN label WHEN hi = 1 THEN 2 ELSE 0 END AS label FROM seg JOIN n USING ({K})",
    ),
    # components
    "ccomp": (lambda s, d: parts(s, d).select(*KEY, "root"), f"WITH RECURSIVE {VOLUMES}, {_cc('cc', FG)} SELECT {K}, root FROM cc"),
    "ccomp_edges": (lambda s, d: parts(s, d, connectivity=2).select(*KEY, "root"), f"WITH RECURSIVE {VOLUMES}, {_cc('cc', FG, 2)} SELECT {K}, root FROM cc"),
    "ccomp_faces": (lambda s, d: parts(s, d, connectivity=1).select(*KEY, "root"), f"WITH RECURSIVE {VOLUMES}, {_cc('cc', FG, 1)} SELECT {K}, root FROM cc"),
    "ccomp_photo": (lambda s, d: CC.components(photos(s, d).where("v >= 150")).select(*KEY, "root"), f"WITH RECURSIVE {PHOTOS}, {_cc('cc', f'SELECT {K}, 1 AS value FROM photos WHERE v >= 150')} SELECT {K}, root FROM cc"),
    "ccomp_tiled": (lambda s, d: CC.components(volumes(s, d).where("v >= 190"), tile=5).select(*KEY, "root"), f"WITH RECURSIVE {VOLUMES}, {_cc('cc', FG)} SELECT {K}, root FROM cc"),
    "ccomp_sizes": (lambda s, d: CC.ranked(parts(s, d)).select("img_id", "rank", "size"), f"{CCV} SELECT img_id, k AS rank, size FROM rk"),
    "ccomp_topn": (lambda s, d: CC.relabelled(parts(s, d), 5), f"{CCV} SELECT {K}, k::INT AS label FROM cc JOIN rk USING (img_id, root) WHERE k <= 5"),
    "ccomp_minvol": (lambda s, d: CC.relabelled(parts(s, d), None, 4), f"{CCV} SELECT {K}, k::INT AS label FROM cc JOIN rk USING (img_id, root) WHERE size >= 4"),
    "ccomp_largest": (lambda s, d: CC.relabelled(parts(s, d), 1), f"{CCV} SELECT {K}, k::INT AS label FROM cc JOIN rk USING (img_id, root) WHERE k = 1"),
    "ccomp_keep": (lambda s, d: CC.relabelled(parts(s, d), 8, 3), f"{CCV} SELECT {K}, k::INT AS label FROM cc JOIN rk USING (img_id, root) WHERE k <= 8 AND size >= 3"),
    "union_ccomp": (
        lambda s, d: CC.relabelled(CC.components(C.merge_images(segments(volumes(s, d), 190), second(s, d), [1, 3], [2], 0).where("label > 0"))),
        f"WITH RECURSIVE {VOLUMES}, {seg_sql('volumes', 190)}, {_cc('cc', f'SELECT {K}, 1 AS value FROM seg WHERE label IN (1, 3) OR {SECOND} = 2')}, {RANK} SELECT {K}, k::INT AS label FROM cc JOIN rk USING (img_id, root)",
    ),
    "filter_components": (
        lambda s, d: CC.filtered(segments(volumes(s, d), 170), 3, 2),
        f"WITH RECURSIVE {VOLUMES}, {seg_sql('volumes', 170)}, {_cc('cc', f'SELECT {K}, label AS value FROM seg WHERE label > 0', 2)}, r AS (SELECT img_id, value, root, row_number() OVER (PARTITION BY img_id, value ORDER BY count(*) DESC, root) AS k, count(*) AS size FROM cc GROUP BY img_id, value, root) SELECT {K}, value::INT AS label FROM cc JOIN r USING (img_id, value, root) WHERE k <= 2 AND size >= 3",
    ),
    "split_label": (
        lambda s, d: CC.split_label(segments(volumes(s, d), 170), 2),
        f"WITH RECURSIVE {VOLUMES}, {seg_sql('volumes', 170)}, {_cc('cc', f'SELECT {K}, label AS value FROM seg WHERE label = 2', 2)}, {RANK}, t AS (SELECT img_id, max(label) AS top FROM seg GROUP BY img_id) SELECT {K}, coalesce(CASE WHEN k > 1 THEN top + k - 1 ELSE label END, label)::INT AS label FROM seg JOIN t USING (img_id) LEFT JOIN (SELECT {K}, k FROM cc JOIN rk USING (img_id, root)) q USING ({K})",
    ),
    "split_all": (
        lambda s, d: CC.split_all(segments(volumes(s, d), 170)),
        f"WITH RECURSIVE {VOLUMES}, {seg_sql('volumes', 170)}, {_cc('cc', f'SELECT {K}, label AS value FROM seg WHERE label > 0', 2)}, r AS (SELECT img_id, value, root, row_number() OVER (PARTITION BY img_id ORDER BY count(*) DESC, value, root) AS k FROM cc GROUP BY img_id, value, root) SELECT {K}, coalesce(k, 0)::INT AS label FROM seg LEFT JOIN (SELECT {K}, k FROM cc JOIN r USING (img_id, value, root)) q USING ({K})",
    ),
}


_HOLES = f"""WITH RECURSIVE {VOLUMES}, {seg_sql('volumes', 60)}, b AS (SELECT img_id, label AS value, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM seg WHERE label > 0 GROUP BY ALL),
rest AS MATERIALIZED (SELECT s.img_id, b.value, s.z, s.y, s.x, z IN (z0, z1) OR y IN (y0, y1) OR x IN (x0, x1) AS face FROM seg s JOIN b ON b.img_id = s.img_id AND s.label <> b.value AND z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1),
near AS MATERIALIZED (SELECT p.img_id, p.value, p.z, p.y, p.x, q.z AS z2, q.y AS y2, q.x AS x2 FROM rest p CROSS JOIN (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx) JOIN rest q ON q.img_id = p.img_id AND q.value = p.value AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx),
reached AS (SELECT img_id, value, z, y, x FROM rest WHERE face UNION SELECT n.img_id, n.value, z2, y2, x2 FROM reached r JOIN near n USING (img_id, value, z, y, x)),
h AS (SELECT {K}, max(value)::INT AS hole FROM rest ANTI JOIN reached USING (img_id, value, z, y, x) GROUP BY ALL)
SELECT {K}, greatest(label, coalesce(hole, 0)) AS label FROM seg LEFT JOIN h USING ({K})"""
_SMALL = f"""WITH RECURSIVE {VOLUMES}, seg AS MATERIALIZED (SELECT {K}, (v >= 80)::INT AS label FROM volumes), {components('cc', f'SELECT {K}, 1 AS value FROM seg WHERE label = 0', 1)},
n AS (SELECT img_id, root, count(*) AS n FROM cc GROUP BY ALL), w AS (SELECT img_id, count(*) AS cells FROM seg GROUP BY img_id),
h AS (SELECT {K} FROM cc JOIN n USING (img_id, root) JOIN w USING (img_id) WHERE n < 6 AND 4 * n < cells)
SELECT {K}, CASE WHEN h.img_id IS NOT NULL THEN 1 ELSE label END::INT AS label FROM seg LEFT JOIN h USING ({K})"""
QUERIES |= {
    "fill_holes": (lambda s, d: H.fill_holes(segments(volumes(s, d), 60)), _HOLES),
    "fill_small_holes": (lambda s, d: H.fill_small_holes(volumes(s, d).select(*KEY, (F.col("v") >= 80).cast("int").alias("label")), 6), _SMALL),
}

# growth: seeds are cells of at least 230, labelled by place
_SEEDED = f"seeded AS (SELECT {K}, v, CASE WHEN v >= 230 THEN (x + 3 * y + 7 * z) % 6 + 1 ELSE 0 END::INT AS label FROM volumes)"


def seeded(spark, sf):
    place = (F.col("x") + 3 * F.col("y") + 7 * F.col("z")) % 6 + 1
    return volumes(spark, sf).select(*KEY, "v", F.when(F.col("v") >= 230, place).otherwise(0).cast("int").alias("label"))


_BY = "(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)"


def _hops(tests: list[str], how: str = "max", ids: str = "", start: str = "seeded") -> tuple[str, str]:
    out, name = [], start
    agg = {"max": "max(q.label)", "min": "min(q.label)", "first": "arg_min(q.label, o.k)"}[how]
    only = f" AND q.label IN ({ids})" if ids else ""
    for k, test in enumerate(tests):
        offsets = "(VALUES (0,-1,0,0),(1,1,0,0),(2,0,-1,0),(3,0,1,0),(4,0,0,-1),(5,0,0,1)) o(k,dz,dy,dx)"
        out.append(f"""n{k} AS MATERIALIZED (SELECT p.img_id, p.z, p.y, p.x, {agg} AS near FROM {name} p CROSS JOIN {offsets} JOIN {name} q ON q.img_id = p.img_id AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx WHERE q.label > 0 AND p.label = 0{only} GROUP BY ALL),
h{k} AS MATERIALIZED (SELECT p.img_id, p.z, p.y, p.x, p.v, CASE WHEN p.label > 0 THEN p.label WHEN {test} THEN coalesce(near, 0) ELSE 0 END AS label FROM {name} p LEFT JOIN n{k} USING ({K}))""")
        name = f"h{k}"
    return ", ".join(out), name


def _grown(tests, how="max", ids=""):
    ctes, last = _hops(tests, how, ids)
    return f"WITH {VOLUMES}, {_SEEDED}, {ctes} SELECT {K}, label FROM {last}"


def _out(df):
    return df.select(*KEY, "label")


def _grow_log(spark, sf):
    _, log = G.grow(seeded(spark, sf), [180, 140], [2, 2], still=9)
    return spark.createDataFrame(log, "threshold int, hop int, grown long, reachable long")


def _log_sql() -> str:
    ctes, _ = _hops(["v >= 180"] * 2 + ["v >= 140"] * 2)
    rows = " UNION ALL ".join(f"SELECT {t} AS threshold, {k} AS hop, count(*) FILTER (label > 0) AS grown, count(*) FILTER (v >= {t} OR label > 0) AS reachable FROM h{i}" for i, (t, k) in enumerate([(180, 1), (180, 2), (140, 1), (140, 2)]))
    return f"WITH {VOLUMES}, {_SEEDED}, {ctes} {rows}"


_OVER = []
_prev = "seeded"
for _k in (2, 5):
    _OVER.append(f"w{_k} AS MATERIALIZED (SELECT p.img_id, p.z, p.y, p.x, p.v, CASE WHEN bool_or(q.label = {_k}) THEN {_k} ELSE p.label END AS label FROM {_prev} p CROSS JOIN (VALUES (0,0,0),{_BY}) o(dz,dy,dx) JOIN {_prev} q ON q.img_id = p.img_id AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.img_id, p.z, p.y, p.x, p.v, p.label)")
    _prev = f"w{_k}"
QUERIES |= {
    "grow_once_stop": (lambda s, d: _out(G.hop(seeded(s, d), F.col("v") >= 150)), _grown(["v >= 150"])),
    "grow_once_first": (lambda s, d: _out(G.hop(seeded(s, d), F.col("v") >= 150, "min")), _grown(["v >= 150"], "min")),
    "grow_once_overwrite": (lambda s, d: _out(G.overwrite(seeded(s, d), [2, 5])), f"WITH {VOLUMES}, {_SEEDED}, {', '.join(_OVER)} SELECT {K}, label FROM w5"),
    "grow_subset": (lambda s, d: _out(G.hop(seeded(s, d), F.col("v") >= 120, "max", [1, 4])), _grown(["v >= 120"], "max", "1, 4")),
    "grow_multi": (lambda s, d: _out(G.grow(seeded(s, d), [180, 140, 100], [2, 2, 1])[0]), _grown(["v >= 180"] * 2 + ["v >= 140"] * 2 + ["v >= 100"])),
    "grow_ids_boundary": (
        lambda s, d: _out(G.grow(seeded(s, d), [160, 100], [2, 2], ids=[1, 4], boundary=F.col("x") == 8)[0]),
        _grown(["v >= 160 AND p.x <> 8"] * 2 + ["v >= 100 AND p.x <> 8"] * 2, "max", "1, 4"),
    ),
    "grow_overwrite": (lambda s, d: _out(G.grow(seeded(s, d), [0], [1], "overwrite", ids=[2, 5])[0]), f"WITH {VOLUMES}, {_SEEDED}, {', '.join(_OVER)} SELECT {K}, label FROM w5"),
    "grow_upper": (lambda s, d: _out(G.grow(seeded(s, d), [180, 140], [1, 2], uppers=[200, 220])[0]), _grown(["v BETWEEN 180 AND 200"] + ["v BETWEEN 140 AND 220"] * 2)),
    "grow_log": (_grow_log, _log_sql()),
    "grow_final": (
        lambda s, d: C.reorder(_out(G.grow(seeded(s, d), [150], [3])[0])),
        _grown(["v >= 150"] * 3).replace(f"SELECT {K}, label FROM h2", f", r AS (SELECT img_id, label, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, label) AS k FROM (SELECT img_id, label, count(*) AS n FROM h2 WHERE label > 0 GROUP BY ALL)) SELECT {K}, coalesce(k, 0)::INT AS label FROM h2 LEFT JOIN r USING (img_id, label)").replace("  ,", ","),
    ),
    "descent_flood": (lambda s, d: _out(G.flood(seeded(s, d), 230, 150, 2, 2)), _grown(["v > 190"] * 2 + ["v > 150"] * 2, "first")),
    "grow_ball2": (
        lambda s, d: _ball2(seeded(s, d)),
        f"WITH {VOLUMES}, {_SEEDED} SELECT p.img_id, p.z, p.y, p.x, max(q.label) AS label FROM seeded p CROSS JOIN range(-2, 3) a(dz) CROSS JOIN range(-2, 3) b(dy) CROSS JOIN range(-2, 3) c(dx) JOIN seeded q ON q.img_id = p.img_id AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx WHERE dz * dz + dy * dy + dx * dx <= 4 GROUP BY ALL",
    ),
}


def _ball2(cells):
    """Labels dilated by a ball of radius 2; the highest wins."""
    reach = cells.where("label > 0").select("img_id", "label", *[F.col(a).alias(f"c{a}") for a in "zyx"])
    for a in "zyx":
        reach = reach.withColumn(f"d{a}", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    reach = reach.where("dz * dz + dy * dy + dx * dx <= 4").select("img_id", "label", *[(F.col(f"c{a}") + F.col(f"d{a}")).alias(a) for a in "zyx"])
    return CC.onto(cells, reach.groupBy(*KEY).agg(F.max("label").alias("label")))


# seeds
def _seed_sql(low: int, steps: int, top: int, op: str = ">=") -> str:
    ctes = _chain([("zyx", A)] * steps, low).replace(f"v >= {low}", f"v {op} {low}")
    at = ctes.rindex("SELECT")
    return f"{ctes[:at].replace('WITH ', 'WITH RECURSIVE ', 1)}, {components('cc', f'SELECT {K}, 1 AS value FROM r{steps - 1} WHERE was')}, {RANK} SELECT {K}, k::INT AS label FROM cc JOIN rk USING (img_id, root) WHERE k <= {top}"


def _sweep_sql(lows: list[int], erosions: int, top: int, out: str, op: str = ">=") -> str:
    """Components of every threshold and number of erosions; value tells them apart."""
    ctes, union = [], []
    for i, low in enumerate(lows):
        name, test = "volumes", f"v {op} {low}"
        union.append(f"SELECT {K}, {10 * i} AS value FROM volumes WHERE {test}")
        for k in range(erosions):
            ctes.append(shifted(f"t{i}{k}", name, test, along("zyx"), A))
            ctes.append(f"u{i}{k} AS (SELECT {K}, v, hit AS was FROM t{i}{k})")
            name, test = f"u{i}{k}", "was"
            union.append(f"SELECT {K}, {10 * i + k + 1} AS value FROM {name} WHERE was")
    rank = f"""rk AS (SELECT img_id, value, root, size, row_number() OVER (PARTITION BY img_id, value ORDER BY size DESC, root) AS rank FROM (SELECT img_id, value, root, count(*) AS size FROM cc GROUP BY ALL)),
swept AS (SELECT img_id, ({lows})[value // 10 + 1] AS low, (value % 10)::INT AS erosion, rank::INT AS rank, size FROM rk WHERE rank <= {top})"""
    return f"WITH RECURSIVE {VOLUMES}, {', '.join(ctes)}, {components('cc', ' UNION ALL '.join(union))}, {rank} {out}"


_LOG = "SELECT img_id, low, erosion, count(*) AS n_components, sum(size)::BIGINT AS cells, string_agg(size::VARCHAR, ',' ORDER BY rank) AS sizes FROM swept GROUP BY img_id, low, erosion"


def _children(cells, low):
    return CC.relabelled(CC.components(cells.where(F.col("v") >= low)), 12)


def _pair(spark, sf):
    from ..operators.components import written

    v = volumes(spark, sf)
    return written(_children(v, 180), "parents"), written(_children(v, 200), "children")


_LABELLED = lambda name, low: f"{components(name + 'c', f'SELECT {K}, 1 AS value FROM volumes WHERE v >= {low}')}, {name}k AS (SELECT img_id, root, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, root) AS k FROM (SELECT img_id, root, count(*) AS n FROM {name}c GROUP BY ALL)), {name} AS MATERIALIZED (SELECT {K}, k::INT AS label FROM {name}c JOIN {name}k USING (img_id, root) WHERE k <= 12)"
_SHARES = f"""WITH RECURSIVE {VOLUMES}, {_LABELLED('pa', 180)}, {_LABELLED('ch', 200)}, sz AS (SELECT img_id, label AS parent, count(*) AS size FROM pa GROUP BY ALL),
sh AS (SELECT p.img_id, p.label AS parent, c.label AS child, count(*) AS shared FROM pa p JOIN ch c USING ({K}) GROUP BY ALL),
ov AS (SELECT img_id, parent, child, shared, size, round(shared::DOUBLE / size, 6) * 100 AS share FROM sh JOIN sz USING (img_id, parent))"""
_RULE = f"""{_SHARES}, sn AS (SELECT *, count(*) OVER (PARTITION BY img_id, parent) AS n, sum(share) OVER (PARTITION BY img_id, parent) AS s FROM ov),
ru AS (SELECT *, (share > 1)::INT AS chosen FROM sn WHERE n >= 2 AND s >= 5), mx AS (SELECT img_id, max(label) AS most FROM pa GROUP BY img_id),
nu AS MATERIALIZED (SELECT img_id, parent, child, share, chosen, (CASE WHEN chosen = 1 THEN most + sum(chosen) OVER (PARTITION BY img_id ORDER BY parent, child) END)::INT AS dst FROM ru JOIN mx USING (img_id))"""


def _adaptive(spark, sf):
    return S.adaptive(volumes(spark, sf), 120, 2, 20)


QUERIES |= {
    "preview": (lambda s, d: S.seeds(volumes(s, d), 100, None, 1, 1_000_000), _seed_sql(100, 1, 1_000_000)),
    "seeds": (lambda s, d: S.seeds(volumes(s, d), 80, None, 2, 10), _seed_sql(80, 2, 10)),
    "seed_sweep": (lambda s, d: S.sweep(volumes(s, d), [100, 140], 1, 10), _sweep_sql([100, 140], 1, 10, "SELECT * FROM swept")),
    "seed_sweep_strict": (lambda s, d: S.sweep(volumes(s, d), [120], 1, 10, strict=True), _sweep_sql([120], 1, 10, "SELECT * FROM swept", ">")),
    "seed_log": (lambda s, d: S.seed_log(S.sweep(volumes(s, d), [100, 140], 1, 10)), _sweep_sql([100, 140], 1, 10, _LOG)),
    "adaptive_overlap": (lambda s, d: S.overlap_shares(*_pair(s, d)), f"{_SHARES} SELECT * FROM ov"),
    "adaptive_lineage_once": (lambda s, d: S.split_rule(*_pair(s, d), 0.01, 0.05).where("chosen").select("img_id", "parent", "child", "to"), f'{_RULE} SELECT img_id, parent, child, dst AS "to" FROM nu WHERE chosen = 1'),
    "adaptive_split_once": (
        lambda s, d: S.split_step(*_pair(s, d), 0.01, 0.05),
        f"{_RULE}, kept AS (SELECT {K}, label FROM pa ANTI JOIN (SELECT DISTINCT img_id, parent AS label FROM nu) g USING (img_id, label)), fr AS (SELECT c.img_id, c.z, c.y, c.x, max(dst) AS dst FROM ch c JOIN nu ON nu.img_id = c.img_id AND nu.child = c.label AND chosen = 1 GROUP BY ALL) SELECT {K}, coalesce(dst, label)::INT AS label FROM kept FULL JOIN fr USING ({K})",
    ),
    "adaptive_ero": (lambda s, d: _adaptive(s, d)[0], None),
    "adaptive_lineage": (lambda s, d: S.descendants(_adaptive(s, d)[1], 2), None),
    # prompts and fusion
    "sample_random": (lambda s, d: P.sample(seg(s, d).where("label > 0").select(*KEY, "label"), 5, ["label"]), f"WITH {SEG}, s AS (SELECT {K}, label, {{lot}} AS lot, {{cell}} AS cell FROM seg WHERE label > 0) SELECT {K}, label FROM s QUALIFY row_number() OVER (PARTITION BY img_id, label ORDER BY lot, cell) <= 5"),
    "sample_grid": (
        lambda s, d: P.sample_grid(seg(s, d)),
        f"WITH {SEG}, b AS (SELECT img_id, label, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM seg WHERE label > 0 GROUP BY ALL), s AS (SELECT {K}, label, (z - z0) * 2 // (z1 - z0 + 1) AS gz, (y - y0) * 2 // (y1 - y0 + 1) AS gy, (x - x0) * 2 // (x1 - x0 + 1) AS gx, {{lot}} AS lot, {{cell}} AS cell FROM seg JOIN b USING (img_id, label)) SELECT {K}, label FROM s QUALIFY row_number() OVER (PARTITION BY img_id, label, gz, gy, gx ORDER BY lot, cell) = 1",
    ),
    "prompt_points": (lambda s, d: P.point_prompts(seg(s, d), "z", 3, 2), "{points} SELECT * FROM pts"),
    "prompt_bbox": (lambda s, d: P.box_prompts(segments(volumes(s, d), 150)), f"WITH RECURSIVE {VOLUMES}, {seg_sql('volumes', 150)}, {components('cc', f'SELECT {K}, label * 100 + z AS value FROM seg WHERE label > 0')} SELECT img_id, z AS slice, (value // 100)::INT AS class_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM cc GROUP BY img_id, z, value, root"),
    "prompt_groups": (lambda s, d: P.prompt_groups(P.point_prompts(seg(s, d), "z", 3, 2)), "{points}, g AS (SELECT img_id, slice, class_id, count(*) AS n, string_agg(lpad(px::VARCHAR, 4, '0') || ' ' || lpad(py::VARCHAR, 4, '0') || ' ' || sign::VARCHAR, ';' ORDER BY lpad(px::VARCHAR, 4, '0') || ' ' || lpad(py::VARCHAR, 4, '0') || ' ' || sign::VARCHAR) AS points FROM pts GROUP BY ALL) SELECT *, min(n) OVER (PARTITION BY img_id, slice) = max(n) OVER (PARTITION BY img_id, slice) AS batch FROM g"),
    "prompt_lift": (lambda s, d: P.lift(P.point_prompts(seg(s, d), "z", 3, 2), "z"), "{points} SELECT img_id, slice AS z, py AS y, px AS x, class_id, sign FROM pts"),
    "validate_prompts": (lambda s, d: P.invalid_prompts(volumes(s, d).where("v >= 200").selectExpr("img_id", "z", "y + 5 as y", "x"), volumes(s, d)), f"WITH {VOLUMES} SELECT img_id, z, y + 5 AS y, x FROM volumes WHERE v >= 200 AND y + 5 > 15"),
    "mesh_vertices": (
        lambda s, d: P.mesh_vertices(segments(volumes(s, d), 150)),
        f"WITH {VOLUMES}, {seg_sql('volumes', 150)}, e AS (SELECT p.img_id, p.label AS a, q.label AS b, 2 * p.z + dz AS z2, 2 * p.y + dy AS y2, 2 * p.x + dx AS x2 FROM seg p CROSS JOIN (VALUES (1,0,0),(0,1,0),(0,0,1)) o(dz,dy,dx) JOIN seg q ON q.img_id = p.img_id AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.label <> q.label) SELECT img_id, a AS label, z2, y2, x2 FROM e WHERE a > 0 UNION ALL SELECT img_id, b, z2, y2, x2 FROM e WHERE b > 0",
    ),
}

_CELL = "((z::BIGINT * 1048576 + y) * 1048576 + x)"
_LOT = f"((({_CELL} % 1048573) * 2654435761) % 4294967296)"
_POINTS = f"""WITH {SEG}, own AS (SELECT *, label AS class_id FROM seg WHERE label > 0), cl AS (SELECT DISTINCT img_id, z, class_id FROM own),
yes AS (SELECT img_id, z, y, x, class_id FROM own QUALIFY row_number() OVER (PARTITION BY img_id, z, class_id ORDER BY {_LOT}, {_CELL}) <= 3),
oth AS (SELECT seg.img_id, seg.z, y, x, cl.class_id FROM seg JOIN cl ON cl.img_id = seg.img_id AND cl.z = seg.z WHERE label > 0 AND label <> cl.class_id),
neg AS (SELECT * FROM oth QUALIFY row_number() OVER (PARTITION BY img_id, z, class_id ORDER BY {_LOT}, {_CELL}) <= 2),
pts AS (SELECT img_id, z AS slice, class_id, x AS px, y AS py, 1 AS sign FROM yes UNION ALL SELECT img_id, z, class_id, x, y, 0 FROM neg)"""
QUERIES = {n: (q, sql and sql.replace("{points}", _POINTS).replace("{lot}", _LOT).replace("{cell}", _CELL)) for n, (q, sql) in QUERIES.items()}


def votes(spark, sf):
    """Three voters: the two segmentations, and the first mirrored along x."""
    a, b = seg(spark, sf).select(*KEY, "label"), second(spark, sf)
    return a.unionByName(b).unionByName(a.withColumn("x", 15 - F.col("x")))


_VOTES = f"{SEG}, votes AS (SELECT {K}, label FROM seg UNION ALL SELECT {K}, {SECOND} FROM seg UNION ALL SELECT img_id, z, y, 15 - x, label FROM seg)"
_ORDER = [3, 1, 2, 4, 5]
QUERIES |= {
    "vote_per_class": (lambda s, d: P.vote_per_class(votes(s, d), _ORDER), f"WITH {_VOTES}, h AS (SELECT {K}, label, list_position({_ORDER}, label) AS p FROM votes WHERE label > 0 GROUP BY {K}, label HAVING count(*) >= 2) SELECT {K}, arg_min(label, p) AS label FROM h WHERE p IS NOT NULL GROUP BY {K}"),
    "vote_majority": (lambda s, d: P.vote_majority(votes(s, d)), f"WITH {_VOTES}, c AS (SELECT {K}, label, count(*) AS n FROM votes GROUP BY ALL) SELECT {K}, label FROM c QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY n DESC, label) = 1"),
    "compose_first": (lambda s, d: P.compose(votes(s, d), _ORDER), f"WITH {_VOTES} SELECT {K}, arg_min(label, list_position({_ORDER}, label)) AS label FROM votes WHERE label > 0 GROUP BY {K}"),
    "compose_priority": (lambda s, d: P.compose(votes(s, d), _ORDER, last=True), f"WITH {_VOTES} SELECT {K}, arg_max(label, list_position({_ORDER}, label)) AS label FROM votes WHERE label > 0 GROUP BY {K}"),
    "paint_lowest": (lambda s, d: P.paint_lowest(votes(s, d).where("label > 0").withColumnRenamed("label", "class_id")), f"WITH {_VOTES} SELECT {K}, min(label) AS label FROM votes WHERE label > 0 GROUP BY {K}"),
}


def _grid_sql() -> str:
    """One erosion by each footprint at each threshold; value tells the cases apart."""
    cases = [(low, name) for name in ("ball", "ball_XY") for low in (60, 100)]
    ctes, union = [], []
    for i, (low, name) in enumerate(cases):
        ctes.append(shifted(f"t{i}", "volumes", f"v >= {low}", along(M.FOOTPRINTS[name][0]), A))
        union.append(f"SELECT {K}, {i} AS value FROM t{i} WHERE hit")
    rank = "rk AS (SELECT img_id, value, size, row_number() OVER (PARTITION BY img_id, value ORDER BY size DESC, root) AS rank FROM (SELECT img_id, value, root, count(*) AS size FROM cc GROUP BY ALL))"
    return f"WITH RECURSIVE {VOLUMES}, {', '.join(ctes)}, {components('cc', ' UNION ALL '.join(union))}, {rank} SELECT img_id, ({[c[0] for c in cases]})[value + 1] AS low, ({[c[1] for c in cases]})[value + 1] AS footprint, rank::INT AS rank, size FROM rk WHERE rank <= 6"


_NEAREST = f"SELECT p.img_id, p.z, p.y, p.x, coalesce(min((p.z - q.z) * (p.z - q.z) + (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)), 1099511627776)::BIGINT AS d FROM volumes p LEFT JOIN (SELECT * FROM volumes WHERE v < 60) q ON q.img_id = p.img_id GROUP BY ALL"
QUERIES |= {
    "seed_grid": (lambda s, d: S.grid(volumes(s, d), [60, 100], ["ball", "ball_XY"], 6).drop("erosion"), _grid_sql()),
    "seed_plot_series": (
        lambda s, d: S.plot_series(S.seed_log(S.sweep(volumes(s, d), [100, 140], 1, 10))),
        _sweep_sql([100, 140], 1, 10, f", lg AS ({_LOG}) SELECT img_id, 'volume' AS series, low, erosion, cells AS value FROM lg UNION ALL SELECT img_id, 'components', low, erosion, n_components FROM lg").replace(" , lg", ", lg"),
    ),
    "adaptive_thre": (lambda s, d: S.adaptive_by_threshold(volumes(s, d), [170, 190, 210], 0, 12)[0], None),
    "distance_squared": (lambda s, d: D.squared_distance(mask(s, d, 60)), f"WITH {VOLUMES} {_NEAREST}"),
    "edt_center": (lambda s, d: D.centres(mask(s, d, 60)), f"WITH {VOLUMES}, n AS ({_NEAREST}) SELECT img_id, z, y, x, d FROM n WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY d DESC, z, y, x) = 1"),
    "edge_band": (lambda s, d: D.squared_distance(mask(s, d, 60)).where("d > 0 and d < 9"), f"WITH {VOLUMES}, n AS ({_NEAREST}) SELECT * FROM n WHERE d > 0 AND d < 9"),
    "convex_hull": (lambda s, d: D.hulls(segments(volumes(s, d), 150)), None),
}

_FACES = " UNION ALL ".join(f"SELECT p.img_id, p.label, count(*) AS n FROM seg p LEFT JOIN seg q ON q.img_id = p.img_id AND q.z = p.z + {dz} AND q.y = p.y + {dy} AND q.x = p.x + {dx} WHERE p.label > 0 AND coalesce(q.label, 0) <> p.label GROUP BY ALL" for dz, dy, dx in along("zyx"))
QUERIES |= {
    "surface_area": (lambda s, d: U.faces(segments(volumes(s, d), 150)).groupBy("img_id", "label").agg(F.count("*").alias("faces")), f"WITH {VOLUMES}, {seg_sql('volumes', 150)} SELECT img_id, label, sum(n)::BIGINT AS faces FROM ({_FACES}) GROUP BY ALL"),
    "skeleton": (lambda s, d: U.skeleton(photos(s, d).withColumn("on", F.col("v") >= 115)), None),
    "predict_stub": (
        lambda s, d: I.infer(volumes(s, d), P.point_prompts(seg(s, d), "z", 3, 2), I.near_values()),
        f"{_POINTS} SELECT v.img_id, v.z, v.y, v.x, p.class_id FROM volumes v JOIN pts p ON p.img_id = v.img_id AND p.slice = v.z AND p.sign = 1 JOIN volumes c ON c.img_id = p.img_id AND c.z = p.slice AND c.y = p.py AND c.x = p.px LEFT JOIN pts g ON g.img_id = p.img_id AND g.slice = p.slice AND g.class_id = p.class_id AND g.sign = 0 WHERE abs(v.v - c.v) <= 10 AND (v.x - p.px) * (v.x - p.px) + (v.y - p.py) * (v.y - p.py) <= 16 GROUP BY v.img_id, v.z, v.y, v.x, p.class_id, p.px, p.py HAVING coalesce(min((v.x - g.px) * (v.x - g.px) + (v.y - g.py) * (v.y - g.py)), 1073741824) > (v.x - p.px) * (v.x - p.px) + (v.y - p.py) * (v.y - p.py)",
    ),
}
QUERIES["predict_stub"] = (QUERIES["predict_stub"][0], f"SELECT DISTINCT * FROM ({QUERIES['predict_stub'][1]})")


def _split_sql(i: int, pa: str, ch: str) -> str:
    """CTEs of one step of adaptive splitting without limits; at{i} has the new labels, nu{i} the splits."""
    return f"""sz{i} AS (SELECT img_id, label AS parent, count(*) AS size FROM {pa} GROUP BY ALL),
ov{i} AS (SELECT p.img_id, p.label AS parent, c.label AS child FROM {pa} p JOIN {ch} c USING ({K}) GROUP BY ALL),
ru{i} AS (SELECT * FROM ov{i} QUALIFY count(*) OVER (PARTITION BY img_id, parent) >= 2), mx{i} AS (SELECT img_id, max(label) AS most FROM {pa} GROUP BY img_id),
nu{i} AS MATERIALIZED (SELECT img_id, parent, child, (most + row_number() OVER (PARTITION BY img_id ORDER BY parent, child))::INT AS dst FROM ru{i} JOIN mx{i} USING (img_id)),
kp{i} AS (SELECT {K}, label FROM {pa} ANTI JOIN (SELECT DISTINCT img_id, parent AS label FROM nu{i}) g USING (img_id, label)),
fr{i} AS (SELECT c.img_id, c.z, c.y, c.x, max(dst) AS dst FROM {ch} c JOIN nu{i} n ON n.img_id = c.img_id AND n.child = c.label GROUP BY ALL),
at{i} AS MATERIALIZED (SELECT {K}, coalesce(dst, label)::INT AS label FROM kp{i} FULL JOIN fr{i} USING ({K}))"""


def _levels(masks: list[str], top: int) -> str:
    """CTEs le0, le1, ...: the `top` largest components of each mask (a query of cells), by size."""
    union = " UNION ALL ".join(f"SELECT {K}, {i} AS value FROM ({m})" for i, m in enumerate(masks))
    rank = f"rk AS (SELECT img_id, value, root, row_number() OVER (PARTITION BY img_id, value ORDER BY size DESC, root)::INT AS k FROM (SELECT img_id, value, root, count(*) AS size FROM cc GROUP BY ALL))"
    each = ", ".join(f"le{i} AS MATERIALIZED (SELECT {K}, k AS label FROM cc JOIN rk USING (img_id, value, root) WHERE value = {i} AND k <= {top})" for i in range(len(masks)))
    return f"{components('cc', union)}, {rank}, {each}"


_SORTED = f"r AS (SELECT img_id, label, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, label) AS k FROM (SELECT img_id, label, count(*) AS n FROM at2 GROUP BY ALL)) SELECT {K}, k::INT AS label FROM at2 JOIN r USING (img_id, label)"
_TWICE = f"{shifted('t0', 'volumes', 'v >= 120', along('zyx'), A)}, u0 AS (SELECT {K}, v, hit AS was FROM t0), {shifted('t1', 'u0', 'was', along('zyx'), A)}"
_ERO = f"WITH RECURSIVE {VOLUMES}, {_TWICE}, {_levels(['SELECT * FROM volumes WHERE v >= 120', 'SELECT * FROM t0 WHERE hit', 'SELECT * FROM t1 WHERE hit'], 20)}, {_split_sql(1, 'le0', 'le1')}, {_split_sql(2, 'at1', 'le2')}"
_THRE = f"WITH RECURSIVE {VOLUMES}, {_levels([f'SELECT * FROM volumes WHERE v >= {x}' for x in (170, 190, 210)], 12)}, {_split_sql(1, 'le0', 'le1')}, {_split_sql(2, 'at1', 'le2')}"
_LEAVES = "ln AS (SELECT img_id, parent, dst FROM nu1 UNION ALL SELECT img_id, parent, dst FROM nu2) SELECT DISTINCT a.img_id, a.parent AS root, coalesce(b.dst, a.dst) AS leaf FROM ln a LEFT JOIN ln b ON b.img_id = a.img_id AND b.parent = a.dst WHERE NOT EXISTS (SELECT 1 FROM ln c WHERE c.img_id = a.img_id AND c.dst = a.parent)"
for _name, _sql in (("adaptive_ero", f"{_ERO}, {_SORTED}"), ("adaptive_thre", f"{_THRE}, {_SORTED}"), ("adaptive_lineage", f"{_ERO}, {_LEAVES}")):
    QUERIES[_name] = (QUERIES[_name][0], _sql)
