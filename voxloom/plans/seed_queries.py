"""Queries of growth to the end, descent, adaptive seeds under limits, parameter grids and prompts of volumes, with DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import segments, volumes
from ..operators import components as CC
from ..operators import distance as D
from ..operators import grow as G
from ..operators import holes as H
from ..operators import morphology as M
from ..operators import predict as I
from ..operators import prompts as P
from ..operators import seeds as S
from ..operators import surface as U
from .cell_queries import SEG, seg
from .oracle import VOLUMES, along, components, shifted
from .oracle import segments as seg_sql
from .shape_queries import QUERIES as SHAPES
from .shape_queries import _BY, _CELL, _LOT, _SEEDED, _SORTED, A, K, _hops, _levels, _out, _split_sql, seeded, votes

#: Hops that the SQL of growth to the end unrolls for each threshold; more than any of these images needs.
FAR = 40


def _to_end(spark, sf):
    return _out(G.grow(seeded(spark, sf), [180, 100])[0])


def _every(spark, sf):
    _, log = G.grow(seeded(spark, sf), [180, 140], [5, 6], every=[2, 3])
    return spark.createDataFrame(log, "threshold int, hop int, grown long, reachable long")


def _every_sql() -> str:
    ctes, _ = _hops(["v >= 180"] * 5 + ["v >= 140"] * 6)
    rows = " UNION ALL ".join(f"SELECT {t} AS threshold, {k} AS hop, count(*) FILTER (label > 0) AS grown, count(*) FILTER (v >= {t} OR label > 0) AS reachable FROM h{i}" for i, t, k in [(1, 180, 2), (3, 180, 4), (4, 180, 5), (7, 140, 3), (10, 140, 6)])
    return f"WITH {VOLUMES}, {_SEEDED}, {ctes} {rows}"


def _end_sql() -> str:
    ctes, last = _hops(["v >= 180"] * FAR + ["v >= 100"] * FAR)
    return f"WITH {VOLUMES}, {_SEEDED}, {ctes} SELECT {K}, label FROM {last}"


def _descent_sql(start: int, target: int, rounds: int, top: int, erosions: int = 0) -> str:
    """Free parts of every round by faces; each goes to the highest label that it touches."""
    ctes, name, test = [], "volumes", f"v > {start}"
    for k in range(erosions):
        ctes += [shifted(f"s{k}", name, test, along("zyx"), A), f"r{k} AS (SELECT {K}, v, hit AS was FROM s{k})"]
        name, test = f"r{k}", "was"
    ctes.append(components("cc", f"SELECT {K}, 1 AS value FROM {name} WHERE {test}", 1))
    ctes.append("rk AS (SELECT img_id, root, row_number() OVER (PARTITION BY img_id ORDER BY count(*) DESC, root)::INT AS k FROM cc GROUP BY img_id, root)")
    ctes.append(f"d0 AS MATERIALIZED (SELECT {K}, v, coalesce(k, 0) AS label FROM volumes LEFT JOIN (SELECT {K}, k FROM cc JOIN rk USING (img_id, root) WHERE k <= {top}) USING ({K}))")
    for i in range(rounds + 1):
        low = start + (target - start) * i // rounds
        ctes.append(components(f"f{i}", f"SELECT {K}, 1 AS value FROM d{i} WHERE label = 0 AND v > {low}", 1))
        ctes.append(f"t{i} AS (SELECT p.img_id, p.root, max(q.label) AS dst FROM f{i} p CROSS JOIN (VALUES {_BY}) o(dz, dy, dx) JOIN d{i} q ON q.img_id = p.img_id AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx WHERE q.label > 0 GROUP BY ALL)")
        ctes.append(f"d{i + 1} AS MATERIALIZED (SELECT {K}, v, coalesce(dst, label)::INT AS label FROM d{i} LEFT JOIN (SELECT {K}, dst FROM f{i} JOIN t{i} USING (img_id, root)) USING ({K}))")
    return f"WITH RECURSIVE {VOLUMES}, {', '.join(ctes)} SELECT {K}, label FROM d{rounds + 1}"


def _ero_sql(test: str, axes: list[str]) -> str:
    """Adaptive seeds of two erosions without limits."""
    steps = f"{shifted('t0', 'volumes', test, along(axes[0]), A)}, u0 AS (SELECT {K}, v, hit AS was FROM t0), {shifted('t1', 'u0', 'was', along(axes[1]), A)}"
    return f"WITH RECURSIVE {VOLUMES}, {steps}, {_levels([f'SELECT * FROM volumes WHERE {test}', 'SELECT * FROM t0 WHERE hit', 'SELECT * FROM t1 WHERE hit'], 20)}, {_split_sql(1, 'le0', 'le1')}, {_split_sql(2, 'at1', 'le2')}, {_SORTED}"


def _thre_sql(tests: list[str], axes: str) -> str:
    steps = ", ".join(shifted(f"t{i}", "volumes", t, along(axes), A) for i, t in enumerate(tests))
    return f"WITH RECURSIVE {VOLUMES}, {steps}, {_levels([f'SELECT * FROM t{i} WHERE hit' for i in range(len(tests))], 12)}, {_split_sql(1, 'le0', 'le1')}, {_split_sql(2, 'at1', 'le2')}, {_SORTED}"


_CASES = [(name, k, low, high) for name in ("ball", "X") for k in (1, 2) for low, high in ((60, 240), (100, 220))]


def _grid_sql() -> str:
    """Two erosions by each footprint between each pair of thresholds; value tells the cases apart."""
    ctes, union = [], []
    for i, (name, k, low, high) in enumerate(_CASES):
        source, test = "volumes", f"v BETWEEN {low} AND {high}"
        for j in range(k):
            ctes += [shifted(f"t{i}{j}", source, test, along(M.FOOTPRINTS[name][0]), A), f"u{i}{j} AS (SELECT {K}, v, hit AS was FROM t{i}{j})"]
            source, test = f"u{i}{j}", "was"
        union.append(f"SELECT {K}, {i} AS value FROM {source} WHERE was")
    rank = "rk AS (SELECT img_id, value, size, row_number() OVER (PARTITION BY img_id, value ORDER BY size DESC, root) AS rank FROM (SELECT img_id, value, root, count(*) AS size FROM cc GROUP BY ALL))"
    pick = lambda k: f"({[c[k] for c in _CASES]})[value + 1]"
    return f"WITH RECURSIVE {VOLUMES}, {', '.join(ctes)}, {components('cc', ' UNION ALL '.join(union))}, {rank} SELECT img_id, {pick(2)} AS low, {pick(0)} AS footprint, {pick(1)} AS erosion, rank::INT AS rank, size FROM rk WHERE rank <= 5"


def _means_sql(n: int, rounds: int) -> str:
    """Lloyd's steps on whole numbers."""
    ctes = [f"own AS (SELECT {K}, label, count(*) OVER (PARTITION BY img_id, label) AS size, row_number() OVER (PARTITION BY img_id, label ORDER BY {_LOT}, {_CELL})::INT AS k FROM seg WHERE label > 0)"]
    ctes.append(f"c0 AS MATERIALIZED (SELECT img_id, label, k, z::BIGINT * 1024 AS cz, y::BIGINT * 1024 AS cy, x::BIGINT * 1024 AS cx FROM own WHERE k <= {n})")
    for i in range(rounds):
        far = " + ".join(f"(o.{a} * 1024 - c{a}) * (o.{a} * 1024 - c{a})" for a in "zyx")
        ctes.append(f"n{i} AS (SELECT o.img_id, o.label, c.k, o.z, o.y, o.x FROM own o JOIN c{i} c USING (img_id, label) WHERE size > {n} QUALIFY row_number() OVER (PARTITION BY o.img_id, o.z, o.y, o.x ORDER BY {far}, c.k) = 1)")
        ctes.append(f"m{i} AS (SELECT img_id, label, k, {', '.join(f'sum({a}) * 1024 // count(*) AS m{a}' for a in 'zyx')} FROM n{i} GROUP BY ALL)")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT img_id, label, k, {', '.join(f'coalesce(m{a}, c{a})::BIGINT AS c{a}' for a in 'zyx')} FROM c{i} LEFT JOIN m{i} USING (img_id, label, k))")
    return f"WITH {SEG}, {', '.join(ctes)} SELECT DISTINCT img_id, label, {', '.join(f'((c{a} + 512) // 1024)::INT AS {a}' for a in 'zyx')} FROM c{rounds}"


def _prompts(each: bool):
    settings = {1: {"n_pos": 6, "n_neg": 2}, 3: {"n_neg": 0}}
    return lambda s, d: P.volume_prompts(seg(s, d), 4, 3, "random", settings, each=each, nonzero=each)


def _prompts_sql(each: bool) -> str:
    draw = lambda by, of: f"row_number() OVER (PARTITION BY {by} ORDER BY {of}, {_CELL})"
    rows = lambda source, sign, kind: f"SELECT img_id, class_id, x, y, z, {sign} AS label, {kind} AS point_type, 'random' AS sample_method FROM {source}"
    nonzero = " AND v <> 0" if each else ""
    ctes = [
        "cl AS (SELECT DISTINCT img_id, label AS class_id, CASE WHEN label = 1 THEN 6 ELSE 4 END AS n_pos, CASE label WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 3 END AS n_neg FROM seg WHERE label > 0)",
        f"dr AS (SELECT *, {draw('img_id, label', _LOT)} AS k FROM seg WHERE label > 0)",
        "po AS (SELECT * FROM dr JOIN cl ON cl.img_id = dr.img_id AND class_id = label WHERE k <= n_pos)".replace("*", "dr.img_id, z, y, x, class_id"),
        f"bd AS (SELECT *, {draw('img_id', _LOT)} AS k FROM seg WHERE label = 0{nonzero})",
        "bg AS (SELECT bd.img_id, z, y, x, class_id FROM bd JOIN cl USING (img_id) WHERE k <= n_neg)",
        "ot AS (SELECT dr.img_id, z, y, x, class_id, label, n_neg, v FROM dr JOIN cl USING (img_id) WHERE label <> class_id)",
        f"ne AS (SELECT * FROM (SELECT *, {draw('img_id, class_id' + (', label' if each else ''), _LOT)} AS k FROM ot WHERE true{nonzero}) WHERE k <= n_neg)",
    ]
    kind = "'negative_class' || label" if each else "'negative_other'"
    return f"WITH {SEG}, {', '.join(ctes)} {rows('po', 'true', chr(39) + 'positive' + chr(39))} UNION ALL {rows('bg', 'false', chr(39) + 'negative_bg' + chr(39))} UNION ALL {rows('ne', 'false', kind)}"


def _each_sql() -> str:
    """Points of slices, with negative ones of every other class."""
    draw = lambda by: f"row_number() OVER (PARTITION BY img_id, z, {by} ORDER BY {_LOT}, {_CELL})"
    return f"""WITH {SEG}, cl AS (SELECT DISTINCT img_id, z, label AS class_id FROM seg WHERE label > 0), dr AS (SELECT *, {draw('label')} AS k FROM seg WHERE label > 0)
SELECT img_id, z AS slice, label AS class_id, x AS px, y AS py, 1 AS sign FROM dr WHERE k <= 3 UNION ALL
SELECT dr.img_id, dr.z, class_id, x, y, 0 FROM dr JOIN cl ON cl.img_id = dr.img_id AND cl.z = dr.z AND label <> class_id WHERE k <= 2"""


def _corners_sql() -> str:
    """Corners of the squares between a label's cells and others."""
    out = []
    for dz, dy, dx in along("zyx"):
        free = [(a, d) for a, d in zip("zyx", (dz, dy, dx))]
        place = ", ".join(f"2 * p.{a} + {d}" if d else f"2 * p.{a} + {'u' if k == min(i for i, f in enumerate(free) if not f[1]) else 'w'}" for k, (a, d) in enumerate(free))
        out.append(f"SELECT p.img_id, p.label, {place} FROM seg p LEFT JOIN seg q ON q.img_id = p.img_id AND q.z = p.z + {dz} AND q.y = p.y + {dy} AND q.x = p.x + {dx} CROSS JOIN (VALUES (-1), (1)) a(u) CROSS JOIN (VALUES (-1), (1)) b(w) WHERE p.label > 0 AND coalesce(q.label, 0) <> p.label")
    return f"WITH {VOLUMES}, {seg_sql('volumes', 150)}, c(img_id, label, z2, y2, x2) AS ({' UNION '.join(out)}) SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY label, z2, y2, x2) - 1 AS number FROM c"


def _small_sql(area: int, by_slice: bool) -> str:
    """Small parts of each label's complement, in the whole image or in each z slice."""
    value = "label_of * 1000 + z" if by_slice else "label_of * 1000"
    group = "img_id, z" if by_slice else "img_id"
    return f"""WITH RECURSIVE {VOLUMES}, {seg_sql('volumes', 90)}, lb AS (SELECT DISTINCT {group}, label AS label_of FROM seg WHERE label > 0),
{components('cc', f'SELECT {K}, {value} AS value FROM seg JOIN lb USING ({group}) WHERE label <> label_of', 1)},
n AS (SELECT img_id, value, root, count(*) AS n FROM cc GROUP BY ALL), w AS (SELECT {group}, count(*) AS cells FROM seg GROUP BY ALL),
h AS (SELECT img_id, z, y, x, max(value // 1000)::INT AS hole FROM cc JOIN n USING (img_id, value, root) JOIN w USING ({group}) WHERE n < {area} AND 4 * n < cells GROUP BY ALL)
SELECT {K}, coalesce(hole, label) AS label FROM seg LEFT JOIN h USING ({K})"""


def _split_top(keep: bool, only: bool) -> str:
    """Two largest components of label 2."""
    rest = "0" if only else "seg.label"
    new = f"CASE WHEN n = 1{' OR k = 1' if keep else ''} THEN 2 ELSE last + k - {int(keep)} END"
    return f"""WITH RECURSIVE {VOLUMES}, {seg_sql('volumes', 170)}, {components('cc', f'SELECT {K}, 1 AS value FROM seg WHERE label = 2', 2)},
r AS (SELECT img_id, root, row_number() OVER (PARTITION BY img_id ORDER BY count(*) DESC, root) AS k FROM cc GROUP BY img_id, root),
t AS (SELECT *, max(k) OVER (PARTITION BY img_id) AS n FROM r WHERE k <= 2), l AS (SELECT img_id, max(label) AS last FROM seg GROUP BY img_id),
q AS (SELECT {K}, k, n FROM cc JOIN t USING (img_id, root))
SELECT {K}, (CASE WHEN q.k IS NOT NULL THEN {new} WHEN seg.label = 2 THEN 0 ELSE {rest} END)::INT AS label FROM seg JOIN l USING (img_id) LEFT JOIN q USING ({K})"""


_NEAR = SHAPES["predict_stub"][1]

QUERIES = {
    "grow_to_end": (_to_end, _end_sql()),
    "grow_log_every": (_every, _every_sql()),
    "descent": (lambda s, d: S.descent(volumes(s, d), 215, 185, 2, 2), _descent_sql(215, 185, 2, 2)),
    "descent_eroded": (lambda s, d: S.descent(volumes(s, d), 40, 30, 1, 2, erosions=2), _descent_sql(40, 30, 1, 2, 2)),
    "descent_uneven": (lambda s, d: S.descent(volumes(s, d), 225, 160, 3, 6), _descent_sql(225, 160, 3, 6)),
    "adaptive_boundary": (lambda s, d: S.adaptive(volumes(s, d), 120, 2, 20, boundary=F.col("x") == 8)[0], _ero_sql("v >= 120 AND x <> 8", ["zyx", "zyx"])),
    "adaptive_upper": (lambda s, d: S.adaptive(volumes(s, d), 100, 2, 20, high=225)[0], _ero_sql("v BETWEEN 100 AND 225", ["zyx", "zyx"])),
    "adaptive_footprints": (lambda s, d: S.adaptive(volumes(s, d), 110, 2, 20, footprints=["ball_XY", "X"])[0], _ero_sql("v >= 110", ["yx", "x"])),
    "adaptive_thre_limits": (
        lambda s, d: S.adaptive_by_threshold(volumes(s, d), [60, 90, 120], 1, 12, highs=[250, 240, 235], boundary=F.col("y") == 3, footprints="ball_XY")[0],
        _thre_sql([f"v BETWEEN {a} AND {b} AND y <> 3" for a, b in ((60, 250), (90, 240), (120, 235))], "yx"),
    ),
    "adaptive_hull": (lambda s, d: S.adaptive(volumes(s, d), 120, 2, 20, hull_limit=(20, 900))[0], None),
    "hull_volume": (lambda s, d: D.hull_volumes(seg(s, d)), None),
    "seed_grid_full": (lambda s, d: S.grid(volumes(s, d), [60, 100], ["ball", "X"], 5, 2, [240, 220]), _grid_sql()),
    "sample_kmeans": (lambda s, d: P.sample_kmeans(seg(s, d).where("label > 0"), 3, ["label"], 4), _means_sql(3, 4)),
    "prompts3d": (_prompts(False), _prompts_sql(False)),
    "prompts3d_each": (_prompts(True), _prompts_sql(True)),
    "predict_masks": (
        lambda s, d: I.infer_with(volumes(s, d), P.point_prompts(seg(s, d), "z", 3, 2), I.of_each(I.near_values(), I.near_values(20))),
        f"SELECT *, 0 AS mask FROM ({_NEAR}) UNION ALL SELECT *, 1 FROM ({_NEAR.replace('<= 10', '<= 20')})",
    ),
    "fill_small_holes_labels": (lambda s, d: H.fill_small_holes(_out(segments(volumes(s, d), 90)), 5), _small_sql(5, False)),
    "fill_small_holes_slices": (lambda s, d: H.fill_small_holes(_out(segments(volumes(s, d), 90)), 9, "z"), _small_sql(9, True)),
    "split_topn": (lambda s, d: CC.split_label(segments(volumes(s, d), 170), 2, 2), _split_top(True, False)),
    "split_only": (lambda s, d: CC.split_label(segments(volumes(s, d), 170), 2, 2, keep=False, only=True), _split_top(False, True)),
    "vote_majority_gated": (
        lambda s, d: P.vote_majority(votes(s, d), volumes(s, d), 90, 200),
        f"WITH m AS ({SHAPES['vote_majority'][1]}), {VOLUMES} SELECT {K}, (CASE WHEN v BETWEEN 90 AND 200 THEN label ELSE 0 END)::INT AS label FROM m JOIN volumes USING ({K})",
    ),
    "compose_ignoring": (lambda s, d: P.compose(votes(s, d), [3, 1, 2, 4, 5], ignore=[1, 4]), SHAPES["compose_first"][1].replace("WHERE label > 0", "WHERE label > 0 AND label NOT IN (1, 4)")),
    "mesh_numbered": (lambda s, d: U.numbered_vertices(U.faces(segments(volumes(s, d), 150))), _corners_sql()),
    "prompt_points_each": (lambda s, d: P.point_prompts(seg(s, d), "z", 3, 2, each=True), _each_sql()),
}
