"""DuckDB SQL for the tables of cells, and pieces from which the queries' SQL is put together."""

from __future__ import annotations

PHOTOS = """photos AS MATERIALIZED (SELECT (vec_id // 64)::INT AS img_id, 0 AS z, (vec_id % 64)::INT AS y, i::INT AS x, floor((embedding[i + 1]::DOUBLE + 1.0) * 127.5)::INT AS v FROM embeddings, range(0, 64) t(i))"""
VOLUMES = """sums AS (SELECT (l_orderkey // 2048)::INT AS img_id, (l_linenumber - 1)::INT AS z, (l_orderkey % 16)::INT AS y, (l_partkey % 16)::INT AS x, ((sum(l_quantity::BIGINT) * 5) // count(*))::INT AS q FROM lineitem GROUP BY ALL),
volumes AS MATERIALIZED (SELECT i.img_id, a.z::INT AS z, b.y::INT AS y, c.x::INT AS x, coalesce(q, 0)::INT AS v FROM (SELECT DISTINCT img_id FROM sums) i CROSS JOIN range(0, 7) a(z) CROSS JOIN range(0, 16) b(y) CROSS JOIN range(0, 16) c(x)
  LEFT JOIN sums s ON s.img_id = i.img_id AND s.z = a.z AND s.y = b.y AND s.x = c.x)"""


def segments(source: str, least: int = 100) -> str:
    return f"seg AS MATERIALIZED (SELECT img_id, z, y, x, v, CASE WHEN v >= {least} THEN (x // 4 + y // 4 + z) % 5 + 1 ELSE 0 END::INT AS label FROM {source})"


def shifted(name: str, source: str, test: str, reach: list[tuple[int, int, int]], how: str) -> str:
    """{name}: every cell of source with `hit`: the {how} (bool_and, bool_or, min, max) of test over the cell and its neighbours at `reach` that exist."""
    offsets = ", ".join(map(str, [(0, 0, 0), *reach]))
    return f"""{name}_t AS MATERIALIZED (SELECT *, ({test}) AS t FROM {source}),
{name}_n AS (SELECT p.img_id, p.z, p.y, p.x, {how}(q.t) AS hit FROM {name}_t p CROSS JOIN (VALUES {offsets}) o(dz, dy, dx) JOIN {name}_t q ON q.img_id = p.img_id AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL),
{name} AS MATERIALIZED (SELECT s.*, n.hit FROM {source} s JOIN {name}_n n USING (img_id, z, y, x))"""


AXIS = {"z": [(1, 0, 0), (-1, 0, 0)], "y": [(0, 1, 0), (0, -1, 0)], "x": [(0, 0, 1), (0, 0, -1)]}


def along(axes: str) -> list[tuple[int, int, int]]:
    return [o for a in axes for o in AXIS[a]]


def components(name: str, foreground: str, connectivity: int = 3) -> str:
    """{name}: img_id, z, y, x, root (the least cell number) of the rows of `foreground`; needs WITH RECURSIVE. `value` in foreground keeps unequal values apart."""
    b = 2**20
    return f"""{name}_f AS MATERIALIZED (SELECT *, (z::BIGINT * {b} + y) * {b} + x AS cell FROM ({foreground})),
{name}_o AS (SELECT (dz * {b} + dy) * {b} + dx AS d FROM range(-1, 2) a(dz), range(-1, 2) b(dy), range(-1, 2) c(dx) WHERE abs(dz) + abs(dy) + abs(dx) BETWEEN 1 AND {connectivity}),
{name}_e AS MATERIALIZED (SELECT p.img_id, p.value, p.cell AS a, q.cell AS b FROM {name}_f p CROSS JOIN {name}_o JOIN {name}_f q ON q.img_id = p.img_id AND q.cell = p.cell + d AND q.value = p.value),
{name}_c(img_id, value, cell, root) USING KEY (img_id, value, cell) AS (SELECT img_id, value, cell, cell FROM {name}_f
  UNION SELECT e.img_id, e.value, e.b, min(c.root) FROM {name}_c c JOIN {name}_e e ON c.img_id = e.img_id AND c.value = e.value AND c.cell = e.a JOIN recurring.{name}_c r ON r.img_id = e.img_id AND r.value = e.value AND r.cell = e.b WHERE c.root < r.root GROUP BY e.img_id, e.value, e.b),
{name} AS MATERIALIZED (SELECT f.*, c.root FROM {name}_f f JOIN {name}_c c USING (img_id, value, cell))"""
