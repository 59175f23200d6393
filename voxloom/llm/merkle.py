"""A Merkle manifest of a table, with a proof for every row.

Leaves are hashed where they lie and only digests move. Positions in a branch come from ranges by (branch, id) and the ranges'
counts. A level is one aggregation: the children of a parent are spread over FANOUT columns by their slot (conditional
aggregates), which concatenated give the parent's hash. On the way down a node joins its parent's row, and the same columns
without its own slot are its siblings: left and right ones are appended to the parent's path. No task holds more than a run
of FANOUT nodes, however many leaves a branch has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = [f"slot{k}" for k in range(FANOUT)]


def digest(values: Sequence[Column]) -> Column:
    """sha256 of the values end to end; a null is `-`, others are preceded by their number of UTF-8 bytes and a colon."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def numbered(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """rows (a written table) with `at`, the position in its group from 0, and `n`, the group's size.

    Rows are dealt in ranges of (by, order); copies of a row, which can't be told apart, are dealt by where they lay. A range
    ranks its own rows, and what lies before it in the group comes from the ranges' counts.
    """
    dealt = rows.withColumn("_lay", F.monotonically_increasing_id()).repartitionByRange(by, *order, "_lay")
    dealt = written(dealt.drop("_lay").withColumn("_range", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(by)
    counts = dealt.groupBy(by, "_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    counts = counts.select(by, "_range", before.alias("_before"), F.sum("_rows").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order))
    ranked = dealt.withColumn("_k", inside).join(counts, [by, "_range"])
    return ranked.withColumn("at", F.col("_before") + F.col("_k") - 1).drop("_before", "_k", "_range")


def raised(nodes: DataFrame, by: str) -> list[DataFrame]:
    """The levels above nodes (by, at, n, hash): each has by, at, n, the FANOUT columns of its children, and hash. A group ends with its single node."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1:
        now = (levels[-1] if levels else nodes).where("n > 1")
        spread = [F.max(F.when(F.col("at") % FANOUT == k, F.col("hash"))).alias(c) for k, c in enumerate(SLOTS)]
        up = now.groupBy(by, F.expr(f"at div {FANOUT}").alias("up")).agg(F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n"), *spread)
        levels.append(written(up.select(by, F.col("up").alias("at"), "n", *SLOTS, F.sha2(F.concat_ws("", *SLOTS), 256).alias("hash")), "level"))
        most = -(-most // FANOUT)
    return levels


def lowered(nodes: DataFrame, levels: list[DataFrame], by: str, tops: DataFrame) -> DataFrame:
    """nodes with path, an array of (left, right) siblings from the node upwards, and subroot. tops: by, path and subroot of each group's single node."""
    slot = F.col("at") % FANOUT
    side = lambda own: F.concat_ws("", *[F.when(own(k), F.col(f"_{c}")) for k, c in enumerate(SLOTS)])
    step = F.struct(side(lambda k: slot > k).alias("left"), side(lambda k: slot < k).alias("right"))
    above = None
    for table in [*levels[::-1], nodes]:
        found = table.where("n = 1").join(tops, by)
        if above is not None:
            run = above.select(by, F.col("at").alias("_up"), *[F.col(c).alias(f"_{c}") for c in SLOTS], F.col("path").alias("_path"), "subroot")
            below = table.where("n > 1").withColumn("_up", F.expr(f"at div {FANOUT}")).join(run, [by, "_up"])
            found = found.unionByName(below.select(*[F.col(c) for c in table.columns], F.concat(F.array(step), "_path").alias("path"), "subroot"))
        above = found
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", branch_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a branch (a value of branch_col, null is one too and the first) ascend by id, null first; rows that repeat an
    id ascend by leaf, and of equal leaves each gets a place of its own. A run of FANOUT nodes, the last one of fewer, becomes their
    hash until one is left; a lone leaf stays itself, and the branches' subroots give the root in the same way. proof_sha256
    is the hash of all siblings up to the root, of none for a table of one row. folded_root comes from the proof and the leaf,
    which is that of the tampered row where 3 divides the CRC-32 of the id as text: A-Z of text_col in lower case. A null id
    isn't tampered, nor does tampering change a null text. Texts of any length are hashed whole; an empty table gives no
    rows; columns beyond the fields are ignored.
    """
    values = [F.col(f"`{c}`") for c in fields]
    tampered = [F.translate(v, UPPER, LOWER) if c == text_col else v for c, v in zip(fields, values)]
    hit = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    branch = F.coalesce(F.concat(F.lit("1"), F.col(branch_col).cast("string")), F.lit("0"))  # null before all others
    leaf = digest(values)
    leaves = written(docs.select(F.col(id_col).alias("doc_id"), branch.alias("branch"), leaf.alias("hash"), F.when(hit, digest(tampered)).alias("tampered")), "leaves")
    leaves = written(numbered(leaves, "branch", ["doc_id", "hash"]), "numbered")
    levels = raised(leaves, "branch")

    ends = [t.where("n = 1").select("branch", "hash") for t in (leaves, *levels)]
    subroots = ends[0]
    for t in ends[1:]:
        subroots = subroots.unionByName(t)
    subroots = written(numbered(written(subroots.withColumn("all", F.lit("all")), "subroots"), "all", ["branch"]), "subroots")
    top = raised(subroots, "all")
    last = (top[-1] if top else subroots).where("n = 1").select("hash").first()
    root = F.lit(last["hash"] if last else None).cast("string")
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = subroots.select("all").distinct().select("all", none.alias("path"), F.lit("").alias("subroot"))
    tops = lowered(subroots, top, "all", start).select("branch", "path", F.col("hash").alias("subroot"))

    placed = lowered(leaves, levels, "branch", tops)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "hash"), lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
    found = placed.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def merkle_sql(depth: int = 7, top: int = 3) -> str:
    """DuckDB SQL for trees of at most `depth` levels a branch and `top` levels above: FANOUT ** depth rows a branch."""
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    fields = lambda text: " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS)
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, y: xor(a // 256, tab.t[(xor(a, y) % 256) + 1])), 4294967295::BIGINT)"
    parts = [
        "tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(0, 256) r(i)))",
        f"leaves AS (SELECT doc_id, lang AS g, sha256({fields('text')}) AS h, CASE WHEN {crc} % 3 = 0 THEN sha256({fields(lower)}) END AS t FROM documents, tab)",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
    ]
    level = lambda to, of: f"{to} AS MATERIALIZED (SELECT g, i // {FANOUT} AS i, (max(n) + {FANOUT - 1}) // {FANOUT} AS n, list(h ORDER BY i) AS c, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {of} WHERE n > 1 GROUP BY g, i // {FANOUT})"
    parts += [level(f"a{k + 1}", f"a{k}") for k in range(depth)]
    ends = " UNION ALL ".join(f"SELECT g, h FROM a{k} WHERE n = 1" for k in range(depth + 1))
    parts += [f"ends AS ({ends})", "b0 AS MATERIALIZED (SELECT 1 AS g, g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM ends)"]
    parts += [level(f"b{k + 1}", f"b{k}") for k in range(top)]
    parts += ["roots AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{k} WHERE n = 1" for k in range(top + 1)) + ")"]
    joins, steps = [], []
    for name, at, levels in (("a", "l.i", depth), ("b", "s.i", top)):
        for k in range(levels):
            group = "l.g" if name == "a" else "1"
            joins.append(f"LEFT JOIN {name}{k + 1} {name}_{k} ON {name}_{k}.g IS NOT DISTINCT FROM {group} AND {name}_{k}.i = {at} // {FANOUT ** (k + 1)}")
            slot = f"(({at} // {FANOUT**k}) % {FANOUT})::INT"
            steps.append((f"coalesce(array_to_string({name}_{k}.c[1:{slot}], ''), '')", f"coalesce(array_to_string({name}_{k}.c[{slot} + 2:], ''), '')", f"{name}_{k}.c IS NULL"))
    proof = " || ".join(f"{a} || {b}" for a, b, _ in steps)
    parts.append(f"p0 AS (SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root, sha256({proof}) AS proof_sha256, coalesce(l.t, l.h) AS f, {', '.join(f'{a} AS a{k}, {b} AS b{k}, {n} AS n{k}' for k, (a, b, n) in enumerate(steps))} FROM a0 l JOIN b0 s ON s.lang IS NOT DISTINCT FROM l.g CROSS JOIN roots {' '.join(joins)})")
    parts += [f"p{k + 1} AS (SELECT * REPLACE (CASE WHEN n{k} THEN f ELSE sha256(a{k} || f || b{k}) END AS f) FROM p{k})" for k in range(len(steps))]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM p{len(steps)}"
