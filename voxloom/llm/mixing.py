"""Mixing sources to target weights over a tree of domains, languages and sources.

The budget goes down the tree. A node's share of its parent's budget follows its weight among its siblings, up to what its
own subtree can give (its tokens times max_epochs); what it can't take goes to its siblings by their weights, and only what
a whole subtree can't take goes to the siblings of its ancestors. Each level is one window over the nodes (not the
documents): children in the order of capacity over weight, the first of them filled, the rest sharing what is left. Budgets
are whole tokens, so the children's sum is the parent's exactly. A node of weight 0 gets nothing: its subtree has nothing to
give, in a shortage too.

A leaf takes its documents in epochs, each in the order of a hash of seed, epoch and doc_id: whole epochs first, then the
longest prefix of the next one that fits in what is left. The prefix comes from running totals of 4096 buckets of the hash:
those that fit are taken whole where their rows lie, and only the one bucket that a leaf's budget cuts is dealt and sorted, so
no task sees a whole leaf and carried rows aren't shuffled but for these. Built-in functions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEED, MAX_EPOCHS = 17, 2
LEVELS = ("domain", "lang", "source")
#: Weights of the query; what isn't named has weight 1. Whole numbers.
DOMAIN_WEIGHTS = {"domain0": 2, "domain1": 3, "domain2": 1, "domain3": 4}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def words_and_end(text: Column) -> Column:
    """Tokens of a text: its words, and one for its end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def domain_of(source: Column) -> Column:
    """A source's domain. documents has no such column: here the number in its name modulo 4, else `other`."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string"))).otherwise("other")


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for key, w in sorted(weights.items()):
        out = F.when(F.col(name) == key, F.lit(w)).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parents: list[str], name: str, scale: int) -> DataFrame:
    """nodes: parents..., name, w, cap, budget (the parent's, no more than the sum of cap); budget becomes the node's own.

    scale is a multiple of all weights: cap * (scale / w) orders children by capacity over weight without rounding.
    """
    order = [F.expr(f"cap * ({scale} div w)"), F.col(name)]
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    upto, before, onward = (by.orderBy(*order).rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)))
    seen = nodes.withColumns({"given": F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest": F.sum("w").over(onward)})
    seen = seen.withColumn("full", (F.col("budget") - F.col("given")) * F.col("w") >= F.col("cap") * F.col("rest"))
    filled = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    seen = seen.withColumns({"left": F.col("budget") - filled, "open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0)), "sofar": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(upto), F.lit(0))})
    own = F.expr("case when full then cap else left * sofar div open - left * (sofar - w) div open end")
    return seen.select(*parents, name, own.alias("budget"))


def leaf_budgets(leaves: DataFrame, budget: int | None, max_epochs: int, domains: Mapping[str, int], languages: Mapping[str, int], sources: Mapping[str, int]) -> DataFrame:
    """leaves: domain, lang, source, supply. Adds each leaf's budget; a budget of None is the supply of all leaves."""
    weights = dict(zip(LEVELS, (domains, languages, sources)))
    for name, own in weights.items():
        if any(w < 0 or w != int(w) for w in own.values()):
            raise ValueError(f"weights of {name} must be whole numbers of at least 0: {dict(own)}")
    total = leaves.agg(F.sum("supply").alias("total"))
    caps = leaves.withColumn("cap", F.col("supply") * max_epochs)
    for name in LEVELS:
        caps = caps.where(_weight(name, weights[name]) > 0)
    top = caps.agg(F.sum("cap").alias("most")).join(F.broadcast(total)).select(F.least("most", "total" if budget is None else F.lit(budget)).alias("budget"))  # one row each
    nodes = None
    for k, name in enumerate(LEVELS):
        parents = list(LEVELS[:k])
        own = caps.groupBy(*parents, name).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(name, weights[name]))
        own = own.join(nodes, parents) if parents else own.join(F.broadcast(top))  # top is one row
        nodes = share_out(own, parents, name, math.lcm(1, *(w for w in weights[name].values() if w)))
    return leaves.join(nodes, list(LEVELS))


def mix(
    docs: DataFrame, budget: int | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS, domain: Column | None = None, tokens: Column | None = None,
    domains: Mapping[str, int] = DOMAIN_WEIGHTS, languages: Mapping[str, int] = LANGUAGE_WEIGHTS, sources: Mapping[str, int] = {}, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False,
) -> DataFrame:
    """One row for each epoch that takes a document: doc_id, domain, lang, source, n_tokens, epoch, leaf_budget.

    Null languages and sources are the nodes named by the empty text. Null texts have one token, their end; texts of any
    length count whole. Rows that repeat a doc_id are taken one by one, of equal places in the order those of fewer tokens
    first. A leaf of weight 0 (or under a node of weight 0) gives none. An empty table gives no rows; other columns are
    ignored, or with carry kept in the struct `row`.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
        F.col(id_col).alias("doc_id"),
        (domain_of(F.col(source_col)) if domain is None else domain).alias("domain"),
        blank(lang_col).alias("lang"),
        blank(source_col).alias("source"),
        (words_and_end(F.col(text_col)) if tokens is None else tokens).alias("n_tokens"),
    ).withColumn("domain", blank("domain"))
    leaf = list(LEVELS)
    if not carry:
        rows = written(rows, "tokens")  # narrow: no texts
    plan = leaf_budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("supply")), budget, max_epochs, domains, languages, sources)
    plan = plan.select(*leaf, F.col("budget").alias("leaf_budget"), F.expr("cast(budget div supply as int)").alias("whole"), (F.col("budget") % F.col("supply")).alias("part"))
    plan = written(plan, "leaves")
    hashed = lambda whole: F.md5(F.concat_ws(":", F.lit(str(seed)), whole.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    planned = rows.join(plan, leaf).withColumn("bucket", F.substring(hashed(F.col("whole")), 1, 3))

    totals = planned.groupBy(*leaf, "part", "bucket").agg(F.sum("n_tokens").alias("n"))
    # Running totals in two steps: of 16 parts of a leaf, then of a part's buckets.
    upto = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("part16", F.substring("bucket", 1, 1))
    of_parts = totals.groupBy(*leaf, "part16").agg(F.sum("n").alias("n")).withColumn("before", upto(leaf, "part16")).drop("n")
    starts = totals.withColumn("inside", upto([*leaf, "part16"], "bucket")).join(of_parts, [*leaf, "part16"]).withColumn("start", F.col("before") + F.col("inside")).where("start < part")
    ends = F.col("start") + F.col("n") <= F.col("part")
    last = starts.groupBy(*leaf).agg(F.max(F.when(ends, F.col("bucket"))).alias("last"), F.max(F.when(~ends, F.col("bucket"))).alias("cut"), F.max(F.when(~ends, F.col("start"))).alias("start"))
    plan = written(plan.join(last, leaf, "left"), "leaves")

    # Whole buckets go where their rows lie; only the one that a leaf's budget cuts is dealt and sorted.
    planned = rows.join(plan, leaf).withColumn("key", hashed(F.col("whole"))).withColumn("bucket", F.substring("key", 1, 3))
    most = F.col("whole") + F.coalesce((F.col("bucket") <= F.col("last")).cast("int"), F.lit(0))
    whole = planned.withColumn("most", most).withColumn("epoch", F.explode(F.expr("case when most > 0 then sequence(0, most - 1) else array() end")))
    inside = Window.partitionBy(*leaf, "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    first = planned.where("bucket = cut").withColumn("upto", F.col("start") + F.sum("n_tokens").over(inside)).where("upto <= part")
    columns = [*(["row"] if carry else []), "doc_id", *leaf, "n_tokens", "epoch", "leaf_budget"]
    return whole.select(columns).unionByName(first.withColumn("epoch", F.col("whole")).select(columns))


def _case(name: str, weights: Mapping[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _share_sql(to: str, source: str, parents: str, name: str, scale: int) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    pre = f"{parents}, " if parents else ""
    return f"""
{to}a AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS given,
    (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM {source} WINDOW o AS ({by} ORDER BY cap * ({scale} // w), {name})),
{to}b AS (SELECT *, (budget - given) * w >= cap * rest AS is_full FROM {to}a),
{to}c AS (SELECT *, (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0))::BIGINT AS rem, coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER ({by}), 0)::BIGINT AS open_w,
    coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER ({by} ORDER BY cap * ({scale} // w), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS sofar FROM {to}b),
{to} AS (SELECT {pre}{name}, CASE WHEN is_full THEN cap ELSE rem * sofar // open_w - rem * (sofar - w) // open_w END AS budget FROM {to}c)"""


MIX_SQL = f"""
WITH r AS (SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'domain' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 4)::VARCHAR ELSE 'other' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, (coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) + 1)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM r GROUP BY ALL),
n1 AS (SELECT domain, ({MAX_EPOCHS} * sum(supply))::BIGINT AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS w, (SELECT sum(supply)::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain),
{_share_sql("s1", "n1", "", "domain", math.lcm(*DOMAIN_WEIGHTS.values()))},
n2 AS (SELECT domain, lang, ({MAX_EPOCHS} * sum(supply))::BIGINT AS cap, {_case("lang", LANGUAGE_WEIGHTS)} AS w, any_value(s1.budget) AS budget FROM leaves JOIN s1 USING (domain) GROUP BY domain, lang),
{_share_sql("s2", "n2", "domain", "lang", math.lcm(*LANGUAGE_WEIGHTS.values()))},
n3 AS (SELECT domain, lang, source, ({MAX_EPOCHS} * sum(supply))::BIGINT AS cap, 1 AS w, any_value(s2.budget) AS budget FROM leaves JOIN s2 USING (domain, lang) GROUP BY domain, lang, source),
{_share_sql("s3", "n3", "domain, lang", "source", 1)},
p AS (SELECT r.*, s3.budget AS leaf_budget, (s3.budget // supply)::INT AS whole, s3.budget % supply AS part FROM r JOIN leaves USING (domain, lang, source) JOIN s3 USING (domain, lang, source)),
k AS (SELECT *, md5('{SEED}:' || whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM p),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole))::INT AS epoch, leaf_budget FROM p
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole, leaf_budget FROM c WHERE upto <= part
"""
