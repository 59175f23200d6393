"""Exact duplicates by a distributed content sort.

The texts, without white space, are dealt out by sampled splitters (`repartitionByRange`) and sorted externally in each
range by their bytes, so that equal texts are neighbours; a row is a copy when its whole text equals that of the row before
it. Splitters compare the first HEAD characters, so rows in a sample stay small whatever the texts are.

Texts with a common head can't be told apart by a splitter. A head of more than a share of all rows is dealt over several
ranges, each of which sorts and compares its own rows. That changes where rows go, not what comes out: each run of equal
neighbours gives one row with its size and its best document, and the runs of such heads are joined across ranges. A range
finds its joined run again by the run's number, so no task gets all rows of a text.

Built-in functions only. The texts are shuffled once, and are normalised and hashed once, after the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HEAD = 64
SPACE = r"[\x20\x09-\x0D]+"
#: Characters of the original text that nearly always hold the head.
ENOUGH = 160


def head_of(text: Column) -> Column:
    """The first HEAD characters of the text without white space."""
    soon = F.substring(F.regexp_replace(F.substring(text, 1, ENOUGH), SPACE, ""), 1, HEAD)
    return F.when((F.char_length(soon) == HEAD) | (F.char_length(text) <= ENOUGH), soon).otherwise(F.substring(F.regexp_replace(text, SPACE, ""), 1, HEAD))


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Rows sorted in their ranges: doc_id, head, salt, is_dealt, sha, starts (a run of equal texts), run, best (the row's rank among equal texts), with carry also `row`."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    wide = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else text.alias("text")  # one copy of the text is shuffled
    rows = docs.select(wide, F.col(id_col).alias("doc_id"), head_of(text).alias("head"))
    counts = rows.groupBy("head").agg(F.count("*").alias("n"))
    shared = counts.where(F.col("n") > F.lit(docs.count() / (4 * parts) + 100)).select("head", F.lit(True).alias("is_dealt"))  # fewer than 4 * parts rows
    rows = rows.join(F.broadcast(shared), "head", "left").withColumn("is_dealt", F.coalesce("is_dealt", F.lit(False)))
    salt = F.when(F.col("is_dealt"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(0)
    dealt = rows.withColumn("salt", salt).repartitionByRange("head", "salt")
    text = F.coalesce(F.col("row").getField(text_col), F.lit("")) if carry else F.col("text")
    n_chars = F.char_length(text).cast("long")
    best = F.struct((-n_chars).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    dealt = dealt.select(*(["row"] if carry else []), "doc_id", "head", "salt", "is_dealt", F.regexp_replace(text, SPACE, "").alias("bare"), best.alias("best"))

    # The window's key is that of the ranges: no further shuffle.
    near = Window.partitionBy("head", "salt").orderBy("bare", "best")
    runs = dealt.withColumn("starts", ~F.col("bare").eqNullSafe(F.lag("bare").over(near))).withColumn("sha", F.sha2("bare", 256))
    return runs.withColumn("run", F.sum(F.col("starts").cast("long")).over(near.rowsBetween(Window.unboundedPreceding, 0))).drop("bare")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of `[\\x20\\x09-\\x0D]`; null is the empty text. The row with
    the most code points in its original text stays, then the smallest doc_id (null last). Of rows that repeat doc_id
    and text exactly one is kept. Texts of any length are compared whole. An empty table gives no rows; other columns are ignored.
    """
    run = Window.partitionBy("head", "salt", "run")
    runs = _sorted(docs, id_col, text_col, False).withColumns({"run_size": F.count("*").over(run), "whole": F.min("best").over(run)})
    runs = written(runs.withColumn("first", F.col("starts")).drop("starts"), "runs")  # narrow: no texts
    alone = runs.where(~F.col("is_dealt")).select("doc_id", F.col("whole.doc_id").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("first").alias("kept"), F.col("sha").alias("text_sha256"))

    dealt = runs.where("is_dealt").drop("whole")
    ends = dealt.where("first").select("head", "salt", "run", "sha", "run_size", F.struct("best.n", "best.none", "best.doc_id", "salt").alias("best"))
    joined = ends.groupBy("head", "sha").agg(F.sum("run_size").alias("group_size"), F.min("best").alias("whole"))
    found = ends.select("head", "salt", "run", "sha").join(joined, ["head", "sha"]).drop("sha")
    across = dealt.join(found, ["head", "salt", "run"]).select(
        "doc_id", F.col("whole.doc_id").alias("keep_id"), "group_size", (F.col("first") & (F.col("salt") == F.col("whole.salt"))).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(across)


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; cases as in exact_duplicates."""
    firsts = written(_sorted(docs, id_col, text_col, True).where("starts").drop("starts", "run"), "firsts")  # at most one row a text and range
    dealt = firsts.where("is_dealt")
    best = dealt.groupBy("head", "sha").agg(F.min(F.struct("best.n", "best.none", "best.doc_id", "salt")).alias("whole"))
    winners = best.select("head", "sha", F.col("whole.salt").alias("salt"))
    return firsts.where(~F.col("is_dealt")).select("row.*").unionByName(dealt.join(winners, ["head", "sha", "salt"], "left_semi").select("row.*"))


EXACT_SQL = r"""
WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER (PARTITION BY bare ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(bare) AS text_sha256
FROM b
"""
