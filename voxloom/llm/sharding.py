"""Shards by weighted rendezvous hashing.

Every shard bids -w / ln(u) for a row, where u in (0, 1) is a hash of the row's key and the shard's name; the highest
bid wins. A shard's bid doesn't depend on the other shards, so one more shard takes rows only into itself, in proportion
to its weight, and a removed one gives up only its own. Slots within a shard are numbered without gaps in two steps:
rows are ranked within (shard, bucket), and buckets are offset by running totals of at most shards * 4096 counts; no
task sees a whole shard. Built-in functions only; the texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
#: Hex digits of a bucket's name: 16 ** 3 buckets a shard.
BUCKET_DIGITS = 3


def bid(key: Column, shard: int, weight: float) -> Column:
    """52 bits of an MD5 of key and shard as u, and from it the shard's bid."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.ln((bits + 0.5) / float(2**52))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest bid; shards of weight 0 get no rows; of equal bids the larger shard number's."""
    bids = [F.struct(bid(key, i, w), F.lit(i)) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*bids) if len(bids) > 1 else bids[0]).getField("col2")


def rendezvous(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    weights: of shards 0, 1, ...; added: that of one more shard, for grown_shard. The key is doc_id as text, so rows that
    repeat a doc_id share a shard; a null doc_id counts as the empty key. size is the text's UTF-8 bytes plus 1, null
    texts have none. Slots run from 0 without gaps in each shard; which of several equal rows gets which of their slots
    is left open. An empty table gives no rows; other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32"))
    bucket = F.substring(F.md5(F.concat(key, F.lit("/"), F.col("text_crc32").cast("string"))), 1, BUCKET_DIGITS)
    rows = rows.select("*", winner(key, weights).alias("shard"), bucket.alias("bucket"))

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32")
    placed = rows.withColumn("grown_shard", winner(key, [*weights, added])).withColumn("rank", F.row_number().over(inside) - 1)
    placed = placed.join(F.broadcast(starts), ["shard", "bucket"])  # at most shards * 4096 rows
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def _duck_winner(n: int) -> str:
    bids = ", ".join(f"{{'b': 1.0::DOUBLE / -ln((('0x' || substr(md5(k || ':{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE), 's': {i}}}" for i in range(n))
    return f"(list_max([{bids}])).s"


#: CRC-32 byte by byte: the table of 256 entries comes from the polynomial, the fold is a list_reduce.
SHARD_SQL = f"""
WITH tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(0, 256) r(i))),
b AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, k, (strlen(b.t) + 1)::BIGINT AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(b.t)), '..'), lambda x: ('0x' || x)::BIGINT)),
            lambda a, y: xor(a // 256, tab.t[(xor(a, y) % 256) + 1])), 4294967295::BIGINT) AS text_crc32
      FROM b, tab),
d AS (SELECT doc_id, size, text_crc32, {_duck_winner(SHARDS)} AS shard, {_duck_winner(SHARDS + 1)} AS grown_shard, substr(md5(k || '/' || text_crc32::VARCHAR), 1, {BUCKET_DIGITS}) AS bucket FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM d
"""
