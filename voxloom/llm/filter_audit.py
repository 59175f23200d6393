"""What each filter of a chain removes, in every order of the filters.

Each text is looked at twice, where it lies. The first pass gives a narrow table: part, four flags and the text's SHA-256. A
counting Bloom filter over the digests tells which texts are surely unique: partial sums of its counters are the tasks'
sketches, and adding them up merges the sketches. In the second pass only texts whose counters all reached two are shuffled,
for the least id of each whole text. That table of repeats gives the narrow rows their fifth flag, rows are
counted by part and mask of failed filters, and all orders are read from those counts: a mask's rows go at its first filter.

The filter has CELLS_A_ROW counters for each row, in blocks of CELLS, so a row's counters lie in one block and a block is one
row of the broadcast table. Its size is bounded by MOST_BLOCKS (150 MB): from 2 ** 27 rows on it stays as it is and clears fewer
texts, until all texts are shuffled once, as in an exact deduplication. Results are exact at any size.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted, share, written

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
CELLS_A_ROW = 8
#: Counters of a block, 64 to a word of the broadcast table.
CELLS = 4096
MOST_BLOCKS = 1 << 18
#: Counters that a text has.
HASHES = 4


def flags(text: Column) -> list[Column]:
    """Whether a text fails A (under 50 words), B (100 * distinct words < 65 * words), C (100 * capitals > 5 * code points), D (holds any of #$%&*|)."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    size = F.char_length(text)
    capitals = size - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * size.cast("long"), text.rlike(r"[#$%&*|]")]


def _cells(digest: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a digest, and its HASHES counters there: 12 bits each of the digest's second half."""
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    return number(1, 15) % blocks, F.array(*[number(33 + 3 * i, 3) for i in range(HASHES)])


def repeated_cells(digests: DataFrame, blocks: int) -> DataFrame:
    """block, words: bit arrays of the counters that reached two, of blocks that have any."""
    block, cells = _cells(F.col("digest"), blocks)
    placed = digests.select(block.alias("block"), F.explode(F.array_distinct(cells)).alias("cell"))
    full = placed.groupBy("block", "cell").agg(F.count("*").alias("n")).where("n >= 2")
    bits = full.groupBy("block", F.expr("cell div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits"))
    listed = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # at most 64 words
    filled = F.transform(F.sequence(F.lit(0), F.lit(CELLS // 64 - 1)), lambda w: F.coalesce(F.element_at("listed", w.cast("long")), F.lit(0).cast("long")))
    return bits.groupBy("block").agg(listed.alias("listed")).select("block", filled.alias("words"))


def repeats(docs: DataFrame, digests: DataFrame, count: int) -> DataFrame:
    """digest, least, n of each text that several rows of docs (doc_id, text) have: least id (null: none) and rows. digests: those of all rows; count: how many."""
    blocks = min(MOST_BLOCKS, 1 + count * CELLS_A_ROW // CELLS)
    block, cells = _cells(F.col("digest"), blocks)
    keyed = docs.select("doc_id", "text", F.sha2("text", 256).alias("digest")).withColumn("block", block)
    maybe = keyed.join(F.broadcast(repeated_cells(digests, blocks)), "block")
    word = lambda c: F.get("words", F.shiftright(c, 6).cast("int"))
    maybe = maybe.where(F.forall(cells, lambda c: F.getbit(word(c), (c % 64).cast("int")) == 1))
    whole = maybe.groupBy("text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return whole.select(F.sha2("text", 256).alias("digest"), "least", "n")


def masks(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (bit i: fails the i-th filter), good, toxic, n: how many rows there are of each kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags(F.col("text")))), F.lit(0))
    narrow = written(rows.select("doc_id", "part", bits.cast("int").alias("mask"), F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row")), "flags")
    count = narrow.count()
    limit = share(narrow, count)
    again = written(repeats(rows.select("doc_id", "text"), narrow.select("digest"), count), "repeats")
    later = F.when(F.col("doc_id") > F.col("least"), 1 << 4).otherwise(0)
    flagged = salted(narrow, again, "digest", "n", "row", limit, how="left").select("doc_id", "part", (F.col("mask") + later).alias("mask"), "row")
    if labels is None:
        marked = flagged.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        seen = narrow.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
        yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias("good" if c == "quality" else c)
        known = labels.where("doc_id is not null").groupBy("doc_id").agg(yes("quality"), yes("toxic"))
        # Rows without an id have no label; they are dealt by their number so that they don't meet in one task.
        named = flagged.withColumn("_id", F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))).drop("doc_id")
        known = known.join(seen, "doc_id").select(F.struct("doc_id", F.lit(None).cast("long").alias("row")).alias("_id"), "good", "toxic", "n")
        marked = salted(named, known, "_id", "n", "row", limit, how="left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    return marked.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def _orders() -> Column:
    """All orders and their steps: filter_order, step, bit (the step's filter) and before (the mask of earlier filters)."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return F.expr(f"array({', '.join(steps)})")


def audit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order of the five filters and step, with zeros. A null text is empty and fails A; null parts are the
    part of the empty string. Filter E: the whole text is that of a row of a smaller id, in any part; rows of one id aren't smaller
    than each other, and a null id neither is smaller nor has a smaller one. Of several labels of an id, any that says 1 counts;
    null ids have none. shapley: 120 times a filter's mean removals over all orders. An empty table gives no rows; other
    columns are ignored, and texts of any length are compared whole.
    """
    kinds = masks(docs, labels, id_col, text_col, part_col)
    count = lambda m, of: F.coalesce(F.sum(F.when(F.col("mask") == m, of)), F.lit(0))
    every = range(1 << len(FILTERS))
    of = {"all": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    table = kinds.groupBy("part").agg(*[F.array(*[count(m, c) for m in every]).alias(f"_{name}") for name, c in of.items()])

    steps = table.select("*", F.explode(_orders()).alias("s")).select("part", "_all", "_good", "_toxic", "s.*")
    numbers = F.sequence(F.lit(0), F.lit(len(every) - 1))
    total = lambda name, holds, weight=lambda m: F.lit(1): F.aggregate(numbers, F.lit(0).cast("long"), lambda s, m: s + F.when(holds(m), F.get(f"_{name}", m) * weight(m)).otherwise(0))
    bit, before = F.col("bit"), F.col("before")
    fails, gone = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    now = lambda m: fails(m) & ~gone(m)
    first = lambda m: F.expr(str(factorial(len(FILTERS)))) / F.bit_count(m)  # noqa: E731  orders in which a given one of a mask's filters comes first
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("all", now).alias("removed"),
        total("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("all", lambda m: m == bit).alias("unique_fails"),
        total("good", now).alias("good_lost"),
        total("toxic", now).alias("toxic_lost"),
        total("all", fails, lambda m: first(m).cast("long")).alias("shapley"),
    )


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, p.bit, coalesce((SELECT sum(q.bit) FROM x q WHERE contains(filter_order[1:step - 1], q.name)), 0)::INT AS before
      FROM o, range(1, 6) r(step), x p WHERE p.name = filter_order[step]),
c AS (SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM c
"""
