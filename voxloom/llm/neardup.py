"""Near duplicates by SuperMinHash signatures, banding, verification on full sets, and components of the links.

SuperMinHash gives each shingle one random ranking of all signature components: rank j puts the value j + u, with a fresh
u in [0, 1), into the component that the ranking names, and a component keeps its least value. Ranks are correlated
across components, which lowers the variance of the estimate; a text is done as soon as every component has a value,
since later ranks can't lower any. The rankings are affine permutations of a prime number of components: any two
components get a uniform pair of ranks, on which alone the variance depends, and all shingles of a slice of texts take
their next rank at one step.

1. Per text, where it lies: the hashes of its distinct shingles, a fingerprint of the set, 30 bands of 5 components.
   Texts of one set are one class; only classes go on. A pair of similarity 0.8 misses all bands with probability 7e-6.
2. Every class is paired with the least class of each bucket; these pairs are verified on full sets. Components follow.
3. Buckets of three or more classes in several components are searched in full, in blocks of bounded size that compare
   only what is in a bucket and give back a spanning forest of the links found. Buckets with the same classes count once.
4. Components of all links; a class passes its component on to its rows.

No step emits all pairs of a bucket or holds a bucket in one task; the only tables that carry full sets are those of
classes that share a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, joined, mixed, salted, share, slices, words, written
from .graph import components

SHINGLE = 5
SIMILARITY = 80  # percent
BANDS, ROWS = 30, 5
#: The least prime that holds BANDS * ROWS components.
COMPONENTS = 151
#: Classes and shingles in a block, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles in ascending order, and where each text's begin and end.

    A-Z are lower-cased; words are split at ASCII white space; a text of fewer words is one shingle.
    """
    codes, tokens, starts = words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in tokens), "<u8")
    word = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(starts)
    h = np.zeros(len(word), np.uint64)
    for k in range(size):  # h[i] for the words i - size + 1 to i
        tail = np.zeros_like(h)
        tail[size - 1 :] = word[k : len(word) - size + 1 + k] if len(word) >= size else []
        h = mixed((h + np.uint64(k)) * _STEP + tail)
    out, ends = [], [0]
    for a, n in zip(starts[:-1], counts):
        if n >= size:
            own = np.unique(h[a + size - 1 : a + n])
        elif n:
            own = np.array([n], np.uint64)
            for w in word[a : a + n]:
                own = mixed(own * _STEP + w)
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.asarray(ends)


def signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SuperMinHash components by text: the rank in the top byte, u in the others. Empty texts have _NONE throughout."""
    p, n = COMPONENTS, len(ends) - 1
    text = np.repeat(np.arange(n), np.diff(ends))
    seed = mixed(hashes + np.uint64(1))
    step = (mixed(seed ^ _STEP) % np.uint64(p - 1)).astype(np.int64) + 1
    at = (mixed(seed + _STEP) % np.uint64(p)).astype(np.int64)
    flat = np.full(n * p, _NONE)
    signature = flat.reshape(n, p)
    for rank in range(p):
        if not len(text):
            break
        value = (np.uint64(rank) << np.uint64(56)) | (mixed(seed + np.uint64((rank + 2) * int(_STEP) % 2**64)) >> np.uint64(8))
        np.minimum.at(flat, text * p + at, value)
        at = (at + step) % p
        if rank % 4 == 1 or rank < 4:
            live = np.unique(text)
            open_ = np.zeros(n, bool)
            open_[live] = (signature[live] == _NONE).any(1)
            if not open_[live].all():
                keep = open_[text]
                text, seed, step, at = text[keep], seed[keep], step[keep], at[keep]
    return signature


def band_keys(signature: np.ndarray) -> np.ndarray:
    """By text and band, a hash of the band's components and its number."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        keys = mixed((keys + np.uint64(k)) * _STEP + signature[:, k : BANDS * ROWS : ROWS])
    return mixed(keys + np.arange(BANDS, dtype=np.uint64) * _STEP)


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def sketched(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, row, set (fingerprint), n_shingles, bands of rows (doc_id, row, text)."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, ends = shingles(part.column("text"), size)
                keys = band_keys(signatures(hashes, ends))
                bands = _lists(np.ascontiguousarray(keys).reshape(-1), np.arange(len(keys) + 1) * BANDS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(fingerprints(hashes, ends), pa.binary()), pa.array(np.diff(ends), pa.int64()), bands], names=["doc_id", "row", "set", "n_shingles", "bands"])

    return in_arrow(rows, sketch, "doc_id long, row long, set binary, n_shingles long, bands array<long>")


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """set (fingerprint) and items (its shingles' hashes) of rows (text)."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, ends = shingles(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(hashes, ends), pa.binary()), _lists(hashes, ends)], names=["set", "items"])

    return in_arrow(rows.select("text"), sets, "set binary, items array<long>")


def similar(shared, a, b, percent: int):
    """Whether sets of sizes a and b with `shared` common items are similar enough; for columns and arrays alike."""
    return 100 * shared >= percent * (a + b - shared)


def forest(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that span the components of all links between a set in `first` and one in `second` (masks)."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = found >= 2
    keep = common[column]
    owner, column = owner[keep], (np.cumsum(common) - 1)[column[keep]]
    shared = np.zeros((n, n), np.float32)
    width, by = 4096, np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    cuts = np.searchsorted(column, np.arange(0, int(common.sum()) + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        dense = np.zeros((n, width), np.float32)
        dense[owner[a:b], column[a:b] - k * width] = 1
        shared += dense @ dense.T
    link = similar(shared.astype(np.int64), sizes[:, None], sizes[None, :], percent)
    link &= (first[:, None] & second[None, :]) | (second[:, None] & first[None, :])
    np.fill_diagonal(link, True)
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label
        label = np.where(link, label[None, :], n).min(1)
    return [(i, int(x)) for i, x in enumerate(label) if i != x]


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of `size` words; sets with similarity of at least `percent` are linked, and
    component_id is the smallest doc_id reachable. Texts that are null or have no words have no shingles and no links. Rows
    that repeat doc_id and text each get a row. A row with a null doc_id links others like any row, but gives no component
    its name and has none itself. Shingles are compared by 64-bit hashes. Texts of any length are read whole. An empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row"), F.col(text_col).alias("text"))
    sketches = written(sketched(rows, size), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.count("*").alias("size"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")

    banded = classes.select("set", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("set").alias("pivot"), F.count("*").alias("members"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("sum")).where("members > 1")
    most = classes.agg(F.sum("size")).first()[0] or 0
    members = written(joined(banded, buckets, "band", "members", share(rows, BANDS * most)), "members")  # only of buckets with company

    wanted = members.select("set").distinct().join(classes.select("set", "row"), "set").select("row")
    texts = rows.join(wanted, "row", "left_semi")  # a row of each class; more only where rows repeat doc_id and text
    sets = written(full_sets(texts, size).groupBy("set").agg(F.first("items").alias("items")), "sets")

    pairs = written(members.where("set <> pivot").select("set", "pivot").distinct(), "pairs")
    left = pairs.join(sets, "set").withColumnRenamed("items", "a")
    pivots = pairs.groupBy("pivot").agg(F.count("*").alias("n")).join(sets.select(F.col("set").alias("pivot"), F.col("items").alias("b")), "pivot")
    both = salted(left, pivots, "pivot", "n", "set", share(rows, pairs.count()))
    shared = F.size(F.array_intersect("a", "b"))
    links = written(both.where(similar(shared, F.size("a"), F.size("b"), percent)).select(F.col("set").alias("u"), F.col("pivot").alias("v")), "links")
    found = components(links)

    placed = members.where("members > 2").join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    unsettled = placed.groupBy("members", "sum", "pivot", "band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    unsettled = unsettled.groupBy("members", "sum", "pivot").agg(F.min("band").alias("band")).select("band")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    searched = members.join(unsettled, "band").select("band", "set", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    searched = searched.join(sets, "set").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    searched = searched.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set", "block", "items")

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("set", ignore_index=True)
        _, low, high = key
        edges = forest([np.asarray(x, np.int64) for x in part["items"]], (part["block"] == low).to_numpy(), (part["block"] == high).to_numpy(), percent)
        names = part["set"]
        return pd.DataFrame({"u": [names[a] for a, _ in edges], "v": [names[b] for _, b in edges]})

    more = written(searched.groupBy("band", "low", "high").applyInPandas(search, "u binary, v binary"), "links")
    found = written(components(links.unionByName(more)) if more.take(1) else found, "components")

    roots = found.join(classes.select(F.col("set").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    linked = joined(found, written(roots, "roots"), "root", "n", share(rows, found.count())).select(F.col("node").alias("set"), "component_id")
    named = written(classes.join(linked, "set", "left").select("set", "size", F.coalesce("component_id", "low").alias("component_id")), "named")
    own = sketches.select("doc_id", "n_shingles", "set")
    result = joined(own.where("n_shingles > 0"), named, "set", "size", share(rows, sketches.count())).drop("size")
    result = result.unionByName(own.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
