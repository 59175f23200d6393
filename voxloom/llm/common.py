"""Helpers that several operators share: tables in the shared folder, and text handling on Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one step of a Python task works on at a time; bounds the memory of a task whatever the rows are like.
SLICE_BYTES = 4_000_000
#: Spark's setting for the bytes of an Arrow batch, its default, and what tasks on texts get instead.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 3_800_000

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and Spark runs on one machine, as in tests, one folder for the application."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="voxloom-")
    return _own_folders[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Task = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freed(task: Task) -> Task:
    """task, after which its memory goes back to the system: a Python worker lives on, and later stages share the executor's memory with it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed below a block in use
            trim(0)

    return run


def in_arrow(df: DataFrame, task: Task, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with freed(task), in batches of BATCH_BYTES where the session has Spark's default.

    A batch lies in an executor's memory more than once, in Spark and in each worker, and with the default a file's whole
    share of texts is one. The setting stays with the session; how rows are batched doesn't bear on results.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(freed(task), schema)


def share(df: DataFrame, rows: int) -> float:
    """How many of `rows` rows of one key make it a heavy one: there are fewer than four heavy keys a partition."""
    return rows / (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 100


def joined(left: DataFrame, right: DataFrame, key: str, size: str, limit: float) -> DataFrame:
    """left.join(right, key) for right with one row a key and in `size` the number of left's rows of that key.

    Keys of more than `limit` rows are few (at most left's rows / limit): their rows stay where they lie and right's are
    broadcast. The others are dealt by the key, and no task gets more than `limit` rows of any.
    """
    heavy = F.broadcast(right.where(F.col(size) > limit))
    dealt = left.join(F.broadcast(right.where(F.col(size) > limit).select(key)), key, "left_anti").join(right.where(F.col(size) <= limit), key)
    return left.join(heavy, key).unionByName(dealt)


def salted(left: DataFrame, right: DataFrame, key: str, size: str, spread: str, limit: float, how: str = "inner") -> DataFrame:
    """As joined(), for right rows of any width: a heavy key's row is copied, and left's rows are dealt over the copies by a hash of `spread`. how: inner or left."""
    copies = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(limit))).cast("int")
    heavy = F.broadcast(right.where(F.col(size) > limit).select(key, copies.alias("_copies")))
    dealt = left.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    return dealt.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))), [key, "_salt"], how).drop("_salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of an Arrow batch in pieces of about `most` bytes of text; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = (np.cumsum(size) - size) // most
    cut = np.flatnonzero(np.diff(step)) + 1
    for a, b in zip([0, *cut], [*cut, len(size)]):
        yield batch.slice(int(a), int(b - a))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text, split at runs of ASCII white space: codes of all words in order, the distinct words, and where each text's words begin and end."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    starts = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64) - parts.offsets[0].as_py()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, starts


def words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """As coded_words(), the distinct words as a list."""
    codes, distinct, starts = coded_words(texts)
    return codes, distinct.to_pylist(), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
