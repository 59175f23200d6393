"""TIFF stacks of any size: a Spark data source that reads page by page, and a writer whose tasks put their pages into one file.

The driver reads the chain of page headers only. A partition is a run of pages, and a task reads the strips of one page after
another, so files beyond 2 GB (and BigTIFF files beyond 4 GB) need no more memory than a page. Conditions on z leave out pages
before any is read. Paths are those of pyarrow's file systems; the writer needs a folder that all executors share as files.

    spark.dataSource.register(TiffStack)
    spark.read.format("tiff_stack").load(path)
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.components import written
from .tiff import BITS, COMPRESSION, COUNTS, FORMAT, HEIGHT, PER_PIXEL, ROWS, STRIPS, TYPES, WIDTH, image_of

#: Bytes of pixels that a partition reads.
PARTITION = 64_000_000
#: Bytes of a file up to which offsets have four bytes.
CLASSIC = 4_000_000_000


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    system, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system.open_input_file(name)


def headers(file) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each page of an open TIFF or BigTIFF file; pixels aren't read."""
    start = file.read(16)
    end = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack(end + "H", start[2:4])[0] if end else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    count_of, link_of, entry = (end + "Q", end + "Q", 20) if big else (end + "H", end + "I", 12)
    at = struct.unpack(end + "Q", start[8:16])[0] if big else struct.unpack(end + "I", start[4:8])[0]

    def part(place: int, n: int) -> bytes:
        file.seek(place)
        return file.read(n)

    while at:
        size = struct.calcsize(count_of)
        n = struct.unpack(count_of, part(at, size))[0]
        body = part(at + size, entry * n + struct.calcsize(link_of))
        tags: dict[int, tuple] = {}
        for k in range(n):
            one = body[entry * k : entry * (k + 1)]
            tag, code = struct.unpack(end + "HH", one[:4])
            if code not in TYPES or code == 2:
                continue
            char, width = TYPES[code]
            count, inline = (struct.unpack(end + "Q", one[4:12])[0], one[12:20]) if big else (struct.unpack(end + "I", one[4:8])[0], one[8:12])
            value = inline[: width * count] if width * count <= len(inline) else part(struct.unpack(end + ("Q" if big else "I"), inline)[0], width * count)
            tags[tag] = struct.unpack(f"{end}{count}{char}", value)
        yield end, tags
        at = struct.unpack(link_of, body[-struct.calcsize(link_of) :])[0]


def _dtype(end: str, tags: dict[int, tuple]) -> np.dtype:
    if tags.get(PER_PIXEL, (1,))[0] != 1:
        raise ValueError("only images of one channel")
    return np.dtype(end + {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(tags[BITS][0] // 8))


@dataclass
class Pages(InputPartition):
    path: str
    pages: list[tuple[int, str, dict[int, tuple]]]

    def __post_init__(self) -> None:
        super().__init__(0)


class TiffReader(DataSourceReader):
    def __init__(self, path: str, most: int) -> None:
        self.path, self.most, self.tests = path, most, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on z alone; all others stay with Spark."""
        how = {EqualTo: lambda z, v: z == v, GreaterThan: lambda z, v: z > v, GreaterThanOrEqual: lambda z, v: z >= v, LessThan: lambda z, v: z < v, LessThanOrEqual: lambda z, v: z <= v, In: lambda z, v: z in v}
        for f in filters:
            if type(f) in how and f.attribute == ("z",) and f.value is not None:
                self.tests.append((how[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[Pages] = []
        with _open(self.path) as file:
            own, size = [], 0
            for z, (end, tags) in enumerate(headers(file)):
                if not all(test(z, v) for test, v in self.tests):
                    continue
                size += tags[WIDTH][0] * tags[HEIGHT][0] * tags[BITS][0] // 8
                own.append((z, end, {k: v for k, v in tags.items() if isinstance(v, tuple)}))
                if size >= self.most:
                    out.append(Pages(self.path, own))
                    own, size = [], 0
        return [*out, *([Pages(self.path, own)] if own else [])] or [Pages(self.path, [])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as file:
            for z, end, tags in partition.pages:
                parts = []
                for at, n in zip(tags[STRIPS], tags[COUNTS]):
                    file.seek(at)
                    parts.append(file.read(n))
                image = image_of(parts, tags, _dtype(end, tags))
                y, x = np.indices(image.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(image.size, z, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(image.ravel().astype(float))], names=["z", "y", "x", "v"])


class TiffStack(DataSource):
    """z, y, x, v of one file. Option partition_bytes: pixels that a partition reads."""

    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return "z int, y int, x int, v double"

    def reader(self, schema: Any) -> DataSourceReader:
        return TiffReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION)))


def read_stack(spark: SparkSession, path: str, img_id: int = 0, partition_bytes: int = PARTITION) -> DataFrame:
    """img_id, z, y, x, v of a file."""
    spark.dataSource.register(TiffStack)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cells = spark.read.format("tiff_stack").option("partition_bytes", partition_bytes).load(path)
    return cells.select(F.lit(img_id).alias("img_id"), "z", "y", "x", "v")


def write_stack(cells: DataFrame, path: str, column: str = "label", dtype: str = "uint16", big: bool | None = None) -> int:
    """One image's dense table as one deflated file; returns its bytes. big: BigTIFF, by default where the file needs it.

    Tasks compress pages; running totals of their sizes give each page's place, and tasks put their pages and headers there. No
    task holds more than a page, and the driver none. path: in a folder that all executors share as files.
    """

    def page(part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(part["y"].max()) + 1, int(part["x"].max()) + 1), dtype)
        image[part["y"], part["x"]] = part[column]
        return pd.DataFrame({"z": [part["z"].iloc[0]], "ny": [image.shape[0]], "nx": [image.shape[1]], "content": [zlib.compress(image.astype(image.dtype.newbyteorder("<")).tobytes())]})

    pages = written(cells.select("z", "y", "x", F.col(column)).groupBy("z").applyInPandas(page, "z int, ny int, nx int, content binary"), "pages")
    row = pages.agg(F.sum(F.octet_length("content") + 512), F.max("z"), F.count("*")).first()
    if not row[2] or row[2] != row[1] + 1:
        raise ValueError("a stack needs a page for every z from 0")
    big = row[0] + 16 > CLASSIC if big is None else big
    # A page is its header and then its pixels; the header's size is the same for all.
    count, link, entry, head = ("<Q", "<Q", 20, 16) if big else ("<H", "<I", 12, 8)
    size = struct.calcsize(count) + 10 * entry + struct.calcsize(link)
    even = F.octet_length("content") + F.octet_length("content") % 2 + size
    ends = pages.select("z", even.cast("long").alias("n"), F.expr("z div 1024").alias("run"))  # runs of pages, so that no task sums all
    runs = ends.groupBy("run").agg(F.sum("n").alias("all"))
    runs = runs.select("run", (F.sum("all").over(Window.orderBy("run")) - F.col("all")).alias("before"))  # a row for 1,024 pages
    inside = Window.partitionBy("run").orderBy("z")
    places = ends.join(runs, "run").select("z", "n", (F.col("before") + F.sum("n").over(inside) - F.col("n") + head).alias("at"))
    local = path.removeprefix("file://").removeprefix("file:")
    kind, bits = {"u": 1, "i": 2, "f": 3}[np.dtype(dtype).kind], np.dtype(dtype).itemsize * 8
    last = row[1]

    with open(local, "wb") as file:
        file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, head) if big else struct.pack("<2sHI", b"II", 42, head))

    def put(rows: Iterator[Any]) -> None:
        with open(local, "r+b") as file:
            for r in rows:
                values = [(WIDTH, 4, r.nx), (HEIGHT, 4, r.ny), (BITS, 3, bits), (COMPRESSION, 3, 8), (262, 3, 1), (STRIPS, 16 if big else 4, r.at + size), (PER_PIXEL, 3, 1), (ROWS, 4, r.ny), (COUNTS, 4, len(r.content)), (FORMAT, 3, kind)]
                out = struct.pack(count, len(values)) + b"".join(struct.pack("<HHQQ" if big else "<HHII", tag, code, 1, v) for tag, code, v in values)
                out += struct.pack(link, 0 if r.z == last else r.at + r.n)
                file.seek(r.at)
                file.write(out + r.content + b"\0" * (len(r.content) % 2))

    pages.join(places, "z").foreachPartition(put)
    return os.stat(local).st_size
