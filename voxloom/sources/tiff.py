"""TIFF stacks as cell tables and back: uncompressed, deflate, LZW or PackBits, with or without differences along rows, 8, 16 and 32 bits, whole numbers or floats, one channel.

Files come through Spark's binaryFile reader and are decoded one page at a time in tasks; pages of one file become z slices. For
files that no task should hold see stacks.py.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: TIFF tags and field types (format character, size).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, PER_PIXEL, ROWS, COUNTS, PREDICTOR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 339
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("Q", 8), 16: ("Q", 8)}


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a TIFF file as 2-D arrays."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or struct.unpack(end + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(end + "I", data[4:8])[0]
    while at:
        n = struct.unpack_from(end + "H", data, at)[0]
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPES or kind == 2:
                continue
            char, size = TYPES[kind]
            place = at + 2 + 12 * k + 8
            if size * count > 4:
                place = struct.unpack_from(end + "I", data, place)[0]
            tags[tag] = struct.unpack_from(f"{end}{count}{char}", data, place)
        yield _page(data, end, tags)
        at = struct.unpack_from(end + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, end: str, tags: dict[int, tuple]) -> np.ndarray:
    if tags.get(PER_PIXEL, (1,))[0] != 1:
        raise ValueError("only images of one channel")
    bits, kind = tags[BITS][0], tags.get(FORMAT, (1,))[0]
    dtype = np.dtype(end + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    parts = (data[a : a + n] for a, n in zip(tags[STRIPS], tags[COUNTS]))
    return image_of(parts, tags, dtype)


def image_of(parts: Iterable[bytes], tags: dict[int, tuple], dtype: np.dtype) -> np.ndarray:
    """A page from its strips."""
    how, differences = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if how not in UNPACK or differences not in (1, 2) or differences == 2 and dtype.kind == "f":
        raise ValueError(f"compression {how} with predictor {differences} isn't supported")
    raw = b"".join(map(UNPACK[how], parts))
    image = np.frombuffer(raw, dtype, tags[HEIGHT][0] * tags[WIDTH][0]).reshape(tags[HEIGHT][0], tags[WIDTH][0])
    return np.cumsum(image, axis=1, dtype=dtype.newbyteorder("=")) if differences == 2 else image


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count below 128 and that many bytes and one more, or 257 less a count of copies of one byte."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


CLEAR, DONE = 256, 257


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits from the highest bit on, one bit more as soon as the next code but one needs it."""
    known: list[bytes] = []
    out, width, last = [], 9, b""
    bits, held = 0, 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == DONE:
            break
        if code == CLEAR:
            known, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not known or code > len(known):
            raise ValueError("broken LZW data")
        word = known[code] if code < len(known) else last + last[:1]
        if last:
            known.append(last + word[:1])
        out.append(word)
        last = word
        width = max(9, min(12, (len(known) + 1).bit_length()))
    return b"".join(out)


#: By compression: none, LZW, deflate (two numbers), PackBits.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def encode(slices: Iterable[np.ndarray]) -> bytes:
    """A deflated little-endian TIFF file of equal 2-D slices."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image in slices:
        image = np.ascontiguousarray(image)
        kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        packed = zlib.compress(image.astype(image.dtype.newbyteorder("<")).tobytes())
        at = len(out)
        out += packed + b"\0" * (len(packed) % 2)
        entries = [(WIDTH, 4, image.shape[1]), (HEIGHT, 4, image.shape[0]), (BITS, 3, image.dtype.itemsize * 8), (COMPRESSION, 3, 8), (262, 3, 1), (STRIPS, 4, at), (PER_PIXEL, 3, 1), (ROWS, 4, image.shape[0]), (COUNTS, 4, len(packed)), (FORMAT, 3, kind)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, t, 1, v) for tag, t, v in entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, z, y, x, v (double), error of all cells of the files at path; a file that can't be read is one row with its error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                try:
                    for z, image in enumerate(pages(content)):
                        y, x = np.indices(image.shape)
                        yield pd.DataFrame({"path": name, "z": z, "y": y.ravel(), "x": x.ravel(), "v": image.ravel().astype(float), "error": None})
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    yield pd.DataFrame({"path": [name], "z": [None], "y": [None], "x": [None], "v": [None], "error": [f"{type(e).__name__}: {e}"]})

    return files.mapInPandas(cells, "path string, z int, y int, x int, v double, error string")


def write(cells: DataFrame, column: str = "label", dtype: str = "uint16") -> DataFrame:
    """img_id and the TIFF file (binary) of each image; an image is one task's work, as it is one file."""

    def file(part: pd.DataFrame) -> pd.DataFrame:
        shape = tuple(int(part[a].max()) + 1 for a in ("z", "y", "x"))
        volume = np.zeros(shape, dtype)
        volume[part["z"], part["y"], part["x"]] = part[column]
        return pd.DataFrame({"img_id": [part["img_id"].iloc[0]], "content": [encode(volume)]})

    return cells.select("img_id", "z", "y", "x", F.col(column)).groupBy("img_id").applyInPandas(file, "img_id int, content binary")
