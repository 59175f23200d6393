"""Other files: NumPy arrays, 8-bit PNG slices, zip archives, JSON logs and PLY surfaces. Readers go through binaryFile."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tiff import pages


def png(image: np.ndarray) -> bytes:
    """An 8-bit grayscale PNG file."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + row.tobytes() for row in image.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """The image of an 8-bit grayscale PNG file that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed = 8, b""
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (bits, colour, interlaced) != (8, 0, 0):
                raise ValueError("only 8-bit grayscale")
        packed += body if name == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    out = np.zeros((height, width), np.uint8)
    for y in range(height):
        how, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(width, np.int64)
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = (line + up) % 256
        elif how == 1:
            out[y] = np.cumsum(line) % 256
        else:
            left = corner = 0
            for x in range(width):
                b = int(up[x])
                if how == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                corner, left = b, int(line[x] + guess) % 256
                out[y, x] = left
    return out


#: Files of a folder up to which their numbers are broadcast.
FEW = 100_000


def read_stack(spark: SparkSession, path: str) -> DataFrame:
    """z, y, x, v of a folder of PNG, TIFF (the first page) and JPEG slices of one channel, z by file name.

    The names alone are numbered; contents stay where they are read unless a folder has more than FEW files. JPEG goes through Spark's image source.
    """
    ends = lambda *kinds: "*.{" + ",".join(k for x in kinds for k in (x, x.upper())) + "}"
    name = lambda column: F.substring_index(column, "/", -1).alias("name")
    found = lambda *kinds: spark.read.format("binaryFile").option("pathGlobFilter", ends(*kinds)).load(path)
    names = found("png", "tif", "tiff", "jpg", "jpeg").select(name("path"))
    number = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("z"))  # a row a slice
    number = F.broadcast(number) if names.count() <= FEW else number

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for z, file, content in zip(part["z"], part["name"], part["content"]):
                image = unpng(content) if file.lower().endswith("png") else next(pages(content))
                y, x = np.indices(image.shape)
                yield pd.DataFrame({"z": z, "y": y.ravel(), "x": x.ravel(), "v": image.ravel().astype(int)})

    def decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                if r.nChannels != 1:
                    raise ValueError(f"{r.name}: only images of one channel")
                y, x = np.indices((r.height, r.width))
                yield pd.DataFrame({"z": r.z, "y": y.ravel(), "x": x.ravel(), "v": np.frombuffer(r.data, np.uint8).astype(int)})

    kind = "z int, y int, x int, v int"
    out = found("png", "tif", "tiff").select(name("path"), "content").join(number, "name").mapInPandas(cells, kind)
    images = spark.read.format("image").option("pathGlobFilter", ends("jpg", "jpeg")).load(path).select(name("image.origin"), "image.height", "image.width", "image.nChannels", "image.data")
    return out.unionByName(images.join(number, "name").mapInPandas(decoded, kind))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, z, y, x, v of .npy files of 2 or 3 dimensions."""

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                for z, image in enumerate(array if array.ndim == 3 else array[None]):
                    y, x = np.indices(image.shape)
                    yield pd.DataFrame({"path": name, "z": z, "y": y.ravel(), "x": x.ravel(), "v": image.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cells, "path string, z int, y int, x int, v double")


def slices_as_png(cells: DataFrame, column: str = "v") -> DataFrame:
    """img_id, name (slice_0001.png, ...) and content of each z slice."""

    def file(part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(part["y"].max()) + 1, int(part["x"].max()) + 1), np.uint8)
        image[part["y"], part["x"]] = part[column]
        return pd.DataFrame({"img_id": [part["img_id"].iloc[0]], "name": [f"slice_{int(part['z'].iloc[0]) + 1:04d}.png"], "content": [png(image)]})

    return cells.select("img_id", "z", "y", "x", F.col(column)).groupBy("img_id", "z").applyInPandas(file, "img_id int, name string, content binary")


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content, error of the files in zip archives; an archive that can't be read is a row with its error."""

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            if not info.is_dir():
                                yield pd.DataFrame({"archive": [name], "name": [info.filename], "content": [archive.read(info)], "error": [None]})
                except (zipfile.BadZipFile, RuntimeError) as e:
                    yield pd.DataFrame({"archive": [name], "name": [None], "content": [None], "error": [f"{type(e).__name__}: {e}"]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(members, "archive string, name string, content binary, error string")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a JSON log."""
    rows.write.mode("append").json(path)


def ply(faces: DataFrame) -> DataFrame:
    """img_id, label and the PLY text of each label's unit squares (faces: img_id, label, and the corners' z2, y2, x2 arrays, doubled)."""

    def file(part: pd.DataFrame) -> pd.DataFrame:
        number: dict[tuple, int] = {}
        squares = [[number.setdefault(tuple(c), len(number)) for c in zip(z, y, x)] for z, y, x in zip(part["z2"], part["y2"], part["x2"])]
        head = f"ply\nformat ascii 1.0\nelement vertex {len(number)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(squares)}\nproperty list uchar int vertex_indices\nend_header\n"
        lines = [f"{x / 2:g} {y / 2:g} {z / 2:g}" for z, y, x in number] + [f"4 {' '.join(map(str, s))}" for s in squares]
        return pd.DataFrame({"img_id": [part["img_id"].iloc[0]], "label": [part["label"].iloc[0]], "content": [head + "\n".join(lines) + "\n"]})

    return faces.groupBy("img_id", "label").applyInPandas(file, "img_id int, label int, content string")
