import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.sources import stacks, tiff


def lzw(data):
    """A plain LZW coder of the TIFF kind."""
    bits, known, width, word = "", {bytes([k]): k for k in range(256)}, 9, b""
    bits += format(256, "09b")
    n = 258
    for b in data:
        if word + bytes([b]) in known:
            word += bytes([b])
            continue
        bits += format(known[word], f"0{width}b")
        known[word + bytes([b])] = n
        n += 1
        if n == 4095:
            bits += format(256, f"0{width}b")
            known, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = max(9, min(12, n.bit_length()))
        word = bytes([b])
    if word:
        bits += format(known[word], f"0{width}b")
        n += 1
        width = max(9, min(12, n.bit_length()))
    bits += format(257, f"0{width}b")
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def test_lzw_and_packbits():
    draw = np.random.default_rng(1)
    for data in (b"", b"a", b"abababababab" * 50, bytes(draw.integers(0, 4, 9000, np.uint8)), bytes(draw.integers(0, 256, 20_000, np.uint8))):
        assert tiff.unpack_lzw(lzw(data)) == data
    assert tiff.unpack_bits(bytes([0xFE, 0xAA, 2, 0x80, 0, 0x2A, 0xFD, 0xAA, 3, 0x80, 0, 0x2A, 0x22, 0xF7, 0xAA])).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"  # the format's own example
    with pytest.raises(ValueError):
        tiff.unpack_lzw(b"\x00\x00")


def one_page(image, how, packed, predictor=1):
    tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, image.dtype.itemsize * 8), (259, 3, how), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, len(packed)), (317, 3, predictor)]
    body = packed + b"\0" * (len(packed) % 2)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"


def test_compressed_pages():
    image = np.arange(600, dtype="<u2").reshape(20, 30) % 777
    steps = np.diff(image, axis=1, prepend=np.zeros((20, 1), "<u2")).astype("<u2")
    for how, pack in ((5, lzw), (8, zlib.compress)):
        assert (next(tiff.pages(one_page(image, how, pack(image.tobytes())))) == image).all()
        assert (next(tiff.pages(one_page(image, how, pack(steps.tobytes()), 2))) == image).all()
    literal = b"".join(bytes([len(c) - 1]) + c for c in (image.tobytes()[k : k + 128] for k in range(0, 1200, 128)))
    assert (next(tiff.pages(one_page(image, 32773, literal))) == image).all()


@pytest.mark.parametrize("big", [False, True])
def test_stack_round_trip(spark, tmp_path, big):
    volume = np.random.default_rng(2).integers(0, 60_000, (13, 8, 9))
    rows = [(0, *map(int, at), int(volume[at])) for at in np.ndindex(volume.shape)]
    cells = spark.createDataFrame(rows, "img_id int, z int, y int, x int, label int").repartition(5)
    path = str(tmp_path / "v.tif")
    assert stacks.write_stack(cells, path, big=big) == (tmp_path / "v.tif").stat().st_size
    if not big:
        assert (np.stack(list(tiff.pages((tmp_path / "v.tif").read_bytes()))) == volume).all()
    back = stacks.read_stack(spark, path, partition_bytes=300)
    assert back.rdd.getNumPartitions() == 5  # pages of 144 bytes: the third reaches 300
    assert back.select("img_id", "z", "y", "x", F.col("v").cast("int").alias("label")).exceptAll(cells).count() == 0 and back.count() == volume.size
    some = stacks.read_stack(spark, path).where("z >= 3 and z < 5 and y = 2")
    assert some.count() == 2 * 9 and some.rdd.getNumPartitions() == 1


def test_only_pages_asked_for_are_read(spark, tmp_path):
    image = np.ones((4, 4), np.uint8)
    path = tmp_path / "v.tif"
    path.write_bytes(tiff.encode([image] * 5))
    reader = stacks.TiffReader(str(path), 1)
    assert list(reader.pushFilters([stacks.GreaterThan(("z",), 2), stacks.EqualTo(("y",), 1)])) == [stacks.EqualTo(("y",), 1)]
    assert [p[0] for part in reader.partitions() for p in part.pages] == [3, 4]
    with pytest.raises(ValueError):
        (tmp_path / "n.tif").write_bytes(b"no image at all..")
        stacks.TiffReader(str(tmp_path / "n.tif"), 1).partitions()
    with pytest.raises(ValueError, match="every z"):
        stacks.write_stack(spark.createDataFrame([(0, 1, 0, 0, 1)], "img_id int, z int, y int, x int, label int"), str(tmp_path / "h.tif"))
