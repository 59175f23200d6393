import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import surface
from voxloom.sources import files, tiff


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    stack = rng.integers(0, 256, (2, 5, 7))
    for k, image in enumerate(stack):
        assert (files.unpng(files.png(image)) == image).all()
        (tmp_path / f"s{k}.png").write_bytes(files.png(image))
    got = {(r.z, r.y, r.x): r.v for r in files.read_stack(spark, str(tmp_path)).collect()}
    assert got == {at: int(stack[at]) for at in np.ndindex(stack.shape)}
    cells = spark.createDataFrame([(0, *map(int, at), int(stack[at])) for at in np.ndindex(stack.shape)], "img_id int, z int, y int, x int, v int")
    out = {r.name: r.content for r in files.slices_as_png(cells).collect()}
    assert sorted(out) == ["slice_0001.png", "slice_0002.png"] and (files.unpng(bytes(out["slice_0002.png"])) == stack[1]).all()


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (5, 6))
    lines = b""
    for y, row in enumerate(image):
        up = image[y - 1] if y else np.zeros(6, int)
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], up[:-1]])
        p = left + up - corner
        near = [min((abs(a - q), 0, a), (abs(b - q), 1, b), (abs(c - q), 2, c))[2] for a, b, c, q in zip(left, up, corner, p)]
        guess = [np.zeros(6, int), left, up, (left + up) // 2, np.array(near)][y]
        lines += bytes([y]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (files.unpng(data) == image).all()


def test_arrays_and_archives(spark, tmp_path):
    array = np.arange(24).reshape(2, 3, 4)
    buffer = io.BytesIO()
    np.save(buffer, array)
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.npy").write_bytes(buffer.getvalue())
    assert {(r.z, r.y, r.x): int(r.v) for r in files.read_arrays(spark, str(tmp_path / "n")).collect()} == {at: int(array[at]) for at in np.ndindex(array.shape)}
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("d/x.csv", "a,b\n")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    rows = files.unzip(spark, str(tmp_path)).collect()
    assert [(r.name, bytes(r.content)) for r in rows if not r.error] == [("d/x.csv", b"a,b\n")] and sum(bool(r.error) for r in rows) == 1


def test_log_grows(spark, tmp_path):
    for k in range(2):
        files.append_log(spark.createDataFrame([(k, "a")], "step int, note string"), str(tmp_path / "log"))
    assert sorted(r.step for r in spark.read.json(str(tmp_path / "log")).collect()) == [0, 1]


def test_surface_of_a_box(spark):
    label = np.zeros((3, 4, 5), int)
    label[0:2, 1:3, 1:4] = 7
    cells = spark.createDataFrame([(0, *map(int, at), int(label[at])) for at in np.ndindex(label.shape)], "img_id int, z int, y int, x int, label int")
    faces = surface.faces(cells)
    assert faces.count() == 2 * (2 * 2 + 2 * 3 + 2 * 3)
    text = files.ply(faces).first().content
    vertices, squares = (int(next(x for x in text.splitlines() if x.startswith(f"element {n}")).split()[-1]) for n in ("vertex", "face"))
    assert vertices - 2 * squares + squares == 2  # Euler's number of a sphere: each square has two edges to itself


def thin(image):
    image = np.pad(image.astype(int), 1)
    while True:
        before = image.copy()
        for first in (True, False):
            gone = []
            for y, x in zip(*np.nonzero(image)):
                ring = [image[y + a, x + b] for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                turns = sum(a == 0 and b == 1 for a, b in zip(ring, ring[1:] + ring[:1]))
                n, e, s, w = ring[0], ring[2], ring[4], ring[6]
                if 2 <= sum(ring) <= 6 and turns == 1 and (n * e * s == 0 and e * s * w == 0 if first else n * e * w == 0 and n * s * w == 0):
                    gone.append((y, x))
            for at in gone:
                image[at] = 0
        if (image == before).all():
            return image[1:-1, 1:-1]


def test_skeleton(spark):
    image = np.zeros((9, 14), int)
    image[1:4, 1:12], image[3:8, 5:8] = 1, 1
    image[5, 12] = 1
    cells = spark.createDataFrame([(0, 0, int(y), int(x), int(image[y, x])) for y, x in np.ndindex(image.shape)], "img_id int, z int, y int, x int, on int")
    got = {(r.y, r.x) for r in surface.skeleton(cells.withColumn("on", F.col("on") == 1)).collect()}
    assert got == {tuple(map(int, at)) for at in np.argwhere(thin(image))}


def test_a_folder_of_several_kinds(spark, tmp_path):
    draw = np.random.default_rng(8)
    a, b = draw.integers(0, 256, (2, 8, 16))
    (tmp_path / "a.PNG").write_bytes(files.png(a))
    (tmp_path / "b.tif").write_bytes(tiff.encode([b.astype(np.uint8)]))
    (tmp_path / "notes.txt").write_text("no image")
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 8, 10)  # gray, one byte
    for y in range(8):
        for x in range(16):
            image.getRaster().setSample(x, y, 0, 40 if x < 8 else 200)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "c.jpg")))
    got = np.zeros((3, 8, 16), int)
    for r in files.read_stack(spark, str(tmp_path)).collect():
        got[r.z, r.y, r.x] = r.v
    assert (got[0] == a).all() and (got[1] == b).all()
    assert abs(got[2] - np.where(np.arange(16) < 8, 40, 200)).max() <= 4
