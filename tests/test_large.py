"""What large tables need: cells in as many tasks as a shuffle has parts, and nothing broadcast that is larger than it seems."""

import duckdb
import pytest
from pyspark.sql import functions as F

from test_queries import SF, rows
from voxloom import model
from voxloom.operators import grow as G
from voxloom.operators import prompts as P
from voxloom.operators import tiles
from voxloom.plans import queries


@pytest.fixture
def narrow(spark):
    """Tables of 20 KB may be broadcast, and one that turns out to have over 200 KB fails, as 10 MB and the driver's memory do at size."""
    put = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.maxBroadcastTableSize": "200k"}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k in put:
        spark.conf.unset(k)


def test_volumes_come_in_all_parts_of_a_shuffle(spark):
    cells = model.volumes(spark, "/root/testdata/sf0.01")
    assert cells.rdd.getNumPartitions() == 4
    assert "Join" not in cells._jdf.queryExecution().executedPlan().toString()


def test_filled_images_have_every_cell_once(spark):
    shape = (2, 3, 4)
    made = [(1, 0, 5), (1, 7, 6), (1, 23, 7), (2, -1, 9), (3, 4, None), (4, -1, 1), (4, 2, 3), (None, -1, 2)]
    got = model.filled(spark.createDataFrame(made, "img_id int, cell int, v int"), shape).collect()
    want = {(i, c // 12, c // 4 % 3, c % 4): 0 for i in (1, 2, 3, 4, None) for c in range(24)}
    want |= {(i, c // 12, c // 4 % 3, c % 4): v or 0 for i, c, v in made if c >= 0}
    assert len(got) == len(want) and {tuple(r)[:4]: r["v"] for r in got} == want


def test_prompts_are_looked_up_in_all_parts(spark):
    cells = spark.range(4).selectExpr("cast(id as int) img_id").withColumns({a: F.explode(F.sequence(F.lit(0), F.lit(3))) for a in "zyx"})
    points = spark.createDataFrame([(0, 0, 0, 3), (0, 0, 0, 4), (9, 0, 0, 0), (1, None, 0, 0)], "img_id int, z int, y int, x int")
    out = P.invalid_prompts(points, cells)
    assert {tuple(r) for r in out.collect()} == {(0, 0, 0, 4), (9, 0, 0, 0), (1, None, 0, 0)}
    assert P.invalid_prompts(points, cells).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["synth_blobs", "fill_holes", "fill_small_holes", "fill_small_holes_labels"])
def test_nothing_large_is_broadcast(spark, narrow, name):
    con, sf = duckdb.connect(), SF.replace("0.001", "0.01")
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_tiles_send_borders_only_where_an_image_goes_on(spark):
    """One image of one tile and one of 3 x 2 x 1 tiles, grown to the end, against one tile for all; borders as rows."""
    grid = spark.createDataFrame([(0, 3, 3, 3), (1, 10, 7, 4)], "img_id int, nz int, ny int, nx int")
    for a in "zyx":
        grid = grid.withColumn(a, F.explode(F.expr(f"sequence(0, n{a} - 1)")))
    cells = grid.select(*model.KEY, F.lit(9).alias("v"), F.expr("cast(z + y + x = 0 as int)").alias("label"))
    assert {r["label"] for r in G.grow(cells, [5], tile=4, hops=3)[0].collect()} == {1}
    at = tiles.tiled(cells, ["label"], 4)
    sent = at.select(*tiles.PLACE, *tiles.SHAPE, "label").mapInPandas(tiles._borders(["label"], 1, 4), f"{tiles._TILES}, dz int, dy int, dx int, label binary")
    count = {r["img_id"]: r["count"] for r in sent.groupBy("img_id").count().collect()}
    assert count == {0: 1, 1: 7 * 4 * 2}  # along z 2 + 3 + 2, along y 2 + 2, along x a full tile at the end
    assert {tuple(r) for r in tiles.near(at.where("img_id = 0"), 4).collect()} == {(0, 0, 0, 0)}
