"""Queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from voxloom.plans import queries

SF = "/root/testdata/sf0.001"
SOME = """scan_image scan_volume image_info boundary_mask map_classes crop resample_block slice_axis bbox overlap_merge reorder_topn otsu threshold_pairs_mean erode_2XZ_1Y erode_ball_twice close
gap_between_contact label_open ccomp_edges ccomp_tiled filter_components split_all fill_holes grow_multi grow_log descent_flood seed_log adaptive_split_once sample_grid prompt_groups vote_per_class vote_majority
mesh_vertices align_sorted tiff_round_trip background_mask narrowed_labels has_labels threshold_pairs_lower erode_cube3 erode_square2 dilate_square2 grow_ids_boundary grow_overwrite matching_names fill_small_holes
grow_to_end descent_uneven adaptive_footprints seed_grid_full sample_kmeans prompts3d_each mesh_numbered predict_masks fill_small_holes_slices split_topn""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "embeddings lineitem part supplier nation".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None):
        out.append(tuple(str(round(x, 6) + 0) if isinstance(x, float) and x == x else str(x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", SOME)
def test_same_as_duckdb(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())
