"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from voxloom.llm import exact_dedup, mixing, queries, sharding


@pytest.fixture(scope="module")
def odd():
    rows = [(i, t, lang, s) for i, (t, lang, s) in enumerate([(None, "en", "src1"), ("", "en", "src1"), (" \n", None, None), ("a b", "de", "src2"), ("ab", "de", "src2"), ("é ß 日本", "fr", "x"), ("a  b", "fr", "src13")] * 30)]
    rows += [(i, f"word {i} " * (i % 40), "en", "src0") for i in range(300, 900)] + [(2000 + i, "copy of a text", "en", "src0") for i in range(900)] + [(5000, "long " * 40_000, "es", "src7")]
    return rows


def same(df, sql, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    want = con.execute(sql).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda f: sorted(map(str, f[columns].astype(object).itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.mark.parametrize("make, sql", [(sharding.rendezvous, sharding.SHARD_SQL), (exact_dedup.exact_duplicates, exact_dedup.EXACT_SQL), (mixing.mix, mixing.MIX_SQL)], ids=["shard", "exact", "mix"])
def test_odd_rows(spark, odd, make, sql):
    docs = spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id long, text string, lang string, source string, shard string, sha int")
    same(make(docs), sql, odd)
    assert make(docs.limit(0)).count() == 0
    again = docs.union(docs).union(docs.selectExpr("cast(null as long)", "text", "lang", "source", "shard", "sha").limit(20))
    assert make(again).count() >= (0 if make is mixing.mix else 2 * len(odd) + 20)


def test_shards_by_weight_and_growth(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.rendezvous(docs, (1.0, 2.0, 0.0, 5.0), 2.0).collect()
    share = [sum(r.shard == k for r in rows) / len(rows) for k in range(4)]
    assert share[2] == 0 and all(abs(a - b) < 0.02 for a, b in zip(share, (0.125, 0.25, 0, 0.625)))
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {4}
    assert abs(sum(r.grown_shard == 4 for r in rows) / len(rows) - 0.2) < 0.02
    for k in (0, 1, 3):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(7, "a b"), (7, "a b"), (7, "ab"), (8, "ab"), (None, "ab")], "doc_id long, text string")
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert [r.kept for r in rows].count(True) == 1 and {r.keep_id for r in rows} == {7} and {r.group_size for r in rows} == {5}
    kept = exact_dedup.without_duplicates(docs).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(7, "a b")]


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, "w " * 9, lang, s) for i, (lang, s) in enumerate([("en", "src0")] * 100 + [("de", "src0")] * 10 + [("en", "src1")] * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.domain, r.lang): r.leaf_budget for r in mixing.mix(docs, budget=2000, domains={"domain0": 1, "domain1": 1}, languages={"en": 1, "de": 1}).select("domain", "lang", "leaf_budget").distinct().collect()}
    # domain0 gets 1000: de can give 10 * 10 * 2 = 200 of its 500, en takes the other 800; domain1 isn't touched.
    assert got == {("domain0", "de"): 200, ("domain0", "en"): 800, ("domain1", "en"): 1000}


def test_weight_zero_gives_nothing(spark):
    rows = [(i, "w " * 9, lang, s) for i, (lang, s) in enumerate([("en", "src0")] * 100 + [("de", "src0")] * 100 + [("en", "src1")] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, budget=3000, domains={"domain0": 1, "domain1": 0}, languages={"en": 2, "de": 0}).groupBy("domain", "lang", "leaf_budget").agg({"n_tokens": "sum"}).collect()
    assert [tuple(r) for r in got] == [("domain0", "en", 2000, 2000)]  # two epochs are all that the only leaf with weight can give
    assert mixing.mix(docs, domains={"domain0": 0, "domain1": 0}).count() == 0
    with pytest.raises(ValueError, match="at least 0"):
        mixing.mix(docs, languages={"en": -1})


def test_mixed_rows_keep_their_columns(spark):
    rows = [(7, "w " * n, "en", "src0", n) for n in (1, 2, 3, 4)] + [(i, "w", "de", "src0", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int")
    plain, carried = mixing.mix(docs, budget=100), mixing.mix(docs, budget=100, carry=True)
    assert carried.columns == ["row", *plain.columns]
    assert sorted(map(tuple, carried.drop("row").collect())) == sorted(map(tuple, plain.collect()))
    assert all(len(r.row.text.split()) + 1 == r.n_tokens and r.row.doc_id == r.doc_id for r in carried.collect())
    assert sum(r.n_tokens for r in carried.collect()) <= 100


def test_queries_have_their_sql():
    assert set(queries.oracle_sql()) <= set(queries.queries())
