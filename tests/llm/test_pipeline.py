import random
import re

import duckdb

import corpus_pipeline
from test_neardup import brute, corpus  # the folder of the tests is on the path
from voxloom.llm import mixing


def test_each_stage_on_its_own_input(spark, tmp_path):
    rng = random.Random(3)
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    words = sorted({w for _, t, lang, *_ in given if lang == "en" for w in re.findall("[a-z]{3,}", t or "")})
    real = lambda t: t and re.sub(r"w(\d+)", lambda m: words[int(m[1]) % len(words)], t, flags=re.I)  # noqa: E731  words that a language has, in the shapes of corpus()
    rows = given + [(10_000 + i, real(t), (None, "de", None)[i % 3] if i % 50 == 0 else None, f"src{i % 7}", len(t or "")) for i, t in corpus()]
    rows += [(11_000 + i, t, "en", "src1", 0) for i, t in enumerate(["12 34", "And this is of the same", "And  this is of\nthe same", "--"])]
    noise = [(12_000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäñé") for _ in range(rng.randint(2, 12))) for _ in range(30)), None, "src1", 0) for i in range(20)]
    rows += noise
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    sf = str(tmp_path / "sf")
    stages, seen = dict(corpus_pipeline.STAGES), []
    at = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(stages.items()):
        stage(spark, at, sf).write.parquet(str(tmp_path / f"{k}"))
        after = spark.read.parquet(str(tmp_path / f"{k}"))
        seen.append((sorted(map(tuple, at.collect()), key=str), sorted(map(tuple, after.collect()), key=str)))
        if k < 4:
            assert after.columns == docs.columns
        at = after
    (a, b), (c, d), (e, f), (g, h), (i, j) = seen
    gone = {r[0] for r in a} - {r[0] for r in b}
    assert gone >= {r[0] for r in a if not any(x.isalpha() for x in r[1] or "")} | {r[0] for r in noise}
    assert all(r[0] >= 10_000 or not any(x.isalpha() for x in r[1] or "") for r in a if r[0] in gone)  # no given document with a letter
    without = lambda rows: {(*r[:2], *r[3:]) for r in rows}
    assert without(b) <= without(a)
    said = {r[0]: r[2] for r in given}
    assert all(r[2] == said[r[0]] for r in b if said.get(r[0])) and all(r[2] for r in b)  # lang is the prediction, here right
    best = {}
    for r in c:
        key = "".join(x for x in r[1] if x not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, 10**9)), (-len(r[1]), r[0]))
    assert {r[0] for r in d} == {x[1] for x in best.values()} and set(d) <= set(c)
    parts = brute([r[:2] for r in e], size=5)
    assert {r[0] for r in f} == {x for x, (_, low) in parts.items() if x == low}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars int)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", g)
    assert sorted(r[0] for r in h) == sorted(r[0] for r in con.execute(mixing.MIX_SQL).fetchall())
    assert set(h) <= set(g)
    whole = {}
    for r in j:
        whole.setdefault(r[0], []).append(r[3])
    assert set(whole) == {r[0] for r in i}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect())) == sorted(x[:5] for x in j)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, `row` string, head string, `_language` string, bits int, lang_pred string"
    rows = [(i, "the river ran past the old mill " * 3 + f"word {'abcdefgh'[i % 8]}" if i else None, "en" if i % 2 else None, None, 0, "r", "h", "l", 1, "p") for i in range(12)] * 2
    for name, given in (("none", []), ("some", rows)):
        docs = spark.createDataFrame(given, schema)
        (tmp_path / name).mkdir()
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        at = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, at, str(tmp_path / name)).write.parquet(str(tmp_path / name / f"{k}"))
            at = spark.read.parquet(str(tmp_path / name / f"{k}"))
            assert k == 4 or at.columns == docs.columns
            if given and k < 4:
                assert {(r["row"], r["head"], r["_language"], r["bits"], r["lang_pred"], r["lang"]) for r in at.collect()} == {("r", "h", "l", 1, "p", "en")}
        assert (at.count() > 0) == bool(given)
