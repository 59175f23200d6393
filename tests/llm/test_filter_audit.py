"""The filter audit against plain loops over all orders, and DuckDB."""

import re
from itertools import permutations

import duckdb
import pandas as pd

from voxloom.llm import filter_audit

KIND = "doc_id long, text string, source string, part string, mask int, row string"


def failed(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and least is not None and least < doc_id,
    }
    return {k for k, v in tests.items() if v}


def plain(rows, labels):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    kinds = [(r[2] or "", failed(r[1] or "", r[0], least.get(r[1] or "")), any(i == r[0] is not None and q == 1 for i, q, _ in labels), any(i == r[0] is not None and t == 1 for i, _, t in labels)) for r in rows]
    out, total = [], {}
    for part in {k[0] for k in kinds}:
        own = [k for k in kinds if k[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                hit = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                total[part, f] = total.get((part, f), 0) + len(hit)
                late = sum(f in k[1] for k in own) - len(hit)
                out.append([part, order, step + 1, len(left), len(hit), late, sum(k[1] == {f} for k in own), sum(k[2] for k in hit), sum(k[3] for k in hit)])
    return sorted(tuple([*x, total[x[0], x[1][x[2] - 1]]]) for x in out)


def rows_of():
    long = " ".join(f"w{i}" for i in range(60))
    kinds = [None, "", long, long + " #", "LOUD " * 60, long + " X" * 30, "a b", long + "\x0bé" * 5, "word " * 300]
    rows = [(i, kinds[i % len(kinds)] if i % 2 else f"{long} {i}", ["a", "b", None, "", "c"][i % 5], "x", 1, "r") for i in range(200)]
    return rows + rows[:3] + [(None, long, "a", "x", 1, "r")] * 3 + [(None, "own", None, "x", 1, "r"), (500, "A1 " * 40_000, "a", "x", 1, "r")]


LABELS = [(i, i % 2, [None, 1, 0][i % 3]) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (7, None, 1)]


def test_as_defined(spark):
    rows = rows_of()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark.createDataFrame(rows, KIND), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain(rows, LABELS)
    alone = filter_audit.audit(spark.createDataFrame(rows, KIND))
    assert sorted(map(tuple, alone.collect())) == plain(rows, [])


def test_same_as_duckdb(spark):
    rows = [r for r in rows_of() if r[0] is not None]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "part", "mask", "row"])[["doc_id", "text", "source"]]  # noqa: F841
    labels = pd.DataFrame(LABELS, columns=["doc_id", "quality", "toxic"])  # noqa: F841
    want = duckdb.connect().execute(filter_audit.AUDIT_SQL).df()
    got = filter_audit.audit(spark.createDataFrame(rows, KIND), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).toPandas()
    by = ["part", "filter_order", "step"]
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True)[list(got.columns)], check_dtype=False)


def test_prepass_clears_most_unique_texts_and_no_repeat(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id div if(id < 2000, 2, 1)) as text")
    digests = docs.selectExpr("sha2(text, 256) as digest")
    blocks = 1 + 20_000 * filter_audit.CELLS_A_ROW // filter_audit.CELLS
    block, cells = filter_audit._cells(digests["digest"], blocks)
    from pyspark.sql import functions as F

    full = filter_audit.repeated_cells(digests, blocks)
    maybe = digests.withColumn("block", block).join(full, "block").where(F.forall(cells, lambda c: F.getbit(F.get("words", F.shiftright(c, 6).cast("int")), (c % 64).cast("int")) == 1))
    n = maybe.count()
    assert 2000 <= n < 2000 + 0.06 * 18_000
    assert filter_audit.repeats(docs, digests, 20_000).count() == 1000


def test_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], KIND)).count() == 0
