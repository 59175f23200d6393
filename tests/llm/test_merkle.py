"""The Merkle manifest against a plain recursive version and DuckDB."""

import zlib
from hashlib import sha256

import duckdb
import pandas as pd
import pytest

from voxloom.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, branch string, slot0 int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    fields = [r[0], r[3], r[2], r[4], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def plain(rows):
    """(root, {place of row: (leaf, subroot, siblings by level)}) by the definition, one level after another."""

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
                paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
            nodes, at = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [k // 8 for k in at]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    sub, found = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub[lang], paths = tree([leaf(r, r[1]) for r in own])
        found += list(zip(own, paths))
    root, above = tree([sub[x] for x in langs])
    out = []
    for r, path in found:
        path = path + above[langs.index(r[2])]
        h = tampered = leaf(r, r[1])
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
            tampered = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
        f = tampered
        for a, b in path:
            f = H(*a, f, *b)
        out.append((r[0], h, sub[r[2]], root, H(*[x for a, b in path for x in a + b]), f, f == root))
    return out


@pytest.mark.parametrize("n", [1, 9, 700])
def test_as_defined(spark, n):
    langs = ["de", None, "en", "", "é", "zz", "a", "b", "c", "d1", "d2"]
    rows = [(i * 7 % n, [None, "", f"Text {i} É", "A long Text " * 300][i % 4], langs[i % len(langs)] if i % 3 else "de", [None, "s", "src"][i % 3], [None, i][i % 2], "x", 1) for i in range(n)]
    rows += rows[:2] + ([(None, "No id", "de", "s", 1, "x", 1)] * 2 + [(5, "Same id", "de", "s", 1, "x", 1)] if n > 1 else [])
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, KIND)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))


def test_same_as_duckdb(spark):
    rows = [(i, f"Text {i}" if i % 9 else None, ["de", "en", None][i * i % 3], "s", i) for i in range(300)]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = duckdb.connect().execute("with documents as (select * from docs) select * from (" + merkle.merkle_sql() + ")").df()
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), want.sort_values("doc_id", ignore_index=True)[list(got.columns)], check_dtype=False)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], KIND)).count() == 0
