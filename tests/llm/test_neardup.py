import random
import re

import numpy as np
import pyarrow as pa

from voxloom.llm import graph, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, size=4):
    """doc_id -> (n_shingles, component_id) by comparing all pairs of documents."""
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 9, 30, 120, 400]))] for _ in range(25)]
    docs = []
    for words in base:
        for _ in range(rng.choice([1, 2, 5, 25])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append(" ".join(own).upper() if rng.random() < 0.2 else "\n\t ".join(own))
    docs += [None, "", "  ", None, "one", "One", "a b", "A  b", "É é É é", "é é É é", "x " * 30_000]
    return list(enumerate(docs))


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, band int")
    want = brute(docs)
    for block in (512, 5):  # the second makes several blocks of a bucket
        monkeypatch.setattr(neardup, "BLOCK_CLASSES", block)
        got = {r.doc_id: r for r in neardup.near_duplicates(df, size=4).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "None")]


def test_signature_is_unbiased_and_early_stopping_exact():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(x[:220]), np.unique(x[80:])
        s = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / 300)
        alone = neardup.signatures(a, np.array([0, len(a)]))
        assert (alone[0] == s[0]).all() and (alone != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < 0.045


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (70, 100), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 70: 50, 100: 50}


def test_short_texts():
    h, ends = neardup.shingles(pa.array(["a b", "A B", "a", None, "a b c d", "b a"]), 4)
    assert np.diff(ends).tolist() == [1, 1, 1, 0, 1, 1]
    assert h[0] == h[1] != h[4]
