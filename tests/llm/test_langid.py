import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers

from voxloom.llm import langid


def brute(word, p, pieces):
    """Sum over all segmentations by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(langid.LONGEST_PIECE, len(word)) + 1):
        q = p.get(word[:n], langid.UNKNOWN if n == 1 else 0.0)
        if q:
            total += q * brute(word[n:], p, pieces)
    return total


def test_forward_sums_all_segmentations():
    path = public_tokenizers.path(langid.VOCABULARY)
    model = langid.learn({"a": {"▁the": 5, "▁other": 2, "▁thing": 1}, "b": {"▁die": 5, "▁andere": 2}}, langid.Pieces.make(path), rounds=3)
    names = langid.pieces_of(path)
    numbers = {}
    for x in names:
        numbers[x] = int(model.pieces.lattice([x], len(x))[-1][0, 0])
    assert sorted(numbers.values()) == list(range(1, len(names) + 1))
    assert np.allclose(model.p.sum(0), 1)
    for k in range(2):
        p = {x: model.p[i, k] for x, i in numbers.items()}
        for word in ["▁the", "▁andere", "▁zß", "▁ж"]:
            got = langid._forward(model.pieces.lattice([word], len(word)), model.p)[len(word)][0, k]
            assert math.isclose(got, brute(word, p, names), rel_tol=1e-9)


def test_no_piece_is_too_long():
    import sentencepiece

    path = public_tokenizers.path(langid.VOCABULARY)
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {whole.id_to_piece(i).lower() for i in range(whole.get_piece_size())}
    assert {x for x in pieces if x.removeprefix(langid.BEGIN).isalpha()} <= set(langid.pieces_of(path))
    model = langid.learn({"a": {"▁recommendations": 3}, "b": {"▁andere": 2}}, langid.Pieces.make(path), rounds=2)
    assert model.pieces.lattice(["▁recommendations"], 16)[-1][0, 0] > 0


def test_identify(spark):
    en = "the cat sat on the mat and then it went to the other room with another thing"
    de = "der hund lief über die straße und dann ging er nach hause weil er müde war"
    rows = [(i, f"{en} {i}" if i % 2 else f"{de} {i}", "en" if i % 2 else "de", "x") for i in range(80)]
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "12 ... 3", None, "x"), (None, en, "en", "x"), (103, "THE CAT " * 30000, None, "x"), (104, "ß" * 5000, None, None), (1, f"{en} 1", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in range(80):
        assert by[i].lang_pred == ("en" if i % 2 else "de") and 0 <= by[i].score <= 1
    assert [by[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    assert by[None].lang_pred == "en" and by[None].held_out is False
    assert langid.identify(docs.limit(0)).count() == 0
    none = langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0


def test_long_words_are_summed_whole():
    path = public_tokenizers.path(langid.VOCABULARY)
    pieces = langid.Pieces.make(path)
    model = langid.learn({"a": {"▁the": 5, "▁other": 2}, "b": {"▁die": 5, "▁andere": 2}}, pieces)
    words = ["▁" + "otherandere" * 3, "▁" + "ж" * 20 + "the" * 4 + "a"]
    for n in {len(w) for w in words}:
        own = [w for w in words if len(w) == n]
        want = np.log(langid._forward(pieces.lattice(own, n), model.p)[n])
        assert np.allclose(langid.log_probabilities(own, [model]), want)
    long = "▁" + "otherdie" * 1500  # far below the least double
    got = langid.log_probabilities([long], [model])[0]
    assert np.isfinite(got).all() and (got < -1000).all()
    whole, langid.STRETCH = langid.STRETCH, 100
    try:
        assert np.allclose(langid.log_probabilities([long], [model])[0], got)
    finally:
        langid.STRETCH = whole


def test_words_of_any_script_score_as_one_by_one():
    rng = np.random.default_rng(8)
    pieces = langid.Pieces.make(public_tokenizers.path(langid.VOCABULARY))
    counts = {"a": {"▁the": 5, "▁other": 2, "▁日本語": 3}, "b": {"▁die": 5, "▁andere": 2, "▁中文": 4, "▁ไทย": 2}}
    models = [langid.learn({k: counts[k]}, pieces) for k in counts] + [langid.learn(counts, pieces)]
    alphabets = [[chr(c) for c in range(a, b)] for a, b in ((97, 123), (0x4E00, 0x9FA5), (0xE01, 0xE2F), (0x430, 0x450), (0x10400, 0x10428))]
    words = ["▁" + "".join(rng.choice(alphabets[k % 5], rng.integers(1, 90))) for k in range(300)]
    words += ["▁", "▁a", "▁" + "中" * 400, "▁" + "the" * 40]
    want = np.concatenate([np.concatenate([np.log(langid._forward(pieces.lattice([w], len(w)), m.p)[len(w)]) for w in words]) for m in models], axis=1)
    normal = want > -690  # beyond, the plain pass runs out of normal doubles
    assert 400 < normal.sum() < normal.size
    for stretch in (langid.STRETCH, 50):
        whole, langid.STRETCH = langid.STRETCH, stretch
        try:
            got = langid.log_probabilities(words, models)
        finally:
            langid.STRETCH = whole
        assert np.isfinite(got).all() and np.allclose(got[normal], want[normal], rtol=1e-10)
    assert langid.log_probabilities([], models).shape == (0, 4) and langid.log_probabilities(["▁a"], []).shape == (1, 0)


def test_what_is_remembered_is_bounded():
    pieces = langid.Pieces.make(public_tokenizers.path(langid.VOCABULARY))
    scores = langid._Scores([langid.learn({"a": {"▁the": 5}, "b": {"▁die": 5}}, pieces)])
    tokens = ["the", "x" * 60, "1", "中" * 300, "die"]

    def of(x):
        rows = scores.of(x)  # before its table is looked at
        return scores.table[rows]

    first = of(tokens)
    assert set(scores.known) == {"the", "1", "die"}
    again = of(tokens[::-1])[::-1]
    assert np.allclose(first, again) and len(scores.table) == 5
    whole, langid.REMEMBERED_BYTES = langid.REMEMBERED_BYTES, 100
    try:
        assert np.allclose(of(tokens), first) and scores.size < 1000
        scores.of(["new"])
        assert set(scores.known) == {"new"}
    finally:
        langid.REMEMBERED_BYTES = whole


HELD = """
import random, re
import public_tokenizers, pyarrow as pa
from voxloom.llm import langid
from voxloom.llm.common import coded_words, slices
most = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
pieces, rng = langid.Pieces.make(public_tokenizers.path(langid.VOCABULARY)), random.Random(7)
scores = langid._Scores([langid.learn({x: {"▁the": 5} for x in "abcd"}, pieces)])
texts = [" ".join("".join(rng.choices("etaoinshrdlucm", k=8)) for _ in range(3000)) for _ in range(200)]
rows = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
before = most()
for part in slices(rows, "text", langid.SLICE_BYTES):
    scores.of(coded_words(part.column("text"))[1])
print(most() - before)
"""


def test_new_words_without_end_take_little_memory():
    out = subprocess.run([sys.executable, "-c", HELD], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True).stdout
    assert float(out) < 150


def test_every_language_is_learned_whatever_the_block(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(9):
        vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(15)]
        rows += [(100 * k + i, " ".join(rng.choice(vocabulary, 20)), f"l{k}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = (langid.identify(docs, block=n).collect() for n in (64, 2))
    assert [r[:3] for r in sorted(one)] == [r[:3] for r in sorted(many)]
    by = {i: lang for i, _, lang in rows}
    assert all(by[r.doc_id] == r.lang_pred for r in one)
    assert all(abs(a.score - b.score) < 1e-6 for a, b in zip(sorted(one), sorted(many)))


def test_noise_fits_no_language(spark):
    rng = np.random.default_rng(6)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    learned = langid.train(docs)
    noise = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäñé"), rng.integers(2, 12))) for _ in range(40))) for i in range(50)]
    odd = spark.createDataFrame([*noise, (90, None), (91, "1 2"), (92, "ж" * 500)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd.withColumn("FIT", langid.F.lit("x")), learned, fit_as="fit").collect()}
    assert all(got[i].fit <= 0 for i, _ in noise) and got[90].fit is got[91].fit is None and got[92].fit <= 0
    real = langid.predict(docs, learned, fit_as="fit").where("length(text) > 20").collect()
    assert sum(r.fit is None or r.fit <= 0 for r in real) == 0, [r.text[:200] for r in real if r.fit is None or r.fit <= 0]
