import math
import random
import re
import statistics
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa

from voxloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    triples = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(hit)


def test_base_measures(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b\na b\n\na b", "é ß x\x85y \x1c z", "a " * 90_000, "A#\x0b|<>"]
    texts += ["".join(rng.choice("ab \n#\té") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, 1) for i, t in enumerate(texts)] + [(None, "x", None, 1)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality(docs.limit(0)).count() == 0


def test_distance():
    assert math.isclose(quality.distance(np.array([[1.0, 0]]), np.array([0.0, 1]))[0], 1)
    assert quality.distance(np.array([[0.5, 0.5]]), np.array([0.5, 0.5]))[0] == 0


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(2)
    vocabulary = "the of and to in is was for that with on by this from are or an at be it river stone market engine winter letter garden number people water".split()
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(rng.randint(60, 300)), "en") for i in range(200)]
    rows += [(1000, prose(150).upper(), "en"), (1001, " ".join(f"{x}$$$" for x in prose(150).split()), "en"), (1002, " ".join(str(rng.random()) for _ in range(200)), "en")]
    kept = {r.doc_id for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == set(range(200))


def test_a_lone_slice_of_nothing():
    assert quality.repeated_lines(pa.array(["", None])).tolist() == [0, 0]


def test_every_language_has_a_reference(spark):
    rng = random.Random(5)
    many = quality.LANGUAGES + 20
    rows = []
    for k in range(many):
        vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(10 * k + i, " ".join(rng.choice(vocabulary) for _ in range(70)), f"l{k:03}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(got[i].near_lang == lang and got[i].kept for i, _, lang in rows if not got[i].base_failed)
    assert {got[i].near_lang for i, _, _ in rows} == {lang for _, _, lang in rows}
    whole = {r.doc_id: r for r in quality.judge(docs, quality.references(docs, at_once=10 * many)).collect()}
    assert whole == got


def brute_verdicts(rows):
    """The verdict by its definition, a document at a time."""

    def kind(c):
        if c in " \t\n\x0b\x0c\r":
            return 0
        g = unicodedata.category(c)
        return 4 if c in "#*$%&|<>" else {"Ll": 1, "Lu": 2, "Nd": 3, "Lo": 6, "Lm": 6, "Lt": 6}.get(g, 5 if g[0] in "PS" else 7)

    def histogram(t):
        h = [0] * 8
        for c in t:
            h[kind(c)] += 1
        return h

    bare = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())
    refs = {}
    for lang in {x for _, _, x in rows if x}:
        own = [t or "" for _, t, x in rows if x == lang]
        shares = [[h * quality.STEPS // len(t) for h in histogram(t)] for t in own if t]
        medians = [statistics.median(s[k] for s in shares) for k in range(8)]
        docs, mass = Counter(), Counter()
        for t in own:
            words = [bare(w) for w in WORD.findall(t)]
            for w, n in Counter(words).items():
                if w:
                    docs[w] += 1
                    mass[w] += n * quality.SHARE // len(words)
        common = sorted(docs, key=lambda w: (-docs[w], w))[: quality.COMMON]
        refs[lang] = [m / sum(medians) for m in medians], {w: mass[w] / (quality.SHARE * len(own)) for w in common}

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    out = {}
    for i, t, _ in rows:
        t = t or ""
        words, n_chars = [bare(w) for w in WORD.findall(t)], len(t)
        found, best = Counter(words), None
        for lang, (characters, common) in sorted(refs.items()):
            cd = js([h / n_chars for h in histogram(t)], characters) if n_chars >= quality.MIN_CHARACTERS else 0
            p, q = [found[w] / max(1, len(words)) for w in common], [*common.values()]
            wd = js([*p, max(0, 1 - sum(p))], [*q, max(0, 1 - sum(q))]) if len(words) >= quality.MIN_COMPARED_WORDS else 0
            limits = quality.MAX_CHARACTER_DISTANCE * (1 + quality.CHARACTER_SCATTER / max(1, n_chars)), quality.MAX_WORD_DISTANCE * (1 + quality.SCATTER / max(1, len(words)))
            over = max(cd / limits[0], wd / limits[1])
            if best is None or over < best[0] - 1e-12:
                best = over, lang, cd, wd
        n_words, *_, repeats = brute(t)
        failed = n_words < 50 or 100 * repeats > 50 * n_words
        out[i] = (not failed and best[0] <= 1, *best[1:])
    return out


def test_verdicts_are_those_of_the_definition(spark):
    rng = random.Random(9)
    vocabularies = {"a": "the of and to in it was for river stone market".split(), "b": "der die und das mit von fluss stein markt".split(), "c": "𐐀𐐁 𐐂𐐃 𐐄 𐐅𐐆𐐇 𝒳 ΑΒ".split()}
    rows = [(i, None if i == 5 else " ".join(rng.choice(vocabularies[k]) + rng.choice(["", "", ",", ".", "!", "$", "7"]) for _ in range(rng.randint(1, 160))), k) for i, k in enumerate("abc" * 40)]
    rows += [(200 + i, " ".join(rng.choice(["#$", "12", "the", "X" * 9, "&&"]) for _ in range(90)), None) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, (kept, lang, cd, wd) in brute_verdicts(rows).items():
        r = got[i]
        assert (r.kept, r.near_lang) == (kept, lang) and abs(r.character_distance - cd) < 1e-9 and abs(r.word_distance - wd) < 1e-9, (i, r)
    assert {r.kept for r in got.values()} == {True, False}
