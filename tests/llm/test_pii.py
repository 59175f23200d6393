import hashlib
import math
import random
import re
import statistics

from pyspark.sql import functions as F

from voxloom.llm import pii


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    number = lambda v: re.sub("[^0-9]", "", v)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(number(v)) <= 19 and luhn(number(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(number(v)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans(spark):
    rng = random.Random(6)
    parts = ["a", "b.c", "_", "@", "é", "😀", "\x01", "\x02", "1", "25", "255", "256", "0300", ".", "-", " ", "+", "+1", "(", ")", "4111111111111111", "4111 1111-1111 1111", "x@y.zz", "\n", "555-3949", "%"]
    texts = [None, "", "+", "1"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 18))) for _ in range(1500)]
    texts += ["1 " * 60_000, "a" * 200_000 + "@b", "7" * 100_000, "a@b.c " * 3000, "1.2.3.4." * 2000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a@b.cc", 0), (3, "1", 0)], "doc_id long, text string, spans int").repartition(8)
    rows = pii.digest(pii.personal_data(docs)).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        want = brute(t or "")
        r = got[i]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.KINDS[:4]), t
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term:")) == joined
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_revealing_terms(spark):
    rng = random.Random(8)
    vocabulary = [a + b for a in "river stone market engine winter letter garden number people water".split() for b in ("", "s", "ed", "er")]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(30)]
        if i % 30 == 0:  # one person, each time in other words; the nickname stands by the address alone
            words[15:15] = ["from", "zed@mail.example", "as", "ever"]
            words.insert(rng.choice([11, 12, 13, 14, 20, 21, 22]), "Zorblax")
            words[1:1] = ["zorblax"]
        if i % 30 == 2:  # near copies of one passage
            words = "some passage that was copied by qwertz with y@copy.example in it and the rest".split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if i % 30 == 1:  # copies of one passage with another address
            words = ["the", "qwerty", "passage", "with", "x@copy.example", "in", "it"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(docs)
    by = {r.doc_id: r.spans for r in found.collect()}
    for i, text in rows:
        terms = [text[s.start : s.end].lower() for s in by[i] if s.kind == "term"]
        assert terms.count("zorblax") == (2 if i % 30 == 0 else 0)
        assert not set(terms) & {"qwerty", "qwertz", *vocabulary}
    clean = found.join(docs, "doc_id").select("doc_id", F.coalesce("sanitised", "text").alias("t")).collect()
    assert all((r.sanitised is None) == (not r.spans) for r in found.collect())
    for r in clean:
        assert "zorblax" not in r.t.lower() and "@" not in r.t
        if r.doc_id % 30 == 0:
            assert "[email]" in r.t and "[name]" in r.t
        elif r.doc_id % 30 > 2:
            assert r.t == rows[r.doc_id][1]


def test_terms_in_a_fixed_signature(spark):
    rng = random.Random(9)
    vocabulary = [a + b for a in "river stone market engine winter letter garden number people water".split() for b in ("", "s", "ed", "er")]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(30)]
        if i % 30 == 0:  # always the same neighbours, in documents that differ
            words[15:15] = ["Contact:", "Maria", "Lopez", "<m@mail.example>,", "Li", "r2d2"]
        if i % 30 == 1:  # near copies, more than SUPPORT of them changed beside the name
            words = "some passage that was copied by Paula Qwertz with y@copy.example in it and the rest".split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        terms = {text[s.start : s.end] for s in got[i] if s.kind == "term"}
        assert {"Maria", "Lopez", "Li", "r2d2"} <= terms if i % 30 == 0 else not terms, text


def test_scores_are_those_of_the_formula(spark):
    rng = random.Random(12)
    vocabulary = [a + b for a in "river stone market engine winter letter garden".split() for b in ("", "s", "ed")]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(4, 25))]
        for e in rng.sample(range(6), rng.choice([0, 0, 1, 1, 2])):
            words.insert(rng.randrange(len(words)), f"p{e}@mail.example")
            if rng.random() < 0.7:
                words.insert(rng.randrange(len(words)), f"Nick{e}")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc bigint, text string")
    found = docs.select("doc", "text", pii.entities(F.col("text")).alias("entities")).where(F.size("entities") > 0)
    again = pii.recurring(found)
    got = {(r.entity, r.term): (r.support, r.disclosed) for r in pii.disclosures(found, again, docs).collect()}

    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    has, terms = {}, {}
    for i, t in rows:
        for e in {m[0] for m in re.finditer(r"p\d@mail\.example", t)}:
            has.setdefault("email:" + e, {})[i] = split(re.sub(r"p\d@mail\.example", "\x03", t))
        for w in set(split(t)):
            terms[w] = terms.get(w, 0) + 1
    want = {}
    for e, own in has.items():
        if len(own) < pii.SUPPORT:
            continue
        pairs = {i: {*zip(w, [*w[1:], None])} for i, w in own.items()}
        count = lambda p: sum(p in x for x in pairs.values())  # noqa: B023, E731
        weight = {i: 1 / float(statistics.median([count(p) for p in ps])) for i, ps in pairs.items()}
        for term in {w for x in own.values() for w in x}:
            both = [i for i, x in own.items() if term in x]
            support = sum(weight[i] for i in both)
            if round(support, 6) >= pii.SUPPORT:
                want[e, term] = support, math.log2(len(both) * len(rows) / (terms[term] * len(own))) / math.log2(len(rows) / len(own))
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert {t for (e, t), (_, d) in got.items() if d >= pii.DISCLOSED} == {f"nick{k}" for k in range(6)}


def test_an_entity_in_a_third_of_all_documents(spark):
    rng = random.Random(13)
    rows = [(i, " ".join([f"w{rng.randrange(4000)}" for _ in range(12)] + (["info@desk.example", "Deskname"] if i % 3 == 0 else []))) for i in range(1500)]
    got = {r.doc_id: [s.value for s in r.spans if s.kind == "term"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(("Deskname" in got[i]) == (i % 3 == 0) for i, _ in rows)
