"""Cutting-stock packing: ids against the tokenizer, exact round trips, and the program's optimum by duality over all patterns."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxloom.llm import cutting

PATH = public_tokenizers.path(cutting.VOCABULARY)


def test_ids_are_the_tokenizers():
    ids, whole, draw = cutting.Ids(PATH), Tokenizer.from_file(PATH), random.Random(3)
    some = list("abZ'sdtlve12  \n\t\r\x0b\x1c\x1d\u0085  　é日本字ไทย!#<|>.,öŉ×÷½²̀\0") + ["'ll", " 's", "''s", "<|endoftext|>", "  \n", "word", " The", "x" * 60]
    for _ in range(20):
        texts = ["".join(draw.choice(some) for _ in range(draw.randrange(60))) for _ in range(200)]
        got, bounds = ids.of(pa.array(texts))
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert got[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, text
    for text in ("日本語の文章。" * 3000, "QUJD" * 9000, "สวัสดีชาวโลก" * 2000, "a b  c " * 4000):
        got, _ = ids.of(pa.array([text]))
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert all(len(x) <= cutting.LONG_PIECE for x in ids.known)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(cutting, "REMEMBERED_BYTES", 50_000)
    ids, whole = cutting.Ids(PATH), Tokenizer.from_file(PATH)
    for k in range(20):
        text = " ".join(f"word{k}x{i}" for i in range(100))
        assert ids.of(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids
        assert ids.size < 50_000 + 200 * 400


def every_pattern(lengths, size):
    if size == 0:
        return [()]
    return [(n, *rest) for n in lengths if n <= size for rest in every_pattern([x for x in lengths if x <= n], size - n)]


@pytest.mark.parametrize("seed", range(4))
def test_program_is_optimal(seed):
    draw = random.Random(seed)
    counts = {n: draw.randrange(40, 90) for n in draw.sample(range(1, 16), 8)}
    program = cutting.Program(counts, 16)
    found = program.solve(0.0)
    for _ in range(200):  # to the very end: solve() may stop when it gains little
        if not any([program.enter(None, [int(i)], [1], 0.0) for i in np.flatnonzero(program.prices < -cutting.GAIN)] + [program.offer(p) for p in program.cheapest()]):
            break
    assert found and (program.prices > -1e-5).all()
    for size in (1, 2, 4, 8, 16):
        for pattern in every_pattern(sorted(counts, reverse=True), size):
            assert size - 1 <= sum(program.prices[program.row[n]] for n in pattern) + 1e-4  # no pattern gains
    top = sum(program.prices[program.row[n]] * k for n, k in counts.items())
    assert program.gain @ program.value == pytest.approx(top, abs=0.5)  # equals its dual bound but for the moved counts


@pytest.mark.parametrize("counts", [{700: 50}, {512: 3, 1: 1}, {n: 1 for n in range(1, 1024)}, {n: 500 + n for n in range(3, 900, 7)}, {}])
def test_patterns_are_whole_and_within_the_counts(counts):
    used = Counter()
    for times, pattern in cutting.patterns(dict(counts), 1024):
        total = sum(n * k for n, k in pattern.items())
        assert total <= 1024 and total & (total - 1) == 0
        for n, k in pattern.items():
            used[n] += times * k
    assert all(k <= counts[n] for n, k in used.items())


def check(docs, rows, capacity):
    whole, own, sequences = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
    want = {}
    for doc_id, text in docs:
        want.setdefault(doc_id, []).append(whole.encode(text or "", add_special_tokens=False).ids + [0])
    assert set(want) == set(own)
    for doc_id, pieces in own.items():
        if len(want[doc_id]) > 1:
            assert sum(r.length for r in pieces) == sum(map(len, want[doc_id]))
            continue
        ids, at = want[doc_id][0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("few", [200_000, -1])
def test_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(cutting, "FEW", few)
    draw = random.Random(5)
    docs = [(i, [None, "", "one two", " ".join(f"w{draw.randrange(999)}" for _ in range(draw.randrange(1, 500)))][i % 4 if i % 3 else 3]) for i in range(400)]
    docs += [(900, "long text " * 9000), (901, "日本語" * 900), (None, "no id"), (0, "again"), (0, "again"), (902, "<|endoftext|> a")] + [(2000 + i, "the same copy of a text") for i in range(300)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, length string, task int").repartition(7)
    rows = cutting.pack_by_patterns(frame).collect()
    check(docs, rows, 1024)
    check(docs[:50], cutting.pack_by_patterns(frame.where("doc_id < 50 and text <> 'again' or doc_id < 50 and text is null"), capacity=256).collect(), 256) if few < 0 else None
    assert cutting.pack_by_patterns(frame.limit(0)).count() == 0


def test_equal_lengths_that_make_no_whole_are_cut(spark):
    docs = [(i, "word " * 699) for i in range(60)]
    rows = cutting.pack_by_patterns(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(docs, rows, 1024)
    assert len(rows) <= 60 + 60 * 700 // 1024 + 12


def test_plain_pieces_go_in_one_call_and_are_not_remembered():
    ids, whole, calls = cutting.Ids(PATH), Tokenizer.from_file(PATH), []
    once = ids.lines.encode_to_numpy
    ids.lines.encode_to_numpy = lambda *a, **b: calls.append(a) or once(*a, **b)
    texts = ["", None, "One two\nthree\r\n four 5 5 -- two", "\n\n", " ", "Ärger ×7 ÿ", "words don't\tend", "one"]
    got, bounds = ids.of(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert got[a:b].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
    assert len(calls) == 1 and not {"One", " two", "-", "5"} & set(ids.known) and "\n" in "".join(ids.known)
    for texts in ([], [""], [None], ["\n"], ["日本"]):
        assert ids.of(pa.array(texts, pa.string()))[0].tolist() == [i for x in texts for i in whole.encode(x or "", add_special_tokens=False).ids]
