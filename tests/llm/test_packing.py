import random
import subprocess
import sys
import zlib
from bisect import bisect_left, insort
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from voxloom.llm import packing


def sequential(lengths, capacity):
    """Best fit decreasing, one piece at a time."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        if at == len(rooms):
            n += 1
            insort(rooms, capacity - x)
        else:
            insort(rooms, rooms.pop(at) - x)
    return n, rooms


def test_plan_is_that_of_the_sequential_algorithm():
    rng = random.Random(3)
    for case in range(60):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        bins = {}
        for length, first, last, start, base, each in packing.best_fit_decreasing(counts, capacity):
            for k in range(last - first):
                bins.setdefault(start + k // each, []).append((base + k % each * length, length))
        for spots in bins.values():
            end = 0
            for at, length in sorted(spots):
                assert at == end
                end += length
            assert end <= capacity
        n, rooms = sequential(lengths, capacity)
        assert len(bins) == n
        assert sorted(capacity - sum(y for _, y in x) for x in bins.values()) == rooms
        assert sum(map(len, bins.values())) == len(lengths)


def test_ids_are_the_tokenizers(spark):
    texts = ["", None, "Don't   STOP's 'LL\n1½²3 !!?? Éa…", "x" * 70, "İstanbul ŉ Σας ́é \x85\xa0\x1c日本語", "ÀÉ ſ\t\x0b\x0c\r<|endoftext|>", "word " * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null id")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in sequences.values():
        end = 0
        for at, length in sorted(spots):
            assert at == end
            end += length
        assert end <= 2048
    for i, text in enumerate(texts):
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_added_tokens_are_read_as_in_the_loaded_file():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y<|endoftext|>", "A <|ENDOFTEXT|> B", "<|STARTOFTEXT|> z", "a <| b |>", "plain words"]
    tokenizer = Tokenizer.from_file(path)
    ids, bounds = packing.Ids(path).of(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert got[0] == [320, 49407, 321]


def test_words_ids_make_up_those_of_any_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(11)
    parts = ["a", "Don", "'s", "'LL", "'", "1", "½", "²", "!!", "ß", "É", "ſ", "İ", "ŉ", "\u0301", "Σ", "ς", "日本", "\xa0", "\u2003", "\x85", "\x1c", "’", "<|", "endoftext", "|>", "<|endoftext|>", " ", "\n", "\t", "🙂", "️", "क्षि", "ﬁ", "\x00", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    tokenizer, ids = Tokenizer.from_file(path), packing.Ids(path)
    for at in range(0, len(texts), 500):
        found, bounds = ids.of(pa.array(texts[at : at + 500]))
        for text, a, b in zip(texts[at : at + 500], bounds, bounds[1:]):
            assert found[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_text_without_spaces_is_not_remembered():
    path = public_tokenizers.path(packing.VOCABULARY)
    plain, ids = Tokenizer.from_file(path), packing.Ids(path)
    rng = random.Random(5)
    run = lambda a, b, n: "".join(chr(rng.randrange(a, b)) for _ in range(n))
    texts = [run(0x4E00, 0x9FA5, 3000), run(0xE01, 0xE2F, 500) + " short " + run(97, 123, 200), run(33, 127, 5000), "short", ""]
    whole, packing.REMEMBERED_BYTES = packing.REMEMBERED_BYTES, 2000
    try:
        for _ in range(3):
            got, bounds = ids.of(pa.array(texts))
            for text, a, b in zip(texts, bounds, bounds[1:]):
                assert got[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids
            assert max(map(len, ids.known)) <= packing.LONG_PIECE and ids.lists.count == len(ids.known)
        assert ids.size > 2000
        ids.of(pa.array(["new"]))
        assert set(ids.known) == {"new"}
    finally:
        packing.REMEMBERED_BYTES = whole


HELD = """
import random, re
import public_tokenizers, pyarrow as pa
from voxloom.llm import packing
from voxloom.llm.common import slices
most = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
ids, rng = packing.Ids(public_tokenizers.path(packing.VOCABULARY)), random.Random(7)
texts = [" ".join("".join(rng.choices("etaoinshrdlucm", k=8)) for _ in range(3000)) for _ in range(200)]
rows = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
before = most()
for part in slices(rows, "text", packing.SLICE_BYTES // 2):
    ids.of(part.column("text"))
print(most() - before)
"""


def test_new_words_without_end_take_little_memory():
    out = subprocess.run([sys.executable, "-c", HELD], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True).stdout
    assert float(out) < 130
