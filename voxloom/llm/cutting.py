"""Packing into sequences without padding: cutting stock by column generation on the histogram of lengths.

A document longer than a sequence gives whole sequences, and what is left of it is shorter than one. Those lengths are one of 1 to
`capacity` - 1, so the problem that the driver solves has as many rows as there are lengths, for any number of documents: a linear
program over patterns (multisets of lengths that fill a sequence of a power of two exactly), whose columns are priced by knapsack
dynamic programming. Rounded patterns take documents by their rank within a length; documents that no whole pattern takes are
laid end to end and cut at sequences' ends. So nothing is padded, and the cuts beyond those of long documents are about as many as the
rows of the program, not as the documents.

Texts are tokenised where they lie, once. A task numbers its documents of each length as it goes; with running totals of the tasks'
counts that is the rank, and no text, key or length is gathered in one task. The ids of short ends are written beside the
rows, since what a cut piece holds isn't known before the program is solved; only ends that are cut are read again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, freed, slices, written
from .packing import Lists

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Bytes of text pieces and their ids that a task remembers, and the longest piece that is worth it; plain pieces are not remembered.
REMEMBERED_BYTES = 100_000_000
LONG_PIECE = 48
#: Rows of ends to cut up to which their keys are broadcast.
FEW = 200_000
#: Tokens that a column must gain.
GAIN = 1e-6
#: Rounds of prices after which the program's gain is looked at, and patterns that enter in one.
ROUNDS = 10
ENTER = 40

SPACE, LETTER, DIGIT, MARK, QUOTE, ODD = range(6)


def _kinds() -> np.ndarray:
    """The kind of each byte that is a character; those beyond ASCII and what isn't printed are odd."""
    kind = np.full(256, ODD, np.uint8)
    kind[0x21:0x7F] = MARK
    for k, characters in ((SPACE, b"\t\n\x0b\x0c\r "), (DIGIT, b"0123456789"), (QUOTE, b"'")):
        kind[list(characters)] = k
    kind[[c for c in range(128) if chr(c).isalpha()]] = LETTER
    return kind


_KIND = _kinds()
#: Whether text may be cut between a character of one kind (row) and one of another.
_CUT = np.zeros((6, 6), bool)
_CUT[[LETTER, DIGIT, MARK, QUOTE], SPACE] = True
_CUT[[LETTER, LETTER, LETTER, DIGIT, DIGIT, DIGIT, MARK, MARK], [DIGIT, MARK, QUOTE, LETTER, MARK, QUOTE, LETTER, DIGIT]] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts' pieces, cut where the tokenizer's pattern surely cuts, and where each text's begin and end.

    The pattern takes white space only at the front of a piece, and letters, digits and marks apart but for an apostrophe and the
    letters after it. Letters are those of ASCII and U+00C0 to U+017F; no cut is made beside any other character that isn't
    printed ASCII, so what may be white space, a mark or a letter elsewhere stays in one piece with its neighbours.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(data)
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    latin = lead[(data[lead] != 0xC3) | (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = LETTER
    start = np.zeros(n + 1, bool)
    start[1:n] = _CUT[kind[:-1], kind[1:]]
    start[offsets] = True
    at = np.flatnonzero(start)
    runs = at[:-1] if len(at) and at[-1] == n else at
    pieces = pa.StringArray.from_buffers(len(runs), pa.py_buffer(np.append(runs, n).astype(np.int32)), pa.py_buffer(data))
    return pieces, np.searchsorted(runs, offsets)


def ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Tokens' bytes by id. In the vocabulary printed bytes stand for themselves and the others, in order, for the characters from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


#: Pieces that the tokenizer's pattern leaves whole.
_PLAIN = r"^ ?(?:[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)\z"


class Ids:
    """The tokenizer's ids of whole texts, from those of their pieces; each distinct piece of a slice is tokenised once.

    Pieces that the pattern leaves whole are merged by the vocabulary's ranks, which is the same and faster: all of a slice go in one
    call, a line each, which costs less than to look them up. All others go to the tokenizer; the short ones are remembered, bounded in
    bytes. A text with an added token's content (`<|endoftext|>`) goes there whole.
    """

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.lines = Encoding("lines", pat_str=r"\n|[^\n]+", mergeable_ranks=ranks(self.tokenizer.get_vocab(with_added_tokens=False)), special_tokens={})
        self.line_end = self.lines.encode_single_token("\n")
        self.forget()

    def forget(self) -> None:
        self.known, self.lists, self.size = {}, Lists(), 0

    def merged(self, plain: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces, end to end, and how many each has; none of them holds a line's end."""
        if not len(plain):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py()
        ids = self.lines.encode_to_numpy(text, disallowed_special=())
        ends = ids == self.line_end
        return ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1, append=len(ids)) - 1

    def learn(self, new: list[str]) -> None:
        self.known.update(zip(new, range(self.lists.count, self.lists.count + len(new))))
        got = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        self.lists.add(np.asarray(got.ids, np.uint32), np.bincount(np.asarray(got.word_ids, np.int64), minlength=len(new)))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for content in self.added:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        pieces, starts = cut(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
        coded = pieces.dictionary_encode()
        whole = pc.match_substring_regex(coded.dictionary, _PLAIN)
        plain, others = coded.dictionary.filter(whole), coded.dictionary.filter(pc.invert(whole)).to_numpy(zero_copy_only=False).tolist()
        if self.size > REMEMBERED_BYTES:
            self.forget()
        new = [x for x in others if x not in self.known]
        if short := [x for x in new if len(x) <= LONG_PIECE]:
            self.learn(short)
            self.size += sum(map(len, short)) * 4 + 180 * len(short)
        mark = self.lists.used, self.lists.count
        if long := [x for x in new if len(x) > LONG_PIECE]:
            self.learn(long)
        number, whole = np.empty(len(coded.dictionary), np.int64), whole.to_numpy(zero_copy_only=False)
        number[~whole] = np.fromiter(map(self.known.__getitem__, others), np.int64, len(others))
        number[whole] = np.arange(self.lists.count, self.lists.count + len(plain))
        self.lists.add(*self.merged(plain))
        ids, ends = self.lists.take(number[coded.indices.to_numpy(zero_copy_only=False)])
        for x in long:
            del self.known[x]
        self.lists.trim(*mark)
        bounds = np.concatenate([[0], ends])[starts]
        if special.any():
            parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            for k in np.flatnonzero(special):
                parts[k] = np.asarray(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds


_loaded: dict[str, Ids] = {}


def token_ends(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole sequences of each document's ids and END, and its end: doc_id, start, length, ids_crc32, doc_tokens, ids (of ends), task, rank.

    A null text is empty; an empty text has END alone. rank numbers a task's rows of each length. Rows are only of use
    once written, since another run may deal documents to tasks in another way.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def tokenised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found, task = _loaded.get(path) or _loaded.setdefault(path, Ids(path)), TaskContext.get().partitionId()
        end, seen = np.asarray([END], "<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch, "text", 2 * SLICE_BYTES):
                ids, bounds = found.of(part.column("text"))
                data, rows = ids.astype("<u4", copy=False).tobytes(), []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own, n = data[4 * a : 4 * b] + end, b - a + 1
                    for at in range(0, n, capacity):
                        piece = own[4 * at : 4 * (at + capacity)]
                        size = len(piece) // 4
                        rows.append((i, at, size, zlib.crc32(piece), n, piece if size < capacity else None, task, seen[size]))
                        seen[size] += 1
                columns = list(zip(*rows)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(columns[0], pa.int32())), *(pa.array(x, t) for x, t in zip(columns[1:], kinds))], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "task", "rank"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(tokenised), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, task int, rank long")


class Program:
    """max of the tokens in patterns, less one for each sequence, with no more of each length than there are; a revised simplex method with generated columns.

    Lengths are rows and begin with their slacks as basis. The counts are moved a little, each by its own amount, so that no two
    rows tie and no step is empty.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.lengths, self.capacity, self.counts = sorted(counts), capacity, counts
        self.row = {n: i for i, n in enumerate(self.lengths)}
        m = len(self.lengths)
        self.draw = np.random.default_rng(7)
        self.inverse, self.basis, self.gain = np.eye(m), [None] * m, np.zeros(m)
        self.value = np.array([counts[n] for n in self.lengths]) + 1e-3 * self.draw.random(m)
        self.prices = np.zeros(m)

    def enter(self, pattern: dict[int, int] | None, rows: list[int], copies: list[int], gain: float) -> bool:
        """Puts a column (pattern None: a row's slack) into the basis if it gains at the present prices."""
        rate = gain - sum(self.prices[i] * k for i, k in zip(rows, copies))
        if rate <= GAIN:
            return False
        step = self.inverse[:, rows] @ np.array(copies, float)
        at = np.flatnonzero(step > 1e-9)
        out = at[np.argmin(self.value[at] / step[at])]
        pivot, amount = self.inverse[out] / step[out], self.value[out] / step[out]
        moved, across = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(pivot)
        self.inverse[np.ix_(moved, across)] -= np.outer(step[moved], pivot[across])
        self.inverse[out] = pivot
        self.value -= amount * step
        self.value[out] = amount
        self.basis[out], self.gain[out] = pattern, gain
        self.prices[across] += rate * pivot[across]
        return True

    def offer(self, pattern: dict[int, int]) -> bool:
        """A pattern that asks for more of a length than there are can't be used once, and isn't taken."""
        if any(k > self.counts[n] for n, k in pattern.items()):
            return False
        return self.enter(pattern, [self.row[n] for n in pattern], list(pattern.values()), sum(n * k for n, k in pattern.items()) - 1)

    def cheapest(self) -> list[dict[int, int]]:
        """Patterns that gain most at the present prices, by a knapsack's dynamic programming over what is filled so far: for each length the best that fill a sequence with it, and the best of each smaller power of two."""
        price = np.full(self.capacity + 1, np.inf)
        price[self.lengths] = self.prices + 1e-8 * self.draw.random(len(self.lengths))  # so that equals take turns
        best, last = np.full(self.capacity + 1, np.inf), np.zeros(self.capacity + 1, int)
        best[0] = 0
        for size in range(1, self.capacity + 1):
            total = price[1 : size + 1] + best[size - 1 :: -1] if size > 1 else price[1:2] + best[:1]
            last[size] = k = int(np.argmin(total))
            best[size] = total[k]
        whole = np.concatenate([[np.inf], price[1:] + best[self.capacity - 1 :: -1]])
        starts = [(self.capacity - 1 - whole[n], n, self.capacity - n) for n in self.lengths]
        starts += [(size - 1 - best[size], 0, size) for size in (1 << k for k in range(self.capacity.bit_length() - 1))]
        found = []
        for gain, first, at in sorted(starts, reverse=True):
            if gain <= GAIN or len(found) == ENTER:
                break
            pattern = {first: 1} if first else {}
            while at:
                n = int(last[at]) + 1
                pattern[n] = pattern.get(n, 0) + 1
                at -= n
            found.append(pattern)
        return found

    def solve(self, enough: float) -> list[tuple[float, dict[int, int]]]:
        """(times, pattern) of the optimum, or of the basis from which ROUNDS rounds of prices gain no more than a share `enough` of the tokens."""
        for n in self.lengths:  # the first columns: two lengths that make a whole
            if 2 * n >= self.capacity and (rest := self.capacity - n) in self.row:
                self.offer({n: 1, rest: 1} if n != rest else {n: 2})
        tokens, before = sum(n * k for n, k in self.counts.items()), 0.0
        while True:
            for _ in range(ROUNDS):
                slack = [self.enter(None, [int(i)], [1], 0.0) for i in np.flatnonzero(self.prices < -GAIN)]
                if not any(slack + [self.offer(p) for p in self.cheapest()]):
                    break
            now = float(self.gain @ self.value)
            if now - before <= enough * tokens or tokens - now <= enough * tokens:
                break
            before = now
        return [(x, p) for x, p in zip(self.value.tolist(), self.basis) if p and x > 1e-9]


def patterns(counts: dict[int, int], capacity: int, enough: float = 0.001) -> list[tuple[int, dict[int, int]]]:
    """(times, pattern) in whole numbers: the program's basis rounded down, then one more of a pattern while there are documents for it, then the same for what is left."""
    left, plan = {n: k for n, k in counts.items() if k and n < capacity}, []
    while left:
        found = sorted(Program(left, capacity).solve(enough), key=lambda x: -(x[0] % 1))
        before = len(plan)
        for up in (False, True):
            for x, p in found:
                times = min([1 if up else int(x + 1e-2), *(left.get(n, 0) // k for n, k in p.items())])
                if times > 0:
                    plan.append((times, p))
                    for n, k in p.items():
                        left[n] -= times * k
        left = {n: k for n, k in left.items() if k}
        if len(plan) == before:
            break
    return plan


def packed(ends: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """token_ends' rows, written, as pieces with sequence_id and offset."""
    spark = ends.sparkSession
    sizes = ends.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows

    plan, taken, bins = [], dict.fromkeys(counts, 0), 0
    whole = [(counts[capacity], {capacity: 1})] if capacity in counts else []
    for times, pattern in whole + patterns(counts, capacity):
        base = 0
        for n, k in sorted(pattern.items(), reverse=True):
            plan.append((n, taken[n], taken[n] + times * k, bins, base, k, False))
            taken[n] += times * k
            base += n * k
        bins += times
    rest, few = 0, 0
    for n in sorted(counts):  # the others end to end: `bin` is where the first of a length begins
        if counts[n] > taken[n]:
            plan.append((n, taken[n], counts[n], rest, 0, 1, True))
            rest += n * (counts[n] - taken[n])
            few += counts[n] - taken[n]
    table = spark.createDataFrame(plan, "of long, first long, last long, bin long, base long, each long, is_cut boolean")

    narrow = ends.drop("ids")
    ranked = narrow.join(starts, ["task", "length"]).withColumn("nth", F.col("before") + F.col("rank"))
    spot = (F.col("length") == F.col("of")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("last"))
    placed = ranked.join(F.broadcast(table), spot).withColumn("at", F.col("nth") - F.col("first"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kept = placed.where("not is_cut").select(*out, F.expr("bin + at div each").alias("sequence_id"), (F.col("base") + F.col("at") % F.col("each") * F.col("length")).alias("offset"))
    if not few:
        return kept

    # What is laid end to end is cut at each `capacity`, and the last, shorter stretch into powers of two.
    full, last = rest // capacity, rest % capacity
    cuts, at = [], full * capacity
    for size in (1 << k for k in range(capacity.bit_length(), -1, -1)):
        if last & size:
            cuts.append((at, at + size, bins + full + len(cuts)))
            at += size
    spans = F.expr("cast(array() as array<struct<a:bigint,b:bigint,q:bigint>>)") if not cuts else F.expr("array(" + ", ".join(f"named_struct('a', {a}L, 'b', {b}L, 'q', {q}L)" for a, b, q in cuts) + ")")
    keys = placed.where("is_cut").select("task", "length", "rank", (F.col("bin") + F.col("at") * F.col("length")).alias("lies"))
    lying = ends.join(F.broadcast(keys) if few <= FEW else keys, ["task", "length", "rank"])
    over = F.sequence(F.expr(f"lies div {capacity}"), F.expr(f"(lies + length - 1) div {capacity}"))
    one = lambda q: F.array(F.struct((q * capacity).alias("a"), ((q + 1) * capacity).alias("b"), (q + bins).alias("q")))
    parts = F.flatten(F.transform(over, lambda q: F.when(q < full, one(q)).otherwise(spans)))
    lying = lying.withColumn("s", F.explode(parts)).withColumns({"a": F.greatest("lies", "s.a"), "b": F.least(F.col("lies") + F.col("length"), F.col("s.b"))}).where("a < b")
    skip, size = F.col("a") - F.col("lies"), F.col("b") - F.col("a")
    piece = F.substring("ids", (4 * skip + 1).cast("int"), (4 * size).cast("int"))
    cut_ones = lying.select("doc_id", (F.col("start") + skip).alias("start"), size.alias("length"), F.crc32(piece).alias("ids_crc32"), "doc_tokens", F.col("s.q").alias("sequence_id"), (F.col("a") - F.col("s.a")).alias("offset"))
    return kept.unionByName(cut_ones)


def pack_by_patterns(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids in sequences of at most `capacity` ids, each as long as a power of two: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents longer than a sequence are cut at each `capacity`; of the others those are cut that no whole pattern takes. Rows that
    repeat doc_id and text are documents of their own; which of several ends of equal length gets which place follows the order in which
    tasks read them. Null texts are empty, an empty table gives no rows, other columns are ignored. capacity is a power of two.
    """
    return packed(written(token_ends(docs, capacity, vocabulary, id_col, text_col), "ends"), capacity)
