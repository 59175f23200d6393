"""Best-fit-decreasing packing of tokenised documents.

Best fit decreasing looks at lengths only, and a length is one of 1 to `capacity`. So the texts are tokenised where they
lie, pieces are counted by length, and the packing is worked out on that histogram: a segment tree over remaining
capacities finds the tightest open bins in logarithmic time, and a whole run of bins is filled at a step. Its plan has
at most a few times `capacity` rows for any number of documents; each piece looks up its own bin by its length and its rank
among the pieces of that length. The result is that of the sequential algorithm over all pieces, not one per partition.
Ranks come from windows over (length, bucket) and running totals of the buckets' counts: no task sees a whole length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, in_arrow, slices, written

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END = 0
#: Bytes of text pieces and their ids that a task remembers, and the characters of the longest piece that is worth it.
REMEMBERED_BYTES = 25_000_000
LONG_PIECE = 48
#: Pieces that go to the tokenizer at a time; its own record of them is many times their size.
LEARNED = 1 << 14

SPACE, LETTER, DIGIT, MARK, ODD, WHOLE = range(6)
#: Letters and digits between U+0080 and U+017F; the normaliser lowers their case character by character.
_LATIN = range(0x80, 0x180)
#: There, characters that it treats in another way; like all characters beyond, they are odd.
_OTHER = {*range(0x80, 0xA1), 0x130, 0x149}


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte that is a character, the kind of each Latin character, and its lower case in UTF-8."""
    one = np.full(256, ODD, np.uint8)
    one[0x21:0x7F] = MARK
    for kind, characters in ((SPACE, b"\t\n\x0b\x0c\r "), (DIGIT, b"0123456789")):
        one[list(characters)] = kind
    one[[c for c in range(128) if chr(c).isalpha()]] = LETTER
    kind_of = lambda c: ODD if c in _OTHER else LETTER if chr(c).isalpha() else DIGIT if chr(c).isnumeric() else MARK
    lower = [list((chr(c) if c in _OTHER else chr(c).lower()).encode()) for c in _LATIN]
    return one, np.array([kind_of(c) for c in _LATIN], np.uint8), np.array(lower, np.uint8)


_ONE, _TWO, _LOWER = _kinds()
#: For str.translate: takes out all characters of plain pieces.
_PLAIN = {c: None for c in (*range(0x21, 0x7F), *_LATIN) if c not in _OTHER}


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' pieces, as the tokenizer's pattern cuts them in lower case, and where each text's begin and end.

    White space makes pieces too. A word with an odd character is one piece and keeps its case. The pattern's rule for
    letters, single digits, runs of marks, and 's 't 'm 'd 're 've 'll is applied to all bytes at once.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets, n = offsets - offsets[0], len(data)
    kind = _ONE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    latin = (data[lead].astype(np.int64) - 0xC2) * 64 + data[lead + 1] - 0x80
    kind[lead] = kind[lead + 1] = _TWO[latin]
    first = np.zeros(n + 1, bool)  # of a text
    first[offsets] = True
    if (odd := np.flatnonzero(kind == ODD)).size:
        space = np.concatenate([[True], kind == SPACE])
        word = np.cumsum(~space[1:] & (space[:-1] | first[:-1]))
        whole = np.zeros(int(word[-1]) + 1, bool)
        whole[word[odd]] = True
        kind[whole[word] & (kind != SPACE)] = WHOLE
    start = first.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    start[:-1] |= kind == DIGIT
    start[lead + 1] = False
    upper = (data >= 65) & (data <= 90) & (kind == LETTER)
    data[upper] |= 32
    plain = kind[lead] != WHOLE
    data[lead[plain]], data[lead[plain] + 1] = _LOWER[latin[plain]].T
    quote = np.flatnonzero((data == 39) & (kind == MARK) & start[:-1])
    after = lambda k: np.where((quote + k < n) & ~first[np.minimum(quote + k, n)], data[np.minimum(quote + k, n - 1)] * (kind[np.minimum(quote + k, n - 1)] == LETTER), 0)
    if len(quote):
        x, y = after(1), after(2)
        short = np.isin(x, list(b"stmd"))
        long = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    at = np.flatnonzero(start)
    runs = at[:-1] if len(at) and at[-1] == n else at
    pieces = pa.StringArray.from_buffers(len(runs), pa.py_buffer(np.append(runs, n).astype(np.int32)), pa.py_buffer(data))
    return pieces, np.searchsorted(runs, offsets)


class Lists:
    """Numbered lists of ids, held end to end; grows in place."""

    def __init__(self) -> None:
        self.flat, self.first, self.length, self.used, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        grown = lambda old, n: old if n <= len(old) else np.concatenate([old, np.zeros(max(n, 2 * len(old)) - len(old), old.dtype)])
        used, count = self.used + len(values), self.count + len(lengths)
        self.flat, self.first, self.length = grown(self.flat, used), grown(self.first, count), grown(self.length, count)
        self.flat[self.used : used], self.length[self.count : count] = values, lengths
        self.first[self.count : count] = self.used + np.cumsum(lengths) - lengths
        self.used, self.count = used, count

    def trim(self, used: int, count: int) -> None:
        """Keeps the first `count` lists, `used` ids in all; what they don't need is given back if it is most of the room."""
        self.used, self.count = used, count
        if len(self.flat) > 4 * used + (1 << 22):
            self.flat = self.flat[: used + (1 << 16)].copy()

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists `at`, end to end, and where each ends."""
        length = self.length[at]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.first[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)], ends


class Ids:
    """The tokenizer's ids of whole texts, put together from those of their pieces.

    A short piece is tokenised when it is first met; what is remembered is bounded in bytes, and long pieces (text without
    spaces, encoded data) are not remembered. No token of this vocabulary spans white space, so a word with odd characters
    goes to the tokenizer alone; a text with the content of an added token (`<|endoftext|>`, in any case) goes there whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)  # for text that is in lower case and cut already
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary, suffix = self.model.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # which ids are the last of a piece
        self.last[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.lists, self.size = {}, Lists(), 0

    def learn(self, new: list[str]) -> None:
        plain, others = [], []
        for x in new:
            (plain if x.isascii() and x.isalpha() or x[0] > " " and x.translate(_PLAIN) == "" else others).append(x)
        ids = [[] if not x.strip(" \t\n\x0b\x0c\r") else self.tokenizer.encode(x, add_special_tokens=False).ids for x in others]
        self.known.update(zip(plain + others, range(self.lists.count, self.lists.count + len(new))))
        for at in range(0, len(plain), LEARNED):
            self.lists.add(*self.whole(plain[at : at + LEARNED]))
        self.lists.add(np.asarray([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def whole(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces, end to end, and how many each has."""
        if not self.last.any():
            got = self.model.encode(plain, is_pretokenized=True, add_special_tokens=False)
            return np.asarray(got.ids, np.uint32), np.bincount(np.asarray(got.word_ids, np.int64), minlength=len(plain))
        got = self.model.encode_batch_fast([plain], is_pretokenized=True, add_special_tokens=False)  # it leaves word_ids out
        ids = np.asarray(got[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for content in self.added:
            special |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        pieces, starts = cut(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.size > REMEMBERED_BYTES:
            self.forget()
        new = [x for x in distinct if x not in self.known]
        if short := [x for x in new if len(x) <= LONG_PIECE]:
            self.learn(short)
            self.size += sum(map(len, short)) * 8 + 180 * len(short)  # up to four bytes a character, and an id
        mark = self.lists.used, self.lists.count
        if long := [x for x in new if len(x) > LONG_PIECE]:
            self.learn(long)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
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


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of each document's ids and END: doc_id, piece, start, length, ids_crc32.

    A null text is empty; an empty text has END alone. A text of any length is read whole, and gives one row for each
    `capacity` ids. ids_crc32 is that of the ids as little-endian 32-bit numbers.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def tokenised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = _loaded.get(path) or _loaded.setdefault(path, Ids(path))
        end = np.asarray([END], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):
                found, bounds = ids.of(part.column("text"))
                data, row, k, start, length, crc = found.astype("<u4", copy=False).tobytes(), [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own, n = data[4 * a : 4 * b] + end, b - a + 1
                    for j, at in enumerate(range(0, n, capacity)):
                        row.append(i)
                        k.append(j)
                        start.append(at)
                        length.append(min(capacity, n - at))
                        crc.append(zlib.crc32(own[4 * at : 4 * (at + capacity)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int32())), *(pa.array(x, t) for x, t in zip((k, start, length, crc), kinds))], names=names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(rows, tokenised, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Remaining:
    """Segment tree over remaining capacities 0 to n: which have open bins, and the least of them that is no less than a size."""

    def __init__(self, n: int) -> None:
        self.width = 1 << n.bit_length()
        self.open = [0] * (2 * self.width)

    def change(self, capacity: int, by: int) -> None:
        at = self.width + capacity
        while at:
            self.open[at] += by
            at //= 2

    def tightest(self, size: int) -> int | None:
        at = self.width + size
        if self.open[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first bin, offset, pieces a bin) for counts of pieces by length.

    The sequential algorithm puts equal pieces into the tightest bin until it has no room for one more, then goes on to the
    next bin that was as tight. So a step fills a run of bins of the same remaining capacity at once. Each step uses up a
    length or a run of bins and makes at most two runs: the plan has a few rows a length, for any number of pieces.
    """
    tree, runs, plan, bins = Remaining(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        runs.setdefault(room, []).append((first, n))
        tree.change(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                tree.change(room, -n)
            each = room // length
            take, into = (left, 1) if left < each else (each * min(n, left // each), min(n, left // each))
            plan.append((length, rank, rank + take, first, capacity - room, each))
            put(room - (take // into) * length, first, into)
            if into < n:
                put(room, first + into, n - into)
            rank, left = rank + take, left - take
    return plan


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces' rows with sequence_id and offset. Empty input gives no rows; repeated rows are pieces of their own."""
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    # At most `capacity` rows come to the driver.
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_decreasing(lengths, capacity), "length long, first long, last long, bin long, base long, each long")

    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank"))
    spot = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["first"]) & (ranked["rank"] < plan["last"])
    placed = ranked.join(F.broadcast(plan), spot).withColumn("at", F.col("rank") - F.col("first"))
    sequence, offset = F.expr("bin + at div each"), F.expr("base") + F.col("at") % F.col("each") * ranked["length"]
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids in sequences of at most `capacity` ids, as few as best fit decreasing needs; only documents longer than a sequence are cut.

    Rows that repeat doc_id and text are documents of their own; which of several pieces of equal length gets which place
    follows their buckets, doc_id and piece. Null texts are empty, an empty table gives no rows, other columns are ignored.
    """
    return packed(token_pieces(docs, capacity, vocabulary, id_col, text_col), capacity)
