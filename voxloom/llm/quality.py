"""Quality by divergence from what is usual in a language.

A reference of each language is made from all its documents: the median share of each of eight classes of characters, which
odd documents don't move, and the mean share of its most common words (those found in the most documents). A document is compared with every reference by the
Jensen-Shannon distance of both histograms. It is kept if some reference is near enough in both; a histogram of too few
characters or words isn't compared, and the limits are wider for short documents, whose shares scatter.

Two passes over the texts, no shuffle of texts: the first counts words where they lie, joined before the shuffle; what
reaches the driver is COMMON words of each language, in blocks of about LANGUAGES languages; each document is compared with
the blocks one after another.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, words, written

#: Words of a language's histogram, and languages that are gathered and compared at a time.
COMMON = 60
LANGUAGES = 32
SHARE = 1_000_000
#: Steps in which shares of characters are told apart for their medians.
STEPS = 2_000
#: The base rule.
MIN_WORDS = 50
MAX_REPEATED = 50
#: Limits of the Jensen-Shannon distance (base 2), and the least characters and words to compare. Of the labelled documents
#: that pass the base rule, the limits leave 99.7 in 100 good ones and take 24 of 27 poor ones (0.01 of the given tables).
MAX_CHARACTER_DISTANCE = 0.185
MAX_WORD_DISTANCE = 0.40
MIN_CHARACTERS = 200
MIN_COMPARED_WORDS = 50
#: Characters and words for which the limits double: the shares of short texts scatter.
CHARACTER_SCATTER = 100
SCATTER = 60
#: Words that a task holds before it hands them on.
HELD = 400_000

SPACE, LOWER, UPPER, DIGIT, SYMBOL, MARK, LETTER, OTHER = range(8)
CLASSES = 8
#: Fixed value: the symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"

_table: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point."""
    global _table
    if _table is None:
        by_category = {"Ll": LOWER, "Lu": UPPER, "Nd": DIGIT, "Lo": LETTER, "Lm": LETTER, "Lt": LETTER}
        table = np.array([by_category.get(c := unicodedata.category(chr(i)), MARK if c[0] in "PS" else OTHER) for i in range(0x110000)], np.uint8)
        table[[0x20, *range(9, 14)]] = SPACE
        table[[ord(x) for x in SYMBOLS]] = SYMBOL
        _table = table
    return _table


def _runs(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between ends."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


@dataclass
class Measured:
    """What one slice of texts holds."""

    histogram: np.ndarray  # by text and class
    codes: np.ndarray
    tokens: list[str]
    starts: np.ndarray
    document: np.ndarray  # of each word

    @classmethod
    def of(cls, texts: pa.Array) -> Measured:
        texts = pc.fill_null(texts, "")
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))])
        kinds = classes()[points]
        histogram = np.stack([_runs(ends, kinds == k) for k in range(CLASSES)], axis=1)
        codes, tokens, starts = words(texts)
        return cls(histogram, codes, tokens, starts, np.repeat(np.arange(len(texts)), np.diff(starts)))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.starts)

    def repeated(self) -> np.ndarray:
        """Words in 3-word windows that the text has twice or more."""
        if len(self.codes) < 3:
            return np.zeros(len(self.starts) - 1, np.int64)
        _, ids = np.unique(self.document * np.int64(len(self.tokens)) + self.codes, return_inverse=True)
        n = np.int64(ids.max() + 1)
        if n < 1 << 21:
            triple = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        else:
            _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
            triple = pair[:-1] * n + ids[2:]
        inside = self.document[:-2] == self.document[2:]
        _, which, found = np.unique(triple, return_inverse=True, return_counts=True)
        twice = (found[which] >= 2) & inside
        hit = np.zeros(len(self.codes), bool)
        for k in range(3):
            hit[k : len(hit) - 2 + k] |= twice
        return _runs(self.starts, hit)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = parts.flatten().dictionary_encode()
    text = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    bare = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(lines.dictionary)), 0).to_numpy(zero_copy_only=False)
    n = max(1, len(lines.dictionary))
    keys, found = np.unique(text.astype(np.int64) * n + lines.indices.to_numpy(zero_copy_only=False), return_counts=True)
    more = np.where(bare[keys % n] if len(bare) else False, 0, found - 1)
    return np.bincount(keys // n, more, len(texts)).astype(np.int64)


def plain(tokens: list[str]) -> list[str]:
    """Words in lower case without what stands before and behind their letters and digits."""
    return pc.replace_substring_regex(pc.utf8_lower(pa.array(tokens, pa.string())), r"^[^\pL\pN]+|[^\pL\pN]+$", "").to_pylist()


@dataclass
class References:
    languages: list[str]
    characters: np.ndarray  # by language and class
    common: list[dict[str, float]]


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", at_once: int = LANGUAGES) -> list[References]:
    """From all documents with a language; each counts the same. Ties among common words go to the lesser word. Blocks of about `at_once` languages."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                keys, values = zip(*held.keys()), zip(*held.values())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in keys), *(pa.array(x, pa.int64()) for x in values)], names=["lang", "word", "docs", "mass"])
                held.clear()

        def add(lang: str, word: str, docs: int, mass: int) -> None:
            if (own := held.get((lang, word))) is None:
                held[lang, word] = [docs, mass]
            else:
                own[0] += docs
                own[1] += mass

        for batch in batches:
            for part in slices(batch, "text"):
                own = Measured.of(part.column("text"))
                coded = part.column("lang").dictionary_encode()
                lang, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
                size = own.histogram.sum(1)
                shares = own.histogram * STEPS // np.maximum(size, 1)[:, None]
                for i, name in enumerate(names):
                    for k in range(CLASSES):  # the key of a class and a share is no word: it begins with a space
                        values, found = np.unique(shares[(lang == i) & (size > 0), k], return_counts=True)
                        for value, docs in zip(values.tolist(), found.tolist()):
                            add(name, f" {k} {value}", docs, 0)
                unique = pa.array(plain(own.tokens), pa.string()).dictionary_encode()
                codes, texts = unique.indices.to_numpy(zero_copy_only=False).astype(np.int64)[own.codes], unique.dictionary.to_pylist()
                n = max(1, len(texts))
                keys, found = np.unique(own.document * np.int64(n) + codes, return_counts=True)
                mass = found * SHARE // own.n_words[keys // n]
                by = lang[keys // n] * n + keys % n
                keys, which, found = np.unique(by, return_inverse=True, return_counts=True)
                mass = np.bincount(which, mass, len(keys)).astype(np.int64)
                for key, docs, m in zip(keys.tolist(), found.tolist(), mass.tolist()):
                    if texts[key % n]:
                        add(names[key // n], texts[key % n], docs, m)
                if len(held) > HELD:
                    yield from out()
        yield from out()

    found = written(rows.mapInArrow(count, "lang string, word string, docs long, mass long").groupBy("lang", "word").agg(F.sum("docs").alias("docs"), F.sum("mass").alias("mass")), "words")
    is_class = F.col("word").startswith(" ")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    blocks = -(-sizes.count() // at_once)
    block = F.pmod(F.xxhash64("lang"), F.lit(max(1, blocks)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("docs"), "word"))
    common_rows = found.where(~is_class).join(F.broadcast(sizes), "lang").withColumn("rank", rank).where(F.col("rank") <= COMMON)
    key = F.split("word", " ")
    class_rows = found.where(is_class).join(F.broadcast(sizes), "lang").groupBy("lang", key[1].cast("int").alias("k"))
    class_rows = class_rows.agg(F.expr("percentile(cast(split(word, ' ')[2] as int), 0.5, docs)").alias("share"))
    if blocks > 1:
        class_rows, common_rows = written(class_rows, "classes"), written(common_rows, "common")
    out = []
    for k in range(blocks):
        medians: dict[str, np.ndarray] = {}
        for r in class_rows.where(block == k).collect():
            medians.setdefault(r["lang"], np.zeros(CLASSES))[r["k"]] = r["share"]
        masses: dict[str, dict[str, float]] = {}
        for r in common_rows.where(block == k).collect():
            masses.setdefault(r["lang"], {})[r["word"]] = r["mass"] / (SHARE * r["n"])
        languages = sorted(x for x in masses if medians.get(x, np.zeros(1)).sum())
        characters, common = [medians[x] / medians[x].sum() for x in languages], [dict(sorted(masses[x].items())) for x in languages]
        if languages:
            out.append(References(languages, np.array(characters).reshape(-1, CLASSES), common))
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        of_p = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        of_q = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0, (of_p + of_q) / 2))


def judge(docs: DataFrame, refs: list[References], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's measures, its nearest reference and the verdict.

    Null and empty texts have no words and fail the base rule; texts of any length are measured whole. Of references that
    are equally near the least name is given. Where no language has a reference the base rule alone decides.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(r) for r in refs]  # COMMON + CLASSES numbers a language
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x.value for x in shared]
        numbered = [{w: i for i, w in enumerate(sorted({w for x in r.common for w in x}))} for r in blocks]
        for batch in batches:
            for part in slices(batch, "text"):
                own = Measured.of(part.column("text"))
                n, h, count = own.n_words, own.histogram, part.num_rows
                repeats = own.repeated()
                failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n)
                size, tokens = h.sum(1), plain(own.tokens)
                p = h / np.maximum(size, 1)[:, None]
                character_limit = MAX_CHARACTER_DISTANCE * (1 + CHARACTER_SCATTER / np.maximum(size, 1))
                word_limit = MAX_WORD_DISTANCE * (1 + SCATTER / np.maximum(n, 1))
                near, cd, wd, least = np.full(count, None, object), np.zeros(count), np.zeros(count), np.full(count, np.inf)
                for r, columns in zip(blocks, numbered):
                    at = np.array([columns.get(w, len(columns)) for w in tokens], np.int64)
                    width = len(columns) + 1
                    found = np.bincount(own.document * width + at[own.codes], minlength=count * width).reshape(count, width) if len(own.codes) else np.zeros((count, width))
                    share = found / np.maximum(n, 1)[:, None]
                    char_d, word_d = np.zeros((len(r.languages), count)), np.zeros((len(r.languages), count))
                    for k, common in enumerate(r.common):
                        q = np.array([*common.values()])
                        pick = share[:, [columns[w] for w in common]]
                        char_d[k] = np.where(size >= MIN_CHARACTERS, distance(p, r.characters[k]), 0)
                        rest = lambda x: np.concatenate([x, np.maximum(0, 1 - x.sum(-1, keepdims=True))], -1)
                        word_d[k] = np.where(n >= MIN_COMPARED_WORDS, distance(rest(pick), rest(q)), 0)
                    over = np.maximum(char_d / character_limit, word_d / word_limit)
                    best = over.argmin(0)
                    spot = (best, np.arange(count))
                    lang, own_least = np.array(r.languages, object)[best], over[spot]
                    nearer = own_least < least
                    for i in np.flatnonzero(own_least == least):  # ties go to the lesser name, whichever block comes first
                        nearer[i] = near[i] is None or lang[i] < near[i]
                    near[nearer], cd[nearer], wd[nearer], least[nearer] = lang[nearer], char_d[spot][nearer], word_d[spot][nearer], own_least[nearer]
                good = least <= 1 if blocks else np.ones(count, bool)
                values = [n, size - h[:, SPACE], h[:, SYMBOL], repeated_lines(part.column("text")), repeats]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in values), pa.array(failed), pa.array(~failed & good), pa.array(near.tolist(), pa.string()), pa.array(cd), pa.array(wd)],
                    names=["doc_id", *longs, "base_failed", "kept", "near_lang", "character_distance", "word_distance"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, " + ", ".join(f"{x} long" for x in longs) + ", base_failed boolean, kept boolean, near_lang string, character_distance double, word_distance double")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """judge() by the references of docs themselves. One row per input row, repeated ones too; other columns are ignored; an empty table gives none."""
    return judge(docs, references(docs, text_col, lang_col), id_col, text_col)
