"""Language identification by unigram pieces, summed over all segmentations.

A word's probability in a language is the sum, over all ways to cut it into pieces of a fixed public vocabulary, of the
product of the pieces' probabilities; a forward pass gives it in one sweep. The pieces' probabilities are learned by
expectation maximisation (forward and backward passes) on word counts of labelled documents; a small share of each
language's probabilities is that of all languages together, so that one odd word doesn't decide a text. A text's score
sums its words' log probabilities; the prediction is the language of the highest sum (of equal sums the lesser name), the
score its share of all languages.

Every language value is learned, in blocks of BLOCK languages: a block's model is a table of pieces by languages. Learning
takes at most `per_language` different documents of each language (more than half as many where there are enough), drawn
by a hash of doc_id and text, and of their words of at most LEARNED_LETTERS letters the WORDS most frequent: the bound on
what reaches the driver. Prediction works on whole texts where they lie,
with no shuffle: each distinct word is scored once, and a text's sum goes over its distinct words. All words to score lie
end to end in one lattice. Where no piece of several characters goes across a place, every segmentation cuts there, so words
fall into short segments whose sums multiply, and one forward pass takes all segments of a slice together: text without
spaces, whose runs of letters are long and never the same twice, costs no more than other text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import coded_words, in_arrow, mixed, slices, words, written

VOCABULARY = "piece_bpe_32k.model"
#: Bounds of the sample to learn from: documents of each language, their most frequent words, and letters of such a word.
PER_LANGUAGE, WORDS, LEARNED_LETTERS = 600, 50_000, 32
#: Languages in a block.
BLOCK = 64
ROUNDS = 4
#: The share of all languages' common probabilities in those of each.
COMMON_SHARE = 0.05
#: The longest piece of letters in the vocabulary, its begin sign included: no piece is left out.
LONGEST_PIECE = 16
UNKNOWN = 1e-7
#: Counts that every piece has before learning, and every occurrence of a character as a piece of its own.
PRIOR = 0.01
UNDECIDED = "und"
BEGIN = "▁"
#: Bytes of words and their scores that a task remembers, and the characters of the longest word that is worth it.
REMEMBERED_BYTES = 32_000_000
LONG_WORD = 48
#: Text bytes that a task predicts at a time.
SLICE_BYTES = 1_000_000

#: Characters whose pieces are looked up at a time, and numbers of a forward step.
STRETCH = 1 << 16
AT_ONCE = 200_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(vocabulary: str) -> list[str]:
    """The vocabulary's pieces of letters only, in lower case, with or without the sign of a word's begin."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(x for x in found if len(x) <= LONGEST_PIECE and (x.removeprefix(BEGIN).isalpha() or x == BEGIN))


def _codes(texts: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(len(texts), length).astype(np.uint64)


def _hashes(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of all runs of n characters) for n from 1."""
    h = None
    for n in range(1, min(longest, codes.shape[1]) + 1):
        tail = codes[:, n - 1 :]
        h = mixed(tail) if h is None else mixed((h[:, :-1] + np.uint64(n)) * _FACTOR + tail)
        yield n, h


@dataclass
class Pieces:
    """Hashes of the vocabulary in order, and each piece's number by that order; 0 is no piece."""

    keys: np.ndarray

    @classmethod
    def make(cls, vocabulary: str) -> Pieces:
        keys = []
        by_length: dict[int, list[str]] = {}
        for x in pieces_of(vocabulary):
            by_length.setdefault(len(x), []).append(x)
        for n, texts in by_length.items():
            keys += [h[:, 0] for k, h in _hashes(_codes(texts, n), n) if k == n]
        return cls(np.unique(np.concatenate(keys)))

    def __post_init__(self) -> None:
        # A table by the top bits: where in `keys` to begin; most slots hold one key.
        self.bits = 64 - max(1, int(np.ceil(np.log2(len(self.keys) * 8))))
        self.first = np.searchsorted(self.keys, np.arange(1 << (64 - self.bits), dtype=np.uint64) << np.uint64(self.bits)).astype(np.int32)
        slot = self.keys >> np.uint64(self.bits)
        held = np.bincount(slot.astype(np.int64), minlength=len(self.first))
        self.taken, self.depth = held > 0, int(held.max())
        self.padded = np.concatenate([self.keys, np.zeros(self.depth + 1, np.uint64)])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        slot, found = (h >> np.uint64(self.bits)).astype(np.int64), np.zeros(h.shape, np.int32)
        maybe = np.nonzero(self.taken[slot])
        own, at, number = h[maybe], self.first[slot[maybe]], np.zeros(len(maybe[0]), np.int32)
        for k in range(self.depth):
            np.copyto(number, at + k + 1, where=self.padded[at + k] == own)
        found[maybe] = number
        return found

    def lattice(self, texts: list[str], length: int) -> list[np.ndarray]:
        return [self.numbers(h) for _, h in _hashes(_codes(texts, length), LONGEST_PIECE)]


def _forward(lattice: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """alpha[i]: the probability, by word and language, of all ways to cut the first i characters. For words of moderate length."""
    count, length = lattice[0].shape
    alpha = np.zeros((length + 1, count, p.shape[1]))
    alpha[0] = 1
    for end in range(1, length + 1):
        for n in range(1, min(len(lattice), end) + 1):
            _add(alpha[end], alpha[end - n], lattice[n - 1][:, end - n], n, p)
    return alpha


def _add(to: np.ndarray, before: np.ndarray, ids: np.ndarray, n: int, p: np.ndarray) -> None:
    """Adds to the probabilities `to` those of the ways that end with the piece `ids` of n characters."""
    if n == 1:
        step = p[ids]
        step[ids == 0] = UNKNOWN
        to += before * step
    elif len(hit := np.flatnonzero(ids)):
        to[hit] += before[hit] * p[ids[hit]]


def _segments(pieces: Pieces, codes: np.ndarray, at: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Where the characters from `at` on are cut in every segmentation, as far as one stretch or more tells, and the lattice there.

    No piece of several characters goes across such a place, so the sum over all segmentations is the product of the sums
    of what lies between. Words lie end to end in `codes`; their begin signs keep pieces from going across two.
    """
    stretch = STRETCH
    while True:
        own = codes[at : at + stretch + LONGEST_PIECE - 1]
        lattice = [pieces.numbers(h[0]) for _, h in _hashes(own[None, :], LONGEST_PIECE)]
        n = min(stretch, len(own))
        crossed = np.zeros(len(own) + LONGEST_PIECE, np.int32)
        for k, ids in enumerate(lattice[1:], 2):
            hit = np.flatnonzero(ids)
            crossed[hit + 1] += 1
            crossed[hit + k] -= 1
        cuts = np.flatnonzero(np.cumsum(crossed[: n + 1]) == 0)
        if at + n == len(codes) or len(cuts) > 1:
            return lattice, cuts
        stretch *= 2


def _of_segments(lattice: list[np.ndarray], begin: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The logarithm of the probability of each segment by language. The longest go first; a step takes all that haven't ended."""
    out = np.zeros((len(begin), p.shape[1]))
    single = lattice[0][begin]
    out[:] = np.log(np.where((single == 0)[:, None], UNKNOWN, p[single]))
    several = np.flatnonzero(size > 1)
    for part in np.array_split(several[np.argsort(-size[several], kind="stable")], -(-len(several) * p.shape[1] // AT_ONCE) or 1):
        first, length, log = begin[part], size[part], np.zeros((len(part), p.shape[1]))
        last, k = [np.ones_like(log)], len(part)  # for the latest ends, newest first
        for end in range(1, int(length[0]) + 1 if k else 0):
            new = np.zeros((k, p.shape[1]))
            for n in range(1, min(LONGEST_PIECE, end) + 1):
                _add(new, last[n - 1][:k], lattice[n - 1][first[:k] + end - n], n, p)
            last = [new, *last[: LONGEST_PIECE - 1]]
            if end % 8 == 0:  # no step is below UNKNOWN times the one before
                log[:k] += np.log(new)
                last = [x[:k] / new for x in last]
            done = int(np.searchsorted(-length[:k], -end))
            out[part[done:k]] = log[done:k] + np.log(last[0][done:])
            k = done
    return out


def log_probabilities(words: list[str], models: list[Model]) -> np.ndarray:
    """By word and language of all models in order; words are as `clean` gives them, of any length."""
    out = np.zeros((len(words), sum(len(m.languages) for m in models)))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends, at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), 0
    while at < len(codes) and models:
        lattice, cuts = _segments(models[0].pieces, codes, at)
        begin, size = cuts[:-1], np.diff(cuts)
        word = np.searchsorted(ends, at + begin, "right")
        first = np.flatnonzero(np.diff(word, prepend=-1))
        column = 0
        for m in models:
            out[word[first], column : column + len(m.languages)] += np.add.reduceat(_of_segments(lattice, begin, size, m.p), first)
            column += len(m.languages)
        at += int(cuts[-1])
    return out


def _expected(lattice: list[np.ndarray], p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of words that occur `weight` times by language."""
    alpha = _forward(lattice, p)
    length, count, languages = alpha.shape[0] - 1, alpha.shape[1], alpha.shape[2]
    beta, total = np.zeros_like(alpha), np.zeros_like(p)
    beta[length] = weight / alpha[length]
    for begin in range(length - 1, -1, -1):
        for n in range(1, min(len(lattice), length - begin) + 1):
            ids = lattice[n - 1][:, begin]
            step = p[ids]
            if n == 1:
                step[ids == 0] = UNKNOWN
            else:
                step[ids == 0] = 0
            back = beta[begin + n] * step
            beta[begin] += back
            use = alpha[begin] * back
            for k in range(languages):
                total[:, k] += np.bincount(ids, use[:, k], len(p))
    return total


def _by_length(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


@dataclass
class Model:
    """Of one block of languages, and of what they have in common."""

    languages: list[str]
    pieces: Pieces
    p: np.ndarray


@dataclass
class Learned:
    """Blocks of models, and one of letters drawn one by one as all languages together have them."""

    models: list[Model]
    noise: Model | None = None

    @property
    def languages(self) -> list[str]:
        return [x for m in self.models for x in m.languages]


def learn(counts: dict[str, dict[str, float]], pieces: Pieces, rounds: int = ROUNDS, common: np.ndarray | None = None) -> Model:
    """From counts by language of words as `clean` gives them, mixed with the `common` probabilities."""
    languages = sorted(counts)
    texts = sorted({w for x in counts.values() for w in x})
    weight = np.array([[counts[x].get(w, 0) for x in languages] for w in texts], float).reshape(len(texts), len(languages))
    p = np.full((len(pieces.keys) + 1, len(languages)), 1 / len(pieces.keys))
    groups = [(pieces.lattice([texts[i] for i in at], n), weight[at]) for n, at in _by_length(texts)]
    prior = np.full_like(p, PRIOR)
    for lattice, w in groups:  # a character that longer pieces explain still belongs to its language
        for k in range(len(languages)):
            prior[:, k] += PRIOR * np.bincount(lattice[0].ravel(), np.repeat(w[:, k], lattice[0].shape[1]), len(prior))
    for _ in range(rounds if texts else 0):
        p[0] = 0
        total = sum(_expected(x, p, w) for x, w in groups) + prior
        total[0] = 0
        p = total / total.sum(0)
        if common is not None:
            p = (1 - COMMON_SHARE) * p + COMMON_SHARE * common[:, None]
    p[0] = 0
    return Model(languages, pieces, p)


def single_letters(counts: dict[str, float], pieces: Pieces, models: list[Model]) -> Model:
    """The words' characters, one by one. Pieces that are found in no word, and the sign of a word's begin, are as likely as where they are likeliest."""
    total, seen = np.zeros(len(pieces.keys) + 1), np.zeros(len(pieces.keys) + 1, bool)
    texts = [*counts]
    for n, at in _by_length(texts):
        lattice = pieces.lattice([texts[i] for i in at], n)
        total += np.bincount(lattice[0].ravel(), np.repeat([counts[texts[i]] for i in at], n), len(total))
        for ids in lattice:
            seen[ids] = True
    p = total / max(total[1:].sum(), 1e-9)
    seen[pieces.lattice([BEGIN], 1)[0]] = False
    p[~seen] = np.max([m.p[~seen].max(1) for m in models], axis=0) if models else PRIOR
    p[0] = 0
    return Model([""], pieces, p[:, None])


def clean(tokens: list[str] | pa.Array) -> tuple[list[str], np.ndarray]:
    """Runs of letters in the tokens, in lower case and behind the sign of a word's begin, with the token that each is from."""
    letters = pc.replace_substring_regex(pc.utf8_lower(tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.string())), r"[^\pL]+", " ")
    parts = pc.split_pattern(pc.utf8_trim(letters, " "), " ")
    runs, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    real = pc.not_equal(runs, "").to_numpy(zero_copy_only=False)
    runs = pc.binary_join_element_wise(BEGIN, runs, "")
    return [x for x, r in zip(runs.to_pylist(), real) if r], owner[real].astype(np.int64)


def training_rows(id_col: Column) -> Column:
    """Rows to learn from; the others are held out."""
    return F.crc32(id_col.cast("string")) % 4 != 2


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> Learned:
    """All languages in lang_col, from documents that are not held out. Null languages and texts teach nothing."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & training_rows(F.col("doc_id")))
    # The sample of a language is that of the most leading zeros in a hash that has no more than per_language documents.
    rows = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)).withColumn("bits", F.length(F.bin("hash")))
    upto = Window.partitionBy("lang").orderBy("bits")  # at most 63 rows a language
    limits = rows.select("lang", "hash", "bits").distinct().groupBy("lang", "bits").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    limits = written(limits.groupBy("lang").agg(F.max(F.when(F.col("upto") <= per_language, F.col("bits"))).alias("limit")), "limits")
    # Rows that repeat doc_id and text are one; few enough come past the limits to be dealt anew.
    drawn = rows.join(F.broadcast(limits), "lang").where("bits <= limit").groupBy("lang", "hash").agg(F.first("text").alias("text"))  # limits: a row a language, as the models have

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                for lang in dict.fromkeys(langs):
                    codes, tokens, _ = words(part.filter(pa.array([x == lang for x in langs])).column("text"))
                    runs, owner = clean(tokens)
                    n = np.bincount(codes, minlength=len(tokens))[owner]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(runs, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    counted = drawn.select("lang", "text").mapInArrow(count, "lang string, word string, n long").where(F.length("word") <= LEARNED_LETTERS).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counted = written(counted.withColumn("rank", rank).where(F.col("rank") <= WORDS).drop("rank"), "counted")
    languages = sorted(r["lang"] for r in limits.select("lang").collect())
    pieces, own_words = Pieces.make(vocabulary or public_tokenizers.path(VOCABULARY)), Window.partitionBy("lang")
    each = counted.withColumn("share", F.col("n") / F.sum("n").over(own_words)).groupBy("word").agg(F.sum("share").alias("share"))
    top = {r["word"]: r["share"] for r in each.orderBy(F.desc("share"), "word").limit(WORDS).collect()}
    scale = counted.agg(F.sum("n")).first()[0] or 0
    pooled = {w: x * scale / max(1, len(languages)) for w, x in top.items()}
    common = learn({"": pooled}, pieces).p[:, 0]
    models = []
    for at in range(0, len(languages), block):
        names = languages[at : at + block]
        counts: dict[str, dict[str, float]] = {x: {} for x in names}
        for lang, own in counted.where(F.col("lang").isin(names)).toPandas().groupby("lang"):
            counts[lang] = dict(zip(own["word"], own["n"]))
        models.append(learn(counts, pieces, common=common))
    return Learned(models, single_letters(pooled, pieces, models))


class _Scores:
    """Log probabilities of tokens by language, remembered from slice to slice; tokens without a letter have none.

    Tokens are remembered as one Arrow array, a few bytes each, and looked up by a hash table that lives for a call.
    """

    def __init__(self, models: list[Model]) -> None:
        self.models, self.width = models, sum(len(m.languages) for m in models)
        self.forget()

    def forget(self) -> None:
        self.tokens = pa.array([], pa.string())
        self.table, self.lettered = np.zeros((0, self.width)), np.zeros(0, bool)

    @property
    def known(self) -> list[str]:
        """What is remembered, in the order of the first rows of `table`."""
        return self.tokens.to_pylist()

    @property
    def size(self) -> int:
        """Bytes that the remembered tokens take, with about 40 each for looking them up."""
        return self.tokens.nbytes + (40 + 8 * self.width) * len(self.tokens)

    def of(self, tokens: list[str] | pa.Array) -> np.ndarray:
        """Rows of `table` for different tokens, until the next call. Long tokens are not remembered beyond it."""
        if self.size > REMEMBERED_BYTES:
            self.forget()
        tokens, count = tokens.cast(pa.string()) if isinstance(tokens, pa.Array) else pa.array(tokens, pa.string()), len(self.tokens)
        rows = pc.fill_null(pc.index_in(tokens, value_set=self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        table, lettered = self.table[:count], self.lettered[:count]
        if len(new := np.flatnonzero(rows < 0)):
            long = pc.greater(pc.utf8_length(tokens.take(pa.array(new))), LONG_WORD).to_numpy(zero_copy_only=False)
            new = np.concatenate([new[~long], new[long]])
            rows[new] = np.arange(count, count + len(new))
            added = tokens.take(pa.array(new))
            runs, owner = clean(added)
            own, has = np.zeros((len(new), self.width)), np.zeros(len(new), bool)
            np.add.at(own, owner, log_probabilities(runs, self.models))
            has[owner] = True
            table, lettered = np.concatenate([table, own]), np.concatenate([lettered, has])
            self.tokens = pa.concat_arrays([self.tokens, added.slice(0, len(new) - int(long.sum()))])
        self.table, self.lettered = table, lettered
        return rows


def predict(docs: DataFrame, learned: Learned, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score", fit_as: str | None = None) -> DataFrame:
    """docs with the predicted language and the score; `und` and 0 where the text is null or has no letter, or where no language is known.

    With fit_as, also the logarithm of how much likelier the text is in the predicted language than as letters drawn one
    by one: a text at or below 0 is no more like any language than such noise. Null where nothing is predicted. Columns of
    docs that have one of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # languages by the vocabulary's pieces
    new = [StructField(lang_as, StringType()), StructField(score_as, DoubleType()), *([StructField(fit_as, DoubleType())] if fit_as else [])]
    names = {f.name.lower() for f in new}
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    schema = StructType([*docs.schema.fields, *new])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages, scores = model.languages, _Scores([*model.models, *([model.noise] if fit_as and model.models else [])])
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                codes, tokens, starts = coded_words(part.column(text_col))
                at = scores.of(tokens)
                count, n = part.num_rows, max(1, len(tokens))
                keys, times = np.unique(np.repeat(np.arange(count), np.diff(starts)) * np.int64(n) + codes, return_counts=True)
                text, row = keys // n, at[keys % n] if len(tokens) else np.zeros(0, np.int64)
                sums = np.stack([np.bincount(text, times * scores.table[row, k], count) for k in range(scores.width)], axis=1) if scores.width else np.zeros((count, 0))
                has = np.bincount(text, scores.lettered[row], count) > 0
                best, odds, fit = np.zeros(count, int), np.zeros(count), np.zeros(count)
                if languages:
                    own = sums[:, : len(languages)]
                    best = own.argmax(1)
                    odds = 1 / np.exp(np.clip(own - own.max(1, keepdims=True), -700, 0)).sum(1)
                known = has & bool(languages)
                out = [pa.array([languages[b] if h else UNDECIDED for b, h in zip(best, known)], pa.string()), pa.array(np.where(known, odds, 0.0))]
                if fit_as:
                    if languages:
                        fit = own.max(1) - sums[:, -1]
                    out.append(pa.array(fit, pa.float64(), mask=~known))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *(f.name for f in new)])

    return in_arrow(docs, score, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; lang is used only to learn, and only where held_out is false.

    Repeated rows each get a row; an empty table gives none; other columns are ignored. Texts of any length are read whole,
    words of any length summed over all their segmentations. Of languages that a text is equally likely in, the least name is given.
    """
    learned = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = predict(rows, learned)
    return found.select("doc_id", (~F.coalesce(training_rows(F.col("doc_id")), F.lit(True))).alias("held_out"), "lang_pred", "score")
