"""From documents to packed sequences of training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents; the last returns pieces of documents and their places in sequences. run() writes each stage's rows as Parquet in
the shared folder and reads them again for the next one, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import exact_dedup, langid, mixing, neardup, packing
from voxloom.llm.common import documents, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language and gives the others the predicted one as their lang.

    Rejected: null texts, those without a letter, and those that are no likelier in any learned language than as letters
    drawn one by one. Where no row has a lang to learn from, only the first two go, and lang stays null. A repeated row is
    judged like its twin; an empty table gives none.
    """
    learned = langid.train(docs)
    longest = max(docs.columns, key=len)  # names that no column of docs has
    language, score, fit = (f"{longest}_{x}" for x in ("language", "score", "fit"))
    named = langid.predict(docs, learned, lang_as=language, score_as=score, fit_as=fit)
    fits = F.coalesce(F.col(f"`{fit}`") > 0, F.col("text").rlike(r"\p{L}") & F.lit(not learned.languages), F.lit(False))
    lang = F.when(F.col(f"`{language}`") != langid.UNDECIDED, F.col(f"`{language}`")).alias("lang")
    return named.where(fits).select([lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that of the most characters, then of the least doc_id. Null texts count as empty; an empty table gives none."""
    return exact_dedup.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates, that of the least doc_id; documents without words and those with a null doc_id stay. An empty table gives none."""
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, by the target weights: leaves over their budget give a prefix, others up to two epochs (a row for each).

    Null languages and sources are leaves of their own, null texts have one token; an empty table gives none.
    """
    return mixing.mix(docs, carry=True).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit decreasing into sequences of 2048 tokens. Null and empty texts are one token, longer texts than a sequence are cut; an empty table gives none."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Language ID, SuperMinHash and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
