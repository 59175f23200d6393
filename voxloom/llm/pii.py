"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities: addresses, numbers and the like. A term that stands in documents of an entity
reveals it as far as it tells which entity is meant: the share of the entity's information, -log2 p(e), that the term gives
away is its pointwise mutual information with the entity divided by that. Probabilities are counts of documents over the
whole corpus, and a term's company is the whole document. Terms that give away at least DISCLOSED, seen with the entity in
at least SUPPORT different documents, are spans to generalise or remove wherever they stand in a document of that entity.

How different documents are is told by the pairs of neighbouring words in them; one whose pairs are found in n of the
entity's documents (the median of its pairs) counts as 1/n. So copies of a passage, near copies too, count as about one,
and a fixed line in documents that differ otherwise counts as many. Entities of fewer than SUPPORT documents can't have
such terms; their documents' words are never paired with them.

Built-in functions only. One pass finds the entities; counts of terms are combined before the shuffle; entities of many
documents are dealt over tasks. Every pattern is read in one direction without going back, so very long texts are linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, salted, share, written

#: Different documents of an entity that a term must be seen in, and the share of the entity's information that may be given away.
SUPPORT, DISCLOSED = 3, 0.8
KINDS = ("email", "ip", "card", "phone", "term")
SPANS = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"

#: The base patterns. Possessive forms match what the plain ones match; the look-behind only spares starts
#: within a run that cannot do better than the run's first character.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a try.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{M}\p{N}]++"
_BETWEEN = r"[^\p{L}\p{M}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  the i-th from the right, from 0
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (bare.cast("int") <= 255)


HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost non-overlapping matches in text, in code points from 0.

    Matches are put between two control characters and the text is split there; lengths of the parts give the places.
    """
    free = F.when(text.rlike("[\x01\x02]"), F.regexp_replace(text, "[\x01\x02]", "\x03")).otherwise(text)
    parts = F.split(F.regexp_replace(free, pattern, "\x01$0\x02"), "\x01")
    kind = "array<struct<start: bigint, end: bigint, value: string>>"
    first = F.struct(F.char_length(F.element_at(parts, 1)).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, part: Column) -> Column:
        value = F.substring_index(part, "\x02", 1)
        end = state["at"] + F.char_length(value)
        return F.struct((state["at"] + F.char_length(part) - 1).alias("at"), F.concat(state["out"], F.array(F.struct(state["at"].alias("start"), end.alias("end"), value.alias("value")))).alias("out"))

    found = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first, step, lambda s: s["out"])
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(kind))


def entities(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the base spans, by kind and start."""
    out = []
    for kind, pattern in PATTERNS.items():
        holds = HOLDS[kind]
        real = F.filter(matches(text, pattern), lambda m: holds(m["value"]))  # noqa: B023
        row = lambda m: F.struct(
            F.lit(kind).alias("kind"),  # noqa: B023
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["value"].alias("value"),
        )
        empty = F.array().cast(SPANS)
        out.append(F.when(text.rlike(SIGNS[kind]), F.transform(real, row)).otherwise(empty))
    return F.concat(*out)


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda t: t != "")


def recurring(found: DataFrame) -> DataFrame:
    """(doc, entity, n_entity) of the entities that at least SUPPORT documents of found (doc, entities) have."""
    seen = written(found.select("doc", F.explode("entities").alias("e")).select("doc", F.concat_ws(":", "e.kind", "e.value").alias("entity")).distinct(), "seen")
    of_entity = seen.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    return written(joined(seen, of_entity, "entity", "n_entity", share(seen, seen.count())), "recurring")


def disclosures(found: DataFrame, again: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, n_entity, support, disclosed) of the terms with support; found: doc, text, entities; again: recurring(found); docs: doc, text."""
    texts = found.join(again.select("doc").distinct(), "doc", "left_semi").select("doc", terms_of(masked(F.col("text"), F.col("entities"))).alias("words"))
    near = again.join(texts.groupBy("doc").agg(F.first("words").alias("words")), "doc")  # rows that repeat doc_id and text are one
    pairs = F.transform("words", lambda t, i: F.xxhash64(t, F.get("words", i + 1)))
    pairs = F.when(F.size("words") > 0, F.array_distinct(pairs)).otherwise(F.array(F.lit(0).cast("bigint")))
    company = written(near.select("doc", "entity", F.explode(pairs).alias("pair")).select("doc", "entity", F.xxhash64("entity", "pair").alias("pair")), "company")
    common = company.groupBy("pair").agg(F.count("*").alias("n"))
    weights = joined(company, common, "pair", "n", share(docs, company.count())).groupBy("doc", "entity").agg((1 / F.expr("percentile(n, 0.5)")).alias("weight"))
    own = near.select("doc", "entity", "n_entity", F.explode(F.array_distinct("words")).alias("term")).join(weights, ["doc", "entity"])
    together = own.groupBy("entity", "n_entity", "term").agg(F.round(F.sum("weight"), 6).alias("support"), F.count("*").alias("n_both")).where(F.col("support") >= SUPPORT)
    together = written(together, "together")
    n = docs.count()
    of_term = docs.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    information = F.log2(F.lit(float(n)) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_term") * F.col("n_entity")))
    return together.join(of_term, "term").where(F.col("n_entity") < n).select("entity", "term", "n_entity", "support", (mutual / information).alias("disclosed"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans, sanitised.

    spans: array<struct<kind, start, end, value>>, the base spans, then revealing terms. sanitised: the text with the spans
    generalised or removed, null where there is none and the text stays as it is. Null and empty texts have no spans. Rows
    that repeat doc_id and text each get a row and count as one document; a null doc_id is one of its own; texts of any
    length are read whole; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.xxhash64("doc_id", "text"))
    found = rows.select("doc_id", "doc", "text", entities(F.col("text")).alias("entities"))
    found = written(found.withColumn("text", F.when(F.size("entities") > 0, F.col("text"))), "entities")  # other texts aren't needed again
    held = found.where(F.size("entities") > 0)

    again = recurring(held)
    terms = disclosures(held, again, rows).where(F.col("disclosed") >= DISCLOSED)
    terms = written(terms.groupBy("entity", "n_entity").agg(F.collect_list("term").alias("terms")), "terms")
    wanted = salted(again.drop("n_entity"), terms, "entity", "n_entity", "doc", share(rows, again.count()))
    wanted = wanted.select("doc", F.explode("terms").alias("term")).groupBy("doc").agg(F.collect_set("term").alias("terms"))
    own = F.filter(matches(masked(F.col("text"), F.col("entities")), TERM), lambda m: F.array_contains("terms", F.lower(m["value"])))
    more = F.transform(own, lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    spans = F.when(F.col("terms").isNull(), F.col("entities")).otherwise(F.concat("entities", more))
    with_spans = held.join(wanted, "doc", "left").select("doc_id", spans.alias("spans"), "text").select("doc_id", "spans", sanitised(F.col("text"), F.col("spans")).alias("sanitised"))
    clean = found.where(F.size("entities") == 0).select("doc_id", F.col("entities").alias("spans"), F.lit(None).cast("string").alias("sanitised"))
    return clean.unionByName(with_spans)


def masked(text: Column, spans: Column) -> Column:
    """text with a control character for each character of the spans, so that no term touches one."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    piece = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))

    def step(state: Column, s: Column) -> Column:
        start, end = F.greatest(state["at"], s["start"]), F.greatest(state["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(state["out"], piece(state["at"], start), F.repeat(F.lit("\x03"), (end - start).cast("int"))).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(order, first, step, lambda s: F.concat(s["out"], piece(s["at"], F.char_length(text).cast("bigint"))))


def sanitised(text: Column, spans: Column) -> Column:
    """text with each span generalised: an entity to its kind in brackets, a term with a capital to [name], any other term removed.

    Of overlapping spans the first, and of one start the longest, stands.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["value"].alias("value"))))
    word = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["value"].rlike(r"^\p{Lu}"), "[name]").otherwise("")
    piece = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))

    def step(state: Column, s: Column) -> Column:
        put = F.struct((-s["back"]).alias("at"), F.concat(state["out"], piece(state["at"], s["start"]), word(s)).alias("out"))
        return F.when(s["start"] >= state["at"], put).otherwise(state)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(order, start, step, lambda s: F.concat(s["out"], piece(s["at"], F.char_length(text).cast("bigint"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of personal_data() for comparison."""
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    n_terms = F.size(of("term")).cast("long").alias("n_terms")
    return found.select("doc_id", *counts, F.sha2(join(of(*KINDS[:4])), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"), n_terms, "sanitised")
