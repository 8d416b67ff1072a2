"""Clause scores, ranking and the tables read off them.

The input is one table: clauses with their analyses (S6). Clauses without an
analysis are not scored, but they still count towards position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions import text as tx


def _document() -> "Window":
    return Window.partitionBy("doc_id")


def readability(rows: DataFrame, text: str = "text") -> DataFrame:
    """Words, units, syllables and grade of a text column, row by row."""
    return (
        rows.withColumn("_readable", tx.readable(text))
        .withColumn("words", tx.word_count("_readable"))
        .withColumn("units", tx.sentence_units("_readable"))
        .withColumn("syllables", tx.syllable_count("_readable"))
        .withColumn(
            "grade", tx.reading_grade(F.col("words"), F.col("units"), F.col("syllables"))
        )
        .drop("_readable")
    )


def crossref_count(text) -> Column:
    """Phrases that send the reader elsewhere."""
    return F.regexp_count(tx.plain(text), F.lit(fixed.RE_CROSSREF)).cast("bigint")


def clause_terms() -> Column:
    """T3, per clause: the terms a definition clause defines."""
    heading = F.btrim(
        F.when(F.col("number") != "", F.expr("substring(heading, length(number) + 1)")).otherwise(
            F.col("heading")
        ),
        F.lit(" .-"),
    )
    from_heading = F.when(
        (F.col("heading") != "") & (F.length(heading) > 2) & (F.length(heading) < 60), F.lower(heading)
    )
    said = F.regexp_extract(F.trim("text"), fixed.RE_TERM_MEANS, 1)
    from_text = F.lower(F.btrim(said, F.lit(" .-0123456789")))
    both = F.filter(
        F.array(from_heading, from_text), lambda t: t.isNotNull() & (t != "")
    )
    return F.when(F.col("clause_type") == "definition", F.array_distinct(both))


def defined_terms(clauses: DataFrame) -> DataFrame:
    """The defined-term dictionary of each document."""
    return clauses.select("doc_id", F.explode(clause_terms()).alias("term")).distinct()


def term_use(clauses: DataFrame) -> DataFrame:
    """T4: how many of the document's terms a clause uses.

    The dictionary is a window over the document, so no clause is paired with
    a term in a row of its own.
    """
    terms = F.array_distinct(F.flatten(F.collect_list("_terms").over(_document())))
    used = F.filter(F.col("_dictionary"), lambda t: F.contains(F.col("_lower"), t))
    return (
        clauses.withColumn("_terms", clause_terms())
        .withColumn("_dictionary", terms)
        .withColumn("_lower", F.lower("text"))
        .withColumn("terms_used", F.size(used).cast("bigint"))
        .drop("_terms", "_dictionary", "_lower")
    )


def positions(clauses: DataFrame) -> DataFrame:
    """T5: rank / (n - 1) within the document."""
    return clauses.withColumn(
        "position", F.percent_rank().over(_document().orderBy("order_idx"))
    )


def signals(clauses: DataFrame) -> DataFrame:
    """T1-T5 as signals between 0 and 1."""
    df = readability(positions(term_use(clauses)))
    return (
        df.withColumn("crossrefs", crossref_count("text"))
        .withColumn(
            "reading",
            F.least(F.greatest((F.col("grade") - 8.0) / 12.0, F.lit(0.0)), F.lit(1.0)),
        )
        .withColumn("crossref", F.least(F.col("crossrefs") / 4.0, F.lit(1.0)))
        .withColumn("jargon", F.least(F.col("terms_used") / 3.0, F.lit(1.0)))
    )


def buriedness() -> Column:
    """T6."""
    return (
        fixed.W_POSITION * F.col("position")
        + fixed.W_READING * F.col("reading")
        + fixed.W_CROSSREF * F.col("crossref")
        + fixed.W_JARGON * F.col("jargon")
    )


def type_weight(clause_type: str = "clause_type") -> Column:
    return F.coalesce(
        tx.lookup(F.col(clause_type), fixed.TYPE_WEIGHT), F.lit(fixed.OTHER_TYPE_WEIGHT)
    )


def impact() -> Column:
    """T7."""
    blend = 0.5 * ((F.col("likelihood") - 1) / 4) + 0.5 * ((F.col("severity") - 1) / 4)
    return (
        100.0 * type_weight() * blend * (1 + fixed.BURIED_BOOST * F.col("buriedness"))
        / (1 + fixed.BURIED_BOOST)
    )


def score_clauses(clauses: DataFrame, digits: int | None = None) -> DataFrame:
    """T1-T7 in one pass; unanalysed clauses drop out after position is known.

    Rounded as stored (4 for signals, 2 for impact, 1 for the grade), or to
    `digits` everywhere when that is given.
    """
    df = (
        signals(clauses).filter("clause_type is not null")
        .withColumn("buriedness", buriedness())
        .withColumn("impact", impact())
    )
    for name, stored in [
        ("impact", 2), ("buriedness", 4), ("position", 4), ("reading", 4), ("crossref", 4),
        ("jargon", 4), ("grade", 1),
    ]:
        df = df.withColumn(name, F.round(name, stored if digits is None else digits))
    return df


SCORE_COLUMNS = [
    "doc_id", "order_idx", "buriedness", "impact", "position", "reading", "crossref", "jargon", "grade",
]


def top_risks(scored: DataFrame, k: int = fixed.TOP_RISKS_DEFAULT) -> DataFrame:
    """The k clauses of each document with most impact."""
    if not 1 <= k <= fixed.TOP_RISKS_MAX:
        raise ValueError(f"k must be between 1 and {fixed.TOP_RISKS_MAX}")
    w = _document().orderBy(F.desc("impact"), "order_idx")
    return scored.withColumn("risk_rank", F.row_number().over(w)).filter(F.col("risk_rank") <= k)


def type_counts(clauses: DataFrame) -> DataFrame:
    """Clauses per type and document, most common first."""
    counts = (
        clauses.filter("clause_type is not null")
        .groupBy("doc_id", "clause_type").agg(F.count("*").alias("clauses"))
    )
    w = _document().orderBy(F.desc("clauses"), "clause_type")
    return counts.withColumn("type_rank", F.row_number().over(w))


def unanalysed_counts(clauses: DataFrame) -> DataFrame:
    """Clauses per document that have no analysis."""
    return clauses.groupBy("doc_id").agg(
        F.count("*").alias("clauses"),
        F.count_if(F.col("clause_type").isNull()).alias("unanalysed"),
    )


def clause_listing(
    scored: DataFrame, clause_type: str | None = None, sort: str = "impact"
) -> DataFrame:
    """Clauses in impact or document order, optionally of one type."""
    if sort not in ("impact", "document"):
        raise ValueError("sort is impact or document")
    rows = scored if clause_type is None else scored.filter(F.col("clause_type") == clause_type)
    order = (F.desc("impact"), F.col("order_idx")) if sort == "impact" else (F.col("order_idx"),)
    return rows.withColumn("listing_rank", F.row_number().over(_document().orderBy(*order)))


def clause_details(keys: DataFrame, scored: DataFrame) -> DataFrame:
    """A batch of (doc_id, order_idx) looked up with verbatim text and signals."""
    return scored.join(keys.select("doc_id", "order_idx").distinct(), ["doc_id", "order_idx"], "left_semi")


def burial_reasons(scored: DataFrame) -> DataFrame:
    """Why a clause is easy to miss, and how easy."""
    reasons = F.array_compact(
        F.array(
            *[
                F.when(F.col(signal) >= floor, F.lit(words))
                for signal, (floor, words) in fixed.BURIED_REASONS.items()
            ]
        )
    )
    label = None
    for floor, words in fixed.BURIED_BANDS:
        hit = F.col("buriedness") >= floor
        label = F.when(hit, words) if label is None else label.when(hit, words)
    return scored.withColumn("reasons", reasons).withColumn(
        "buried_label", label.otherwise(fixed.BURIED_PLAIN)
    )


def risk_chips(counts: DataFrame) -> DataFrame:
    """Type chips risky first, then by count, with the document's risky total."""
    risky = F.col("clause_type").isin(fixed.RISKY_TYPES)
    w = _document().orderBy(F.when(risky, 0).otherwise(1), F.desc("clauses"), "clause_type")
    total = F.coalesce(F.sum(F.when(risky, F.col("clauses"))).over(_document()), F.lit(0))
    return (
        counts.withColumn("risky_total", total)
        .withColumn("is_risky", risky)
        .withColumn("chip_rank", F.row_number().over(w))
    )


def analysis_profile(claim_clauses: DataFrame, kept: DataFrame, top: int = 15) -> DataFrame:
    """By type, clauses kept and dropped by the shortlist; id collisions; top by impact."""
    keys = ["doc_id", "order_idx"]
    marked = claim_clauses.join(
        kept.select(*keys).distinct().withColumn("kept", F.lit(True)), keys, "left"
    )
    w = _document().orderBy(F.desc("impact"), "order_idx")
    ranked = marked.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy("doc_id", "clause_type").agg(
        F.count("*").alias("clauses"),
        F.count_if(F.col("kept")).alias("kept"),
        F.count_if(F.col("kept").isNull()).alias("dropped"),
        F.count_if(F.col("_rank") <= top).alias("in_top"),
        F.count_if(F.contains("clause_id", F.lit("#"))).alias("repeated_ids"),
    )
