"""Clauses a claim's own words lead to.

Rare words are counted before anything is joined: a stem that more than two
clauses of the policy use never reaches the join, so each claim stem meets at
most two clauses. Claim rows are spread, since a popular stem of a popular
policy may be a third of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.operators import scale


def rare_stems(clauses: DataFrame) -> DataFrame:
    """(policy_id, stem, clause_id) of the stems at most two clauses of a policy use.

    The at most two clauses are the least and the greatest id, so nothing is
    collected for a common stem.
    """
    uses = clauses.select("policy_id", "clause_id", F.explode(tx.stems("text")).alias("stem"))
    counted = uses.groupBy("policy_id", "stem").agg(
        F.count("*").alias("n"), F.min("clause_id").alias("_a"), F.max("clause_id").alias("_b")
    )
    return counted.filter(F.col("n") <= fixed.RARE_CLAUSES).select(
        "policy_id", "stem", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("clause_id")
    )


def first_words(words: str) -> Column:
    """array<(stem, word)>: the first word of each stem among the words."""
    stem = lambda w: F.substring(w, 1, fixed.STEM_CHARS)
    return F.transform(
        F.array_distinct(F.transform(words, stem)),
        lambda s: F.struct(
            s.alias("stem"),
            F.element_at(F.filter(words, lambda w: F.startswith(w, s)), 1).alias("word"),
        ),
    )


def claim_stems(claims: DataFrame, text: Column) -> DataFrame:
    """(claim_id, policy_id, stem, word): the first word of each stem of a text."""
    first = first_words("_words")
    return (
        claims.select("claim_id", "policy_id", tx.stem_words(text).alias("_words"))
        .select("claim_id", "policy_id", F.explode(first).alias("s"))
        .select("claim_id", "policy_id", "s.stem", "s.word")
    )


def _overlap(asked: DataFrame, rare: DataFrame, least: int) -> DataFrame:
    # Rare stems grow with the clauses, whatever the estimate of rows that were exploded.
    met = scale.salted_join(asked, rare.hint("merge"), ["policy_id", "stem"], spread="claim_id")
    return (
        met.groupBy("claim_id", "policy_id", "clause_id")
        .agg(F.count("*").alias("shared"), F.array_sort(F.collect_set("word")).alias("words"))
        .filter(F.col("shared") >= least)
    )


def shared_in_scenario(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """clauses sharing two rare stems or more with the question."""
    return _overlap(claim_stems(claims, F.col("scenario")), rare_stems(clauses), fixed.MIN_SHARED)


def described(name_a: str = "procedure", name_b: str = "condition") -> Column:
    return F.concat_ws(" ", F.coalesce(name_a, F.lit("")), F.coalesce(name_b, F.lit("")))


def named_in_question(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """clauses using one rare stem of the procedure or condition."""
    nameable = clauses.filter(~F.col("clause_type").isin(fixed.DROPPED_FIRST)).select("policy_id", "clause_id")
    rare = rare_stems(clauses).join(nameable, ["policy_id", "clause_id"], "left_semi")
    return _overlap(claim_stems(claims, described()), rare, 1)


def shared_words(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """F12 and F13 together: every clause a claim's words name."""
    both = shared_in_scenario(claims, clauses).unionByName(named_in_question(claims, clauses))
    return both.groupBy("claim_id", "policy_id", "clause_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words")
    )


def said_stems(stems: Column | None = None) -> Column:
    """Stems of the question that are not generic words; `stems` are those of the question where they are at hand."""
    generic = F.array(*[F.lit(w[: fixed.STEM_CHARS]) for w in fixed.GENERIC_WORDS if len(w) >= 5])
    return F.array_except(tx.stems("scenario") if stems is None else stems, generic)


def exception_stems() -> Column:
    return F.array_distinct(F.flatten(F.transform("exceptions", lambda e: tx.stems(e))))


def naming_exclusions(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """exclusions that name the claim, unless the question uses the exception's words."""
    named = named_in_question(claims, clauses)
    excluding = clauses.filter(F.col("clause_type") == "exclusion").select(
        "policy_id", "clause_id", exception_stems().alias("_spared")
    )
    rows = scale.salted_join(named, excluding, ["policy_id", "clause_id"], spread="claim_id")
    said = claims.select("claim_id", said_stems().alias("_said"))
    return (
        rows.join(said, "claim_id")
        .filter(~F.arrays_overlap("_spared", "_said"))
        .drop("_spared", "_said", "shared")
    )


# --- F15 ---------------------------------------------------------------------
# Patterns are literals, one expression per rule: a pattern held in a column
# would be compiled again for every row.


def mentions_other_policy(scenario: Column) -> Column:
    sentences = F.split(scenario, r"(?<=[.;!?])\s+")
    return F.exists(
        sentences,
        lambda s: s.rlike(fixed.RE_ASKS_OTHER_POLICY) & ~s.rlike(fixed.RE_NOT_HELD),
    )


def mentions_own_offence(scenario: Column) -> Column:
    counted = lambda p: F.regexp_count(scenario, F.lit(p))
    return scenario.rlike(fixed.RE_ASKS_OFFENCE) | (
        counted(fixed.RE_ASKS_WHILE_OFFENCE) > counted(fixed.RE_WHILE_OFFENCE_ON_US)
    )


def question_rules(scenario: Column) -> dict[str, Column]:
    return {
        "another_policy": mentions_other_policy(scenario),
        "abroad": scenario.rlike(fixed.RE_ASKS_ABROAD),
        "intoxication": scenario.rlike(fixed.RE_ASKS_INTOXICATION),
        "breach_of_law": mentions_own_offence(scenario),
    }


def breach_quoted() -> Column:
    """What a clause about a breach of law says, on one line."""
    return F.trim(F.regexp_replace(F.regexp_extract("text", fixed.RE_CLAUSE_BREACH, 0), r"\s+", " "))


def clause_rules() -> dict[str, Column]:
    text, exclusion = F.col("text"), F.col("clause_type") == "exclusion"
    return {
        "another_policy": text.rlike(fixed.RE_CLAUSE_OTHER_POLICY),
        "abroad": text.rlike(fixed.RE_CLAUSE_ABROAD),
        "intoxication": exclusion & text.rlike(fixed.RE_CLAUSE_INTOXICATION),
        "breach_of_law": exclusion & text.rlike(fixed.RE_CLAUSE_BREACH),
    }


def fired(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()]))


def trigger_pairs(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """(claim, rule, clause) where the question and a clause meet on a rule.

    `at_home` marks a question about a place abroad that also names home: the
    clause then bars the claim only if the treatment itself was abroad.
    """
    asked = claims.select(
        "claim_id", "policy_id", F.explode(fired(question_rules(F.col("scenario")))).alias("rule"),
        F.col("scenario").rlike(fixed.RE_ASKS_HOME).alias("_home"),
    ).withColumn("at_home", (F.col("rule") == "abroad") & F.col("_home")).drop("_home")
    ruled = clauses.select(
        "policy_id", "clause_id", "order_idx", "text", F.explode(fired(clause_rules())).alias("rule")
    ).select(
        "policy_id", "clause_id", "order_idx", "rule",
        F.when(F.col("rule") == "breach_of_law", breach_quoted()).alias("quoted"),
    )
    return scale.salted_join(asked, ruled, ["policy_id", "rule"], spread="claim_id")


def rule_line(t: Callable[[str], Column]) -> Column:
    """the line of a clause about another policy or treatment abroad, as the question bears on it."""
    who = F.concat(F.lit("clause "), t("clause_id"), F.lit(": "))
    other = t("rule") == "another_policy"
    line = (
        F.when(other, F.concat(who, F.lit("shares the bill with the other policy that is mentioned")))
        .when(t("at_home"), F.concat(who, F.lit("about treatment abroad; home is named too, so settle first where the treatment was")))
        .otherwise(F.concat(who, F.lit("bars treatment abroad, and a place abroad is named")))
    )
    return F.struct(
        F.lit(4).alias("block"), F.when(other, 1).otherwise(2).alias("rank"), F.lit(0).alias("minor"),
        t("order_idx").alias("order_idx"), t("clause_id").alias("clause_id"), line.alias("line"))


def rule_lines(pairs: DataFrame) -> DataFrame:
    rows = pairs.filter(F.col("rule").isin("another_policy", "abroad")).select("claim_id", rule_line(F.col).alias("l"))
    return rows.select("claim_id", "l.*")


def annexure_labels(c: Column) -> Column:
    return F.array_distinct(
        F.transform(F.regexp_extract_all(c, F.lit(fixed.RE_ANNEXURE), F.lit(1)), lambda x: F.upper(x))
    )


def dangling_annexures(clauses: DataFrame, key: str = "doc_id") -> DataFrame:
    """F16: annexures a clause names and no section title of the document has.

    The labels alone go through a window over the document, whose clauses are read once.
    """
    none = F.array().cast("array<string>")
    rows = clauses.select(
        key, "clause_id", "order_idx", annexure_labels(F.col("text")).alias("_named"),
        annexure_labels(F.col("section_path")).alias("_titles"))
    titles = F.collect_set(F.when(F.size("_titles") > 0, F.col("_titles"))).over(Window.partitionBy(key))
    present = F.when(F.col(key).isNotNull(), F.flatten("_present"))
    return rows.withColumn("_present", titles).select(
        key, "clause_id", "order_idx", F.explode(F.array_except("_named", F.coalesce(present, none))).alias("label"))


def named_by_checks(*tables: DataFrame) -> DataFrame:
    """every clause any check or lookup names, once per claim."""
    keys = ["claim_id", "policy_id", "clause_id"]
    return reduce(DataFrame.unionByName, [t.select(*keys) for t in tables]).distinct()


def narrow(claims: DataFrame, clauses: DataFrame, picks: DataFrame, named: DataFrame) -> DataFrame:
    """picks and named clauses in document order, for policies too long to read whole.

    Claims on shorter policies keep every clause.
    """
    sizes = clauses.groupBy("policy_id").agg(tx.tokens_of(F.sum(F.length("text"))).alias("tokens"))
    long = sizes.filter(F.col("tokens") > fixed.PICK_ABOVE_TOKENS).select("policy_id")
    short = sizes.filter(F.col("tokens") <= fixed.PICK_ABOVE_TOKENS).select("policy_id")
    keys = clauses.select("policy_id", "clause_id", "order_idx")
    chosen = named_by_checks(picks, named)
    asked = claims.select("claim_id", "policy_id")
    narrowed = scale.salted_join(
        scale.salted_join(chosen, long, ["policy_id"], "left_semi", spread="claim_id"),
        keys, ["policy_id", "clause_id"], spread="claim_id",
    )
    whole = scale.salted_join(
        scale.salted_join(asked, short, ["policy_id"], "left_semi", spread="claim_id"),
        keys, ["policy_id"], spread="claim_id",
    )
    cols = ["claim_id", "policy_id", "clause_id", "order_idx"]
    return narrowed.select(*cols, F.lit(True).alias("narrowed")).unionByName(
        whole.select(*cols, F.lit(False).alias("narrowed"))
    )
