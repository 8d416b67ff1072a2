"""Claim facts normalised, repaired and checked for gaps. Row by row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions import text as tx


def duration_days(name: str) -> Column:
    """a stated duration in days; null when absent, not positive or of no known unit."""
    value = F.col(f"{name}_value")
    return F.when(
        value > 0, value * tx.lookup(F.col(f"{name}_unit"), fixed.CLAIM_DAYS)
    ).cast("bigint")


def sum_insured() -> Column:
    """the sum insured in rupees."""
    value = F.col("sum_insured_value")
    return F.when(
        value > 0, value * tx.lookup(F.col("sum_insured_unit"), fixed.MONEY_UNITS)
    ).cast("bigint")


def normalise_facts(claims: DataFrame) -> DataFrame:
    """durations to days, money to rupees, the question on one plain line."""
    return (
        claims.withColumn("scenario", tx.plain("scenario"))
        .withColumn("held_days", duration_days("time_since_policy_start"))
        .withColumn("expense_days", duration_days("expense_timing"))
        .withColumn("known_days", duration_days("condition_known_for"))
        .withColumn("sum_insured_rupees", sum_insured())
    )


def repair_facts(claims: DataFrame) -> DataFrame:
    """an age misfiled as the age at the start, and whether the condition came first.

    Only an unknown is ever filled: first by comparing two stated durations,
    then by the person saying plainly that it began after the policy.
    """
    misfiled = (
        (F.coalesce("age_at_policy_start", F.lit(0)) != 0)
        & (F.coalesce("age", F.lit(0)) == 0)
        & ~F.col("scenario").rlike(fixed.RE_START_WORDS)
    )
    compared = F.when(F.col("known_days") > F.col("held_days"), "yes").when(
        F.col("known_days") < F.col("held_days"), "no"
    )
    said_new = F.when(F.col("scenario").rlike(fixed.RE_STATED_NEW), "no")
    unknown = F.col("pre_existing_condition") == "unknown"
    return (
        claims.withColumn("_misfiled", misfiled)
        .withColumn("age", F.when(F.col("_misfiled"), F.col("age_at_policy_start")).otherwise(F.col("age")))
        .withColumn("age_at_policy_start", F.when(~F.col("_misfiled"), F.col("age_at_policy_start")))
        .withColumn(
            "pre_existing_condition",
            F.when(unknown, F.coalesce(compared, said_new, F.lit("unknown"))).otherwise(
                F.col("pre_existing_condition")
            ),
        )
        .drop("_misfiled")
    )


def stated(name: str, kind: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~c.isin("", "unknown") if kind == "string" else c.isNotNull()


def missing_facts(claims: DataFrame) -> DataFrame:
    """the decisive facts nobody stated, in their fixed order."""
    kinds = dict(claims.dtypes)
    gaps = [F.when(~stated(n, kinds[n]), F.lit(n)) for n in fixed.DECISIVE_FACTS]
    return claims.withColumn("missing_facts", F.array_compact(F.array(*gaps)))


def inception_age(claims: DataFrame) -> DataFrame:
    """age when the policy began: stated, or age now less whole years held."""
    derived = F.col("age") - F.floor(F.col("held_days") / F.lit(365))
    return claims.withColumn(
        "inception_age",
        F.when(F.col("age_at_policy_start") > 0, F.col("age_at_policy_start").cast("bigint")).when(
            (F.col("age") > 0) & (derived > 0) & (derived <= F.col("age")), derived.cast("bigint")
        ),
    )


def prepare_claims(claims: DataFrame) -> DataFrame:
    """F1-F4 in order."""
    return inception_age(missing_facts(repair_facts(normalise_facts(claims))))
