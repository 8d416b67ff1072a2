"""Every claim compared with the clauses of its own policy.

Everything that depends on the clause alone is computed once per clause and
the clauses that set nothing drop out before the join. The join is on
`policy_id` with the claims spread, since one policy may hold a third of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.operators import scale

NO_WORDS = "cast(array() as array<string>)"


def one_line(c) -> Column:
    """Ligatures split, whitespace runs to one space."""
    return F.trim(F.regexp_replace(tx.expand_ligatures(c), r"\s+", " "))


WAIT = [
    "clause_id", "order_idx", "clause_type", "required_days", "exceptions", "listed", "pre_existing", "listing", "subject",
    "exception_stems",
]


def waiting_terms(clauses: DataFrame) -> DataFrame:
    """Clause side of F5 as a column `wait`: periods, and whom the wait concerns; null where a clause sets none."""
    stated = F.filter("waiting_periods_days", lambda d: d > 0)
    numbers = F.regexp_extract_all("_text", F.lit(fixed.RE_DURATION), F.lit(1))
    units = F.regexp_extract_all("_text", F.lit(fixed.RE_DURATION), F.lit(2))
    read = F.zip_with(
        numbers, units,
        lambda n, u: n.cast("int") * tx.lookup(F.concat(F.lower(u), F.lit("s")), fixed.PERIOD_DAYS),
    )
    df = (
        clauses.withColumn("_heading", F.trim(tx.expand_ligatures(F.coalesce("heading", F.lit("")))))
        .withColumn("_text", one_line(F.coalesce("text", F.lit(""))))
        .withColumn(
            "_days",
            F.array_sort(
                F.array_distinct(
                    F.when(F.size(stated) > 0, stated)
                    .when(F.col("_heading").rlike(fixed.RE_HEADED_WAIT), read)
                    .otherwise(F.array().cast("array<int>"))
                )
            ),
        )
    )
    both = F.concat_ws(" ", "_heading", "_text")
    opening = F.substring("_text", 1, fixed.OPENING_CHARS)
    waits = (
        (F.size("_days") > 0)
        & (F.regexp_count("_text", F.lit(fixed.RE_MEANS)) < fixed.DEFINITIONS_BLOCK)
        & both.rlike(fixed.RE_WAITS)
    )
    section = F.coalesce("section_path", F.lit(""))
    listed = F.concat_ws(" ", F.col("_heading"), opening).rlike(fixed.RE_LISTED) | (
        (section != "") & ~section.rlike(fixed.RE_GENERAL_SECTION)
    )
    body = F.trim(
        F.when(
            F.startswith("_text", F.col("_heading")), F.expr("substring(_text, length(_heading) + 1)")
        ).otherwise(F.col("_text"))
    )
    listing = F.when(
        F.col("_body").rlike(fixed.RE_LIST_STARTS),
        F.regexp_extract("_body", r"(?is)" + fixed.RE_LIST_STARTS.replace("(?i)", "") + ".*$", 0),
    ).otherwise(F.col("_body"))
    fields = F.struct(
        "clause_id", "order_idx", "clause_type", F.col("_days").alias("required_days"), "exceptions",
        F.col("_listed").alias("listed"), opening.rlike(fixed.RE_PRE_EXISTING).alias("pre_existing"),
        F.when(F.col("_listed") & (F.length(listing) <= fixed.QUOTED_LIST_CHARS), listing).otherwise(F.lit("")).alias("listing"),
        F.regexp_replace("_heading", fixed.RE_HEADING_NUMBER, "").alias("subject"),
        F.array_distinct(F.flatten(F.transform("exceptions", lambda e: tx.stems(e)))).alias("exception_stems"),
    )
    return df.withColumns({"_waits": waits, "_body": body, "_listed": listed}).withColumn(
        "wait", F.when(F.col("_waits"), fields)).drop("_heading", "_text", "_days", "_waits", "_body", "_listed")


def waiting_clauses(clauses: DataFrame) -> DataFrame:
    return waiting_terms(clauses).where("wait is not null").select("policy_id", *[F.col("wait")[f].alias(f) for f in WAIT])


def wait_status(days: Column, held: Column) -> Column:
    """served when the longest period is over, not served before the shortest."""
    return (
        F.when(held.isNull(), "unknown")
        .when(held >= F.array_max(days), "served")
        .when(held < F.array_min(days), "not_served")
        .otherwise("partly_served")
    )


def condition_predates() -> Column:
    return F.coalesce("pre_existing_condition", F.lit("unknown"))


def waiting_checks(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """F5, one row per claim and waiting clause."""
    asked = claims.select("claim_id", "policy_id", "held_days", condition_predates().alias("condition_predates"))
    return scale.salted_join(
        asked, waiting_clauses(clauses), ["policy_id"], spread="claim_id"
    ).withColumn("status", wait_status(F.col("required_days"), F.col("held_days")))


WINDOW = ["clause_id", "order_idx", "clause_type", "window_days", "anchor"]


def window_terms(clauses: DataFrame) -> DataFrame:
    """Clause side of F6 as a column `window`: days and side, read from coverage text where none was given."""
    text = one_line(F.coalesce("text", F.lit("")))
    found = F.regexp_extract(text, fixed.RE_STATED_WINDOW, 0)
    given = F.coalesce(F.col("cover_window_days"), F.lit(0)) != 0
    reads = ~given & (F.col("clause_type") == "coverage") & (found != "")
    days = F.when(reads, F.regexp_extract(text, fixed.RE_STATED_WINDOW, 1).cast("bigint")).otherwise(F.col("cover_window_days"))
    side = F.when(F.contains(F.lower(found), F.lit("discharge")), "after_discharge").otherwise("before_admission")
    df = clauses.withColumns({"_days": days, "_anchor": F.when(reads, side).otherwise(F.col("cover_window_anchor"))})
    sets = (F.col("_days") > 0) & F.col("_anchor").isin(fixed.WINDOW_ANCHORS)
    fields = F.struct(
        "clause_id", "order_idx", "clause_type", F.col("_days").alias("window_days"), F.col("_anchor").alias("anchor"))
    return df.withColumn("window", F.when(sets, fields)).drop("_days", "_anchor")


def window_clauses(clauses: DataFrame) -> DataFrame:
    return window_terms(clauses).where("window is not null").select(
        "policy_id", *[F.col("window")[f].alias(f) for f in WINDOW])


def window_status(anchor: Column, limit: Column, side: Column, days: Column) -> Column:
    """not raised on the other side of the stay; the last day counts."""
    return (
        F.when(~side.eqNullSafe(anchor), "not_raised")
        .when(days.isNull(), "unknown")
        .when(days <= limit, "within")
        .otherwise("outside")
    )


def window_checks(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """F6, one row per claim and clause with a window."""
    asked = claims.select(
        "claim_id", "policy_id", F.col("expense_timing_anchor").alias("_side"), "expense_days"
    )
    status = window_status(F.col("anchor"), F.col("window_days"), F.col("_side"), F.col("expense_days"))
    return (
        scale.salted_join(asked, window_clauses(clauses), ["policy_id"], spread="claim_id")
        .withColumn("status", status)
        .drop("_side")
    )


def _nonzero(c: Column | str) -> Column:
    return F.coalesce(tx.col(c), F.lit(0)) != 0


REDUCTION_TERMS = ["copay_percent", "copay_min_age_at_inception", *fixed.DAILY_CAPS]


def reduction_terms(clauses: DataFrame) -> DataFrame:
    """Clause side of F7-F9 as a column `cut`: what can reduce a payout, and the words it uses."""
    words = F.array_distinct(
        F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))
    )
    reduces = (
        _nonzero("copay_percent") | _nonzero("cap_percent_of_sum_insured")
        | _nonzero("icu_cap_percent_of_sum_insured") | (F.col("clause_type") == "sub_limit")
    )
    return clauses.withColumn(
        "cut", F.when(reduces, F.struct("clause_id", "order_idx", "clause_type", *REDUCTION_TERMS, words.alias("words"))))


def reduction_clauses(clauses: DataFrame) -> DataFrame:
    fields = ["clause_id", "order_idx", "clause_type", *REDUCTION_TERMS, "words"]
    return reduction_terms(clauses).where("cut is not null").select("policy_id", *[F.col("cut")[f].alias(f) for f in fields])


def described_words() -> Column:
    """The particular words of the procedure and condition of a claim."""
    said = F.lower(F.concat_ws(" ", F.coalesce("procedure", F.lit("")), F.coalesce("condition", F.lit(""))))
    words = F.regexp_extract_all(said, F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in fixed.GENERIC_WORDS]))


def copay_status(floor: Column) -> Column:
    """F7."""
    silent = (F.coalesce("age", F.lit(0)) == 0) & (F.coalesce("age_at_policy_start", F.lit(0)) == 0)
    return (
        F.when(floor.isNull(), "applies")
        .when(F.col("inception_age").isNull(), F.when(silent, "not_raised").otherwise("unknown"))
        .when(F.col("inception_age") >= floor, "applies")
        .otherwise("does_not_apply")
    )


def cap_status(limit: Column) -> Column:
    """F8. The limit is the lower of the percentage and the stated maximum."""
    no_sum = F.col("sum_insured_rupees").isNull()
    charged = F.col("room_rent_per_day_inr")
    no_charge = F.coalesce(charged, F.lit(0)) == 0
    return (
        F.when(no_sum & no_charge, "not_raised")
        .when(no_sum | F.coalesce(charged <= 0, F.lit(True)), "unknown")
        .when(charged > limit, "applies")
        .otherwise("does_not_apply")
    )


CUT = [
    "clause_id", "order_idx", "clause_type", "kind", "status", "named", "copay_percent", "copay_min_age_at_inception",
    "inception_age", "cap_percent", "cap_max", "is_icu", "sum_insured_rupees", "room_rent_per_day_inr", "limit_inr",
]


def _reduction(t: Callable[[str], Column]) -> dict[str, Column]:
    icu = F.coalesce("room_is_icu", F.lit(False))
    percent = F.when(icu, t("icu_cap_percent_of_sum_insured")).otherwise(t("cap_percent_of_sum_insured"))
    most = F.when(icu, t("icu_cap_max_inr_per_day")).otherwise(t("cap_max_inr_per_day"))
    share = F.call_function("div", F.col("sum_insured_rupees") * percent, F.lit(100))
    kind = (
        F.when(_nonzero(t("copay_percent")), "copay").when(_nonzero(percent), "room_cap")
        .when(t("clause_type") == "sub_limit", "other_cap"))
    limit = F.when(kind == "room_cap", F.least(share, F.when(_nonzero(most), most.cast("bigint"))))
    status = (
        F.when(kind == "copay", copay_status(t("copay_min_age_at_inception")))
        .when(kind == "room_cap", cap_status(limit)).otherwise("judgement"))
    return {"icu": icu, "percent": percent, "most": most, "share": share, "kind": kind, "limit": limit, "status": status}


def reduction_status(t: Callable[[str], Column]) -> tuple[Column, Column]:
    """F7-F9 for one clause: the kind and status of `reduction`."""
    found = _reduction(t)
    return found["kind"], found["status"]


def reduction(t: Callable[[str], Column], said: Column | str = "said") -> Column:
    """F7-F9 for one clause: co-payment before daily cap before judgement; `kind` is null where none of them is raised.

    `t` gives the terms of the clause; the facts of the claim are columns, and `said` its particular words.
    """
    icu, percent, most, share, kind, limit, status = _reduction(t).values()
    named = F.when(
        kind == "other_cap", F.array_sort(F.array_intersect(said, t("words")))).otherwise(F.expr(NO_WORDS))
    return F.struct(
        t("clause_id").alias("clause_id"), t("order_idx").alias("order_idx"), t("clause_type").alias("clause_type"),
        kind.alias("kind"), status.alias("status"), named.alias("named"), t("copay_percent").alias("copay_percent"),
        t("copay_min_age_at_inception").alias("copay_min_age_at_inception"), F.col("inception_age").alias("inception_age"),
        percent.alias("cap_percent"), most.alias("cap_max"), icu.alias("is_icu"),
        F.col("sum_insured_rupees").alias("sum_insured_rupees"), F.col("room_rent_per_day_inr").alias("room_rent_per_day_inr"),
        # A limit exists only where the sum insured does; the maximum alone decides nothing.
        F.when(share.isNotNull(), limit).alias("limit_inr"))


def reduction_checks(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """F7-F9, one row per claim and clause that raises one of them."""
    asked = claims.select(
        "claim_id", "policy_id", "age", "age_at_policy_start", "inception_age", "sum_insured_rupees",
        "room_rent_per_day_inr", "room_is_icu", described_words().alias("said"),
    )
    df = scale.salted_join(asked, reduction_clauses(clauses), ["policy_id"], spread="claim_id")
    return df.select("claim_id", "policy_id", reduction(F.col).alias("cut")).where("cut.kind is not null").select(
        "claim_id", "policy_id", *[F.col("cut")[f].alias(f) for f in CUT])


def evaluate_claims(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """F5-F9 as one long table: (claim, clause, family, status)."""
    keys = ["claim_id", "policy_id", "clause_id", "order_idx"]
    waits = waiting_checks(claims, clauses).select(*keys, F.lit("waiting").alias("family"), "status")
    windows = window_checks(claims, clauses).select(*keys, F.lit("window").alias("family"), "status")
    cuts = reduction_checks(claims, clauses).select(*keys, F.col("kind").alias("family"), "status")
    return waits.unionByName(windows).unionByName(cuts)


# --- F19: evidence lines, in our own words ---------------------------------


def human_days(d: Column) -> Column:
    years, months = (d / 365).cast("bigint"), (d / 30).cast("bigint")
    word = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n == 1, "").otherwise("s"))
    return (
        F.when(d.isNull(), "an unstated time")
        .when((d >= 365) & (d % 365 == 0), word(years, "year"))
        .when((d >= 30) & (d % 30 == 0), word(months, "month"))
        .otherwise(word(d, "day"))
    )


def human_periods(days: Column) -> Column:
    return F.array_join(F.transform(days, lambda d: human_days(d)), " or ")


LINE = ["block", "rank", "minor", "order_idx", "clause_id", "line"]


def _line(block: int, rank: Column, minor: Column, t: Callable[[str], Column], line: Column) -> Column:
    return F.struct(
        F.lit(block).alias("block"), rank.alias("rank"), minor.alias("minor"), t("order_idx").alias("order_idx"),
        t("clause_id").alias("clause_id"), line.alias("line"))


def _flat(rows: DataFrame, line: Column) -> DataFrame:
    return rows.select("claim_id", line.alias("l")).select("claim_id", *[F.col("l")[f].alias(f) for f in LINE])


def waiting_line(t: Callable[[str], Column]) -> Column:
    """The line of one waiting check; null text where it is served and names nothing."""
    none = F.expr(NO_WORDS)
    names = F.size(F.coalesce(t("named"), none)) > 0
    status, earlier, days = t("status"), t("pre_existing"), t("required_days")
    settled_new = earlier & (t("condition_predates") == "no")
    open_ = status.isin("not_served", "partly_served")
    rank = (
        F.when(settled_new, 1).when((status == "served") & names, 2)
        .when(status == "served", 0).when(open_, 3).otherwise(4)
    )
    need, held = human_periods(days), human_days(t("held_days"))
    who = F.concat(
        F.lit("clause "), t("clause_id"),
        F.when(t("subject") != "", F.concat(F.lit(" ("), t("subject"), F.lit(")"))).otherwise(""),
    )
    after_of = lambda keep: human_periods(F.filter(days, keep))
    line = (
        F.when(rank == 0, F.lit(None))
        .when(status == "partly_served", F.concat(
            who, F.lit(": the wait of "), after_of(lambda d: d <= t("held_days")),
            F.lit(" is over after "), held, F.lit("; the wait of "),
            after_of(lambda d: d > t("held_days")), F.lit(" is not")))
        .when(settled_new, F.concat(who, F.lit(": for earlier ailments only; this one began later")))
        .when(earlier & (t("condition_predates") == "yes") & (status == "not_served"),
              F.concat(who, F.lit(": the ailment came first and "), held, F.lit(" of "), need, F.lit(" has passed: it bars the claim")))
        .when(earlier & (status != "served"),
              F.concat(who, F.lit(": for earlier ailments only; needs "), need, F.lit(", held "), held))
        .when(status == "unknown", F.concat(who, F.lit(": needs "), need, F.lit("; time held not stated")))
        .when(status == "served", F.concat(who, F.lit(": the wait of "), need, F.lit(" is over after "), held))
        .when(t("listed") & ~names & (F.size(t("exceptions")) == 0), F.concat(
            who, F.lit(": bars only what it lists; needs "), need, F.lit(", held "), held,
            F.when(t("listing") != "", F.concat(F.lit("; it lists: "), t("listing"))).otherwise("")))
        .otherwise(F.concat(
            who, F.lit(": needs "), need, F.lit(", held "), held, F.lit(": it bars the claim"),
            F.when(F.size(t("exceptions")) > 0, F.concat(F.lit(" except "), F.array_join(t("exceptions"), "; "))).otherwise("")))
    )
    # Among open waits: those naming the treatment first, earlier-ailment bars last.
    minor = F.when(rank >= 3, F.when(names, 0).otherwise(2) + earlier.cast("int")).otherwise(0)
    return _line(1, rank, minor, t, line)


def waiting_lines(checks: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """A line per waiting check; served ones that name nothing collapse later."""
    if named is not None:
        checks = checks.join(
            named.select("claim_id", "clause_id", F.col("words").alias("named")),
            ["claim_id", "clause_id"], "left",
        )
    else:
        checks = checks.withColumn("named", F.expr(NO_WORDS))
    return _flat(checks, waiting_line(F.col))


def rupees(n: Column) -> Column:
    return (
        F.when((n >= 10000000) & (n % 10000000 == 0), F.concat((n / 10000000).cast("bigint").cast("string"), F.lit(" crore")))
        .when((n >= 100000) & (n % 100000 == 0), F.concat((n / 100000).cast("bigint").cast("string"), F.lit(" lakh")))
        .otherwise(F.concat(n.cast("string"), F.lit(" rupees")))
    )


def reduction_line(t: Callable[[str], Column]) -> Column:
    """The line of one reduction; null rank where there is nothing to say, null text for a ruled-out co-payment."""
    who = F.concat(F.lit("clause "), t("clause_id"), F.lit(": "))
    percent = F.concat(t("copay_percent").cast("string"), F.lit("% co-payment"))
    what = F.when(t("is_icu"), "intensive care").otherwise("room")
    charged = rupees(t("room_rent_per_day_inr"))
    cap = F.concat(t("cap_percent").cast("string"), F.lit("% of "), rupees(t("sum_insured_rupees")),
                   F.lit(" allows "), rupees(t("limit_inr")), F.lit(" a day for "), what)
    copay, room, st, floor = t("kind") == "copay", t("kind") == "room_cap", t("status"), t("copay_min_age_at_inception")
    line = (
        F.when(copay & (st == "applies") & floor.isNull(), F.concat(who, percent, F.lit(" on every claim that is paid")))
        .when(copay & (st == "applies"), F.concat(
            who, percent, F.lit(" applies: aged "), t("inception_age").cast("string"), F.lit(" at the start, limit "),
            floor.cast("string")))
        .when(copay & (st == "unknown"), F.concat(who, percent, F.lit(" cannot be settled: age at the start not stated")))
        .when(room & (st == "applies"), F.concat(who, cap, F.lit("; charged "), charged, F.lit(", over it")))
        .when(room & (st == "unknown"), F.concat(who, what, F.lit(" cap cannot be settled: a figure is missing")))
        .when(room & (st == "does_not_apply"), F.concat(who, cap, F.lit("; charged "), charged, F.lit(", within it")))
        .when((st == "judgement") & (F.size(t("named")) > 0), F.concat(who, F.lit("limits "), F.array_join(t("named"), ", "), F.lit("; read it")))
    )
    rank = (
        F.when(st == "not_raised", F.lit(None)).when(st == "applies", 1).when(st == "unknown", 2).when(room, 3)
        .when(st == "does_not_apply", 0).when(F.size(t("named")) > 0, 4)
    )
    return _line(2, rank, F.lit(0), t, line)


def reduction_lines(checks: DataFrame) -> DataFrame:
    """A line per raised reduction; ruled-out co-payments collapse later."""
    return _flat(checks, reduction_line(F.col)).where("rank is not null")


def window_line(t: Callable[[str], Column]) -> Column:
    """The line of one window; null rank where the claim doesn't raise it."""
    side = F.when(t("anchor") == "after_discharge", "after discharge").otherwise("before admission")
    rule = F.concat(F.lit("clause "), t("clause_id"), F.lit(": pays within "),
                    t("window_days").cast("string"), F.lit(" days "), side, F.lit("; "))
    days = t("expense_days").cast("string")
    line = (
        F.when(t("status") == "outside", F.concat(rule, days, F.lit(" days is outside")))
        .when(t("status") == "within", F.concat(rule, days, F.lit(" days is within")))
        .otherwise(F.concat(rule, F.lit("how many days is not stated")))
    )
    return _line(3, F.when(t("status") != "not_raised", 1), F.lit(0), t, line)


def window_lines(checks: DataFrame) -> DataFrame:
    return _flat(checks, window_line(F.col)).where("rank is not null")


def evidence(lines: DataFrame) -> DataFrame:
    """the lines of a claim in order; ids ruled out share one line per block.

    A claim has a line per check of its own policy at most, so the lists stay small.
    """
    settled = F.col("line").isNull()
    folded = lines.filter(settled).groupBy("claim_id", "block").agg(
        F.concat(
            F.lit("settled and beside the point: "),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("order_idx", "clause_id"))), lambda x: x["clause_id"]
                ),
                ", ",
            ),
        ).alias("line")
    ).select("claim_id", "block", F.lit(0).alias("rank"), F.lit(0).alias("minor"), F.lit(-1).alias("order_idx"), "line")
    every = folded.unionByName(
        lines.filter(~settled).select("claim_id", "block", "rank", "minor", "order_idx", "line")
    )
    ordered = F.array_sort(F.collect_list(F.struct("block", "rank", "minor", "order_idx", "line")))
    return every.groupBy("claim_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("evidence")
    )
