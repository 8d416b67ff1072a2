"""Evaluation of labels, rankings, answers and repeated runs.

Cases may be lopsided, so every table is counted down to (case, value) before
any window looks at it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.operators import scale
from clausewright.sources.shared import bounded_batches


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


# --- E1 ------------------------------------------------------------------------


def confusion(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Counts of (expected, predicted); a missing prediction stays null."""
    return (
        labels.join(predictions, key, "left").groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    )


def class_metrics(counts: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of every class seen on either side."""
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("expected").alias("class"), F.col("n").alias("support"),
                    F.when(F.col("expected").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                    F.lit(0).cast("bigint").alias("fp"),
                ),
                F.struct(
                    F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.when(F.col("expected").eqNullSafe(F.col("predicted")), F.lit(0)).otherwise(F.col("n")).alias("fp"),
                ),
            )
        ).alias("s")
    ).select("s.*").filter("class is not null")
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp")
    )
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("support"))
    return (
        sums.withColumn("precision", precision).withColumn("recall", recall)
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """Macro-F1 over classes with support or false positives, and accuracy."""
    return metrics.agg(
        F.coalesce(F.avg(F.when((F.col("support") > 0) | (F.col("fp") > 0), F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("labelled"),
    )


# --- E2 ------------------------------------------------------------------------


def ranking_expectations(scored: DataFrame, expectations: DataFrame, top_n: int) -> DataFrame:
    """Each expectation (policy_id, number, must) with the rank found and whether it holds.

    Every clause takes a rank; of clauses sharing a number the last rank counts.
    """
    w = Window.partitionBy("policy_id").orderBy(F.desc("impact"), "order_idx")
    ranks = (
        scored.select("policy_id", "number", F.row_number().over(w).alias("rank"))
        .filter("number <> ''").groupBy("policy_id", "number").agg(F.max("rank").alias("rank"))
    )
    top = F.coalesce(F.col("rank") <= top_n, F.lit(False))
    return (
        expectations.join(ranks, ["policy_id", "number"], "left")
        .withColumn("holds", F.when(F.col("must"), top).otherwise(~top))
    )


# --- E3, E4, E10 -----------------------------------------------------------------


def answer_rows(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Answers (answer_id, case_id, verdict, expected, required, forbidden) judged.

    citations are audited: verified is recomputed, and `flag` is what the
    stored answer claimed.
    """
    empty = F.array().cast("array<string>")
    cited = citations.groupBy("answer_id").agg(
        F.array_sort(F.collect_set("clause_id")).alias("cited"),
        F.array_sort(F.collect_set(F.when(F.col("effect").isin(fixed.ADVERSE), F.col("clause_id")))).alias("against"),
        F.bool_and("flag").alias("grounded"),
        F.count_if(~F.col("verified")).alias("truly_bad"),
        F.count_if(~F.col("verified") & ~F.col("flag")).alias("flagged_bad"),
    )
    rows = (
        answers.join(cited, "answer_id", "left")
        .withColumn("cited", F.coalesce("cited", empty))
        .withColumn("against", F.coalesce("against", empty))
        .withColumn("grounded", F.coalesce("grounded", F.lit(True)))
        .na.fill(0, ["truly_bad", "flagged_bad"])
    )
    return (
        rows.withColumn("verdict_ok", F.col("verdict") == F.col("expected"))
        .withColumn("missing", F.array_sort(F.array_except("required", "cited")))
        .withColumn("citation_ok", F.size("missing") == 0)
        .withColumn("wrongly_cited", F.array_sort(F.array_intersect("against", "forbidden")))
        .drop("against")
    )


def run_metrics(rows: DataFrame) -> DataFrame:
    """One row of rates; integrity is recomputed, never read from the flag."""
    citable, guarded = F.size("required") > 0, F.size("forbidden") > 0
    return rows.agg(
        F.count("*").alias("total"),
        ratio(F.count_if("verdict_ok"), F.count("*")).alias("verdict_accuracy"),
        ratio(F.count_if(citable & F.col("citation_ok")), F.count_if(citable), 1.0).alias("citation_recall"),
        ratio(F.count_if(guarded & (F.size("wrongly_cited") > 0)), F.count_if(guarded)).alias("false_citation_rate"),
        ratio(F.count_if(~F.col("grounded")), F.count("*")).alias("fabrication_rate"),
        ratio(F.sum("flagged_bad"), F.sum("truly_bad"), 1.0).alias("detection_integrity"),
        F.coalesce(F.sum("truly_bad"), F.lit(0)).alias("fabricated_quotes"),
    )


def citation_problems(rows: DataFrame) -> DataFrame:
    """Each missing or forbidden citation of a case, with how many of its samples show it."""
    problem = F.concat(
        F.transform("missing", lambda c: F.concat(F.lit("missing "), c)),
        F.transform("wrongly_cited", lambda c: F.concat(F.lit("cited forbidden "), c)),
    )
    counted = (
        rows.select("case_id", F.explode(problem).alias("problem"))
        .groupBy("case_id", "problem").agg(F.count("*").alias("times"))
    )
    samples = rows.groupBy("case_id").agg(F.count("*").alias("samples"))
    return counted.join(samples, "case_id").withColumn(
        "seen", F.format_string("%d in %d", "times", "samples")
    )


# --- E5-E9, E11: repeated runs -----------------------------------------------------
# history(run, case_id, got, fresh); run grows with time and is unique per case.


def majority(samples: DataFrame) -> DataFrame:
    """E5: the verdict more than half of a case's samples gave, else none.

    samples(case_id, got, expected). No order among ties matters, because a
    tie never passes half.
    """
    counts = samples.groupBy("case_id", "got").agg(
        F.count("*").alias("n"), F.max("expected").alias("expected")
    )
    top = counts.groupBy("case_id").agg(
        F.sum("n").alias("samples"), F.max("n").alias("agreed"),
        F.max_by("got", F.struct("n", "got")).alias("_top"), F.max("expected").alias("expected"),
    )
    return (
        top.withColumn("majority", F.when(2 * F.col("agreed") > F.col("samples"), F.col("_top")))
        .withColumn("ok", F.col("majority").eqNullSafe(F.col("expected")))
        .withColumn("unanimous", F.col("agreed") == F.col("samples"))
        .drop("_top")
    )


def unstable_cases(history: DataFrame) -> DataFrame:
    """Cases with more than one verdict among fresh samples."""
    fresh = history.filter("fresh").groupBy("case_id", "got").agg(F.count("*").alias("n"))
    return fresh.groupBy("case_id").agg(
        F.array_sort(F.collect_list("got")).alias("verdicts"), F.sum("n").alias("fresh_samples")
    ).filter(F.size("verdicts") > 1)


def latest(history: DataFrame) -> DataFrame:
    return history.groupBy("case_id").agg(F.max_by("got", "run").alias("got"))


def watch_list(history: DataFrame, expected: DataFrame) -> DataFrame:
    """Known cases whose latest verdict is wrong, or that are unstable."""
    unstable = unstable_cases(history).select("case_id", F.lit(True).alias("unstable"))
    return (
        expected.join(latest(history), "case_id", "left")
        .join(unstable, "case_id", "left")
        .withColumn("failing", F.coalesce(F.col("got") != F.col("expected"), F.lit(False)))
        .withColumn("unstable", F.coalesce("unstable", F.lit(False)))
        .filter(F.col("failing") | F.col("unstable"))
        .select("case_id", "failing", "unstable")
    )


def compare_runs(history: DataFrame, expected: DataFrame, block: Column) -> DataFrame:
    """Every row against the latest earlier run holding its case.

    `block` never falls as run grows; it keeps a case with very many runs in
    many tasks.
    """
    before = scale.previous(history, ["case_id"], "run", ["got"], block)
    rows = scale.salted_join(before, expected, ["case_id"], spread="run")
    right, was_right = F.col("got") == F.col("expected"), F.col("previous_got") == F.col("expected")
    outcome = (
        F.when(~F.col("has_previous"), "no baseline")
        .when(~F.col("fresh"), "replayed")
        .when(right & ~was_right, "fixed")
        .when(was_right & ~right, "broken")
        .when(right, "still right")
        .otherwise("still wrong")
    )
    return rows.withColumn("outcome", outcome).withColumn(
        "drifted",
        (F.col("outcome") == "replayed") & (F.col("previous_got") != F.col("got")),
    )


def stability_report(history: DataFrame) -> DataFrame:
    """Cases with two fresh samples or more, how many of them wobble."""
    per_verdict = history.filter("fresh").groupBy("case_id", "got").agg(F.count("*").alias("n"))
    per_case = per_verdict.groupBy("case_id").agg(
        F.sum("n").alias("fresh_samples"), F.count("*").alias("verdicts")
    )
    return per_case.agg(
        F.count_if(F.col("fresh_samples") >= 2).alias("measured"),
        F.count_if(F.col("verdicts") > 1).alias("unstable"),
        F.coalesce(F.sum(F.when(F.col("verdicts") > 1, F.col("fresh_samples"))), F.lit(0)).alias("unstable_samples"),
    )


def accuracy_range(history: DataFrame, expected: DataFrame, run: str) -> DataFrame:
    """Lowest and highest accuracy over full runs; those marked `subset` do not count."""
    if "subset" in history.columns:
        history = history.filter(~F.coalesce("subset", F.lit(False)))
    rows = scale.salted_join(history, expected, ["case_id"], spread="run")
    per_run = rows.groupBy(run).agg(
        F.avg((F.col("got") == F.col("expected")).cast("int")).alias("accuracy")
    )
    return per_run.agg(
        F.count("*").alias("runs"), F.min("accuracy").alias("lowest"), F.max("accuracy").alias("highest")
    )


def keep_latest_runs(history: DataFrame, run: str, keep: int = fixed.HISTORY_KEPT) -> DataFrame:
    """The rows of the last `keep` runs. Only `keep` run ids are ever looked up."""
    runs = history.select(run).distinct().orderBy(F.desc(run)).limit(keep)
    return history.join(F.broadcast(runs), run, "left_semi")


# --- E12-E14: reproducibility and text form ------------------------------------------


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first differing character; the shorter length where one is a prefix."""
    n = F.least(F.length(a), F.length(b))
    differs = F.array_position(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), F.lit(True)
    )
    return F.when(b.isNull() | (a == b), F.lit(None)).when(differs > 0, F.least(differs - 1, n)).otherwise(n).cast("int")


def reproducibility(outputs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct outputs per group, and where the two least of them part.

    Outputs are counted by digest. The least text of a group, and the least above
    it, come from aggregates that keep one text per group and task.
    """
    counts = outputs.groupBy(*keys, F.sha2(text, 256).alias("_d")).agg(F.count("*").alias("_n"))
    stats = counts.groupBy(*keys).agg(F.sum("_n").alias("outputs"), F.count("*").alias("distinct_outputs"))
    least = outputs.groupBy(*keys).agg(F.min(text).alias("_a"))
    second = (
        outputs.select(*keys, text).join(least, keys).filter(F.col(text) > F.col("_a"))
        .groupBy(*keys).agg(F.min(text).alias("_b"))
    )
    return (
        stats.join(least, keys).join(second, keys, "left")
        .withColumn("first_difference", first_difference(F.col("_a"), F.col("_b")))
        .drop("_a", "_b")
    )


# --- fixed values: the text forms compared, and the patterns they are compared by
FORMS = ["one_line", "hyphens_joined", "plain_characters", "curly_apostrophes", "all_capitals", "double_spaces"]
NAMED_PATTERNS = {
    "crossref": fixed.RE_CROSSREF, "per_day": fixed.RE_PER_DAY, "before_stay": fixed.RE_BEFORE_STAY,
    "after_stay": fixed.RE_AFTER_STAY, "policy_start": fixed.RE_POLICY_START, "duration": fixed.RE_DURATION,
    "stated_window": fixed.RE_STATED_WINDOW, "means": fixed.RE_MEANS, "waits": fixed.RE_WAITS,
    "annexure": fixed.RE_ANNEXURE, "quantity": fixed.RE_QUANTITY, "word": fixed.RE_WORD,
    "clause_abroad": fixed.RE_CLAUSE_ABROAD, "clause_intoxication": fixed.RE_CLAUSE_INTOXICATION,
    "start_words": fixed.RE_START_WORDS, "not_held": fixed.RE_NOT_HELD,
}


def text_form(c: Column, form: str) -> Column:
    return {
        "one_line": F.trim(F.regexp_replace(c, r"\s+", " ")),
        "hyphens_joined": F.regexp_replace(c, r"([A-Za-z0-9_])-\s*\n\s*([A-Za-z0-9_])", "$1$2"),
        "plain_characters": tx.expand_ligatures(F.translate(c, tx.TRANSLATE_FROM, tx.TRANSLATE_TO)),
        "curly_apostrophes": F.replace(c, F.lit("'"), F.lit("’")),
        "all_capitals": F.upper(c),
        "double_spaces": F.replace(c, F.lit(" "), F.lit("  ")),
    }[form]


def _changed_counts(patterns: list[str]):
    """array<int> of a text and its forms: form by form 1 for each pattern whose count the form changes, null for a null text.

    A null form is the text itself. The patterns are counted by Arrow, whose automaton reads a text
    at once where a backtracking search tries every alternative at every character.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def flags(text: pa.Array, *forms: pa.Array) -> pa.Array:
        count = lambda rows: [pc.count_substring_regex(rows, p).to_numpy(zero_copy_only=False) for p in patterns]
        known = text.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(text), len(forms), len(patterns)), dtype=np.int32)
        before = np.stack(count(text), axis=1) if patterns else np.zeros((len(text), 0))
        for i, form in enumerate(forms):
            at = np.flatnonzero(form.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                after = count(form.drop_null())
                for j, found in enumerate(after):
                    out[at, i, j] = found != before[at, j]
        rows = out.reshape(len(text), -1)
        ends = np.concatenate([[0], np.cumsum(known * rows.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[known].ravel()), mask=pa.array(~known))

    return flags


def format_invariance(texts: DataFrame, text: str = "text", forms=FORMS, patterns=None) -> DataFrame:
    """Per form and pattern, the texts whose match count changes with the form.

    Forms and patterns are a short fixed list, so they are columns of
    each row rather than a join. Patterns may not look around: RE2 counts them.
    """
    patterns = NAMED_PATTERNS if patterns is None else patterns
    bounded_batches(texts.sparkSession)
    df = texts.select(F.col(text).alias("_t"))
    # A form that leaves the text as it is does not go to the count.
    changed = [F.nullif(text_form(F.col("_t"), form), F.col("_t")) for form in forms]
    df = df.select(_changed_counts(list(patterns.values()))("_t", *changed).alias("_d"))
    cells = [
        F.sum(F.get("_d", F.lit(i * len(patterns) + j)).cast("bigint")).alias(f"{form}|{name}")
        for i, form in enumerate(forms) for j, name in enumerate(patterns)
    ]
    wide = df.agg(F.count("*").alias("texts"), *cells)
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("form"), F.lit(n).alias("pattern"), F.col(f"`{f}|{n}`").alias("differs"))
                for f in forms for n in patterns
            ]
        )
    )
    return wide.select("texts", pairs.alias("p")).select("p.form", "p.pattern", "p.differs", "texts")


def typography(texts: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Typographic features per corpus."""
    return texts.groupBy(group).agg(
        *[
            F.sum(F.regexp_count(text, F.lit(p)).cast("bigint")).alias(name)
            for name, p in fixed.TYPOGRAPHY.items()
        ]
    )


# --- E15-E17 -------------------------------------------------------------------------


def extraction_accuracy(facts: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Expected (key, group, field, value as text or null) against the facts, per group.

    A case is right when every field given for it is right.
    """
    long = facts.select(
        key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("got")) for f in fields])).alias("s")
    ).select(key, "s.field", "s.got")
    per_case = (
        expected.join(long, [key, "field"], "left")
        .groupBy("group", key)
        .agg(F.count_if(~F.col("value").eqNullSafe(F.col("got"))).alias("wrong"))
    )
    return per_case.groupBy("group").agg(
        F.count_if(F.col("wrong") == 0).alias("right"), F.count("*").alias("total"),
        F.sum("wrong").alias("wrong_fields"),
    )


def prompt_fit(shortlisted: DataFrame, budget: int) -> DataFrame:
    """How full requests are: characters, tokens against budget, clauses kept of all."""
    return shortlisted.agg(
        F.count("*").alias("requests"),
        F.sum(F.size("kept")).alias("clauses_kept"),
        F.sum("clauses").alias("clauses_in_all"),
        F.max("kept_chars").alias("most_chars"),
        F.max("kept_tokens").alias("most_tokens"),
        F.count_if(F.col("all_tokens") > budget).alias("over_budget"),
        F.count_if(F.size("kept") == F.col("clauses")).alias("whole"),
    )


def metric_rows(row: DataFrame, scope: str, kinds: dict[str, str]) -> DataFrame:
    """One wide row of metrics as (scope, metric, value, kind)."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(k).alias("kind"))
                for m, k in kinds.items()
            ]
        )
    )
    return row.select(F.lit(scope).alias("scope"), cells.alias("c")).select("scope", "c.metric", "c.value", "c.kind")


def report(*tables: DataFrame) -> DataFrame:
    """All metric rows, with the gate: a guarantee below 1 fails."""
    rows = reduce(DataFrame.unionByName, tables)
    return rows.withColumn(
        "passes", F.when(F.col("kind") == "guarantee", F.col("value") >= 1.0).otherwise(F.lit(True))
    )
