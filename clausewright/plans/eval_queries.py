"""Queries over labels, answers and run history: evaluation and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.operators import dossier, evalkit, quotes, shortlist
from clausewright.plans import oracle as o
from clausewright.plans import views
from clausewright.plans.claim_queries import SMALL_BUDGET, prepared
from clausewright.plans.registry import query
from clausewright.streaming import status

PREDICTED = (
    "case when doc_id % 17 = 3 then null when n_chars > 2500 then 'long' when n_chars % 3 = 0 then 'clean' "
    "when lang = 'en' then 'clean' else 'poor' end"
)
EXPECTED = "case when toxic = 1 then 'toxic' when quality = 1 then 'clean' else 'poor' end"
FLAG = "case when (claim_id + pos) % 29 = 0 then not verified else verified end"
EXPECTED_EVENT = "case cast(user_id % 3 as int) when 0 then 'click' when 1 then 'view' else 'purchase' end"
o.CTES |= {
    "v_confusion": f"""
      select {EXPECTED} as expected, predicted, count(*) as n
      from labels left join (select doc_id, {PREDICTED} as predicted from documents) using (doc_id) group by all""",
    "v_classes": """
      select class, cast(coalesce((select sum(n) from v_confusion where expected = class), 0) as bigint) as support,
        cast(coalesce((select sum(n) from v_confusion where expected = class and predicted = class), 0) as bigint) as tp,
        cast(coalesce((select sum(n) from v_confusion where predicted = class and expected <> class), 0) as bigint) as fp
      from (select expected as class from v_confusion union select predicted from v_confusion where predicted is not null)""",
    "v_metrics": """
      select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from (
        select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
          case when support > 0 then tp / support else 0 end as recall from v_classes)""",
    "v_judged": f"""
      select a.answer_id, a.case_id, a.verdict, a.expected, a.required, a.forbidden,
        a.verdict = a.expected as verdict_ok, list_sort(list_distinct(list_filter(coalesce(list(c.clause_id) filter (c.pos is not null), []), lambda x: true))) as cited,
        list_sort(list_filter(a.required, lambda x: not list_contains(coalesce(list(c.clause_id) filter (c.pos is not null), []), x))) as missing,
        list_sort(list_filter(a.forbidden, lambda x: list_contains(coalesce(list(c.clause_id) filter (c.effect in {o.q_list(fixed.ADVERSE)}), []), x))) as wrongly_cited,
        coalesce(bool_and(c.flag), true) as grounded, count(*) filter (not c.verified) as truly_bad,
        count(*) filter (not c.verified and not c.flag) as flagged_bad
      from v_samples a left join (select *, {FLAG} as flag from v_audit) c using (answer_id)
      group by a.answer_id, a.case_id, a.verdict, a.expected, a.required, a.forbidden""",
    "v_history": """
      select user_id as case_id, event_id as run, cast(ts as date) as day, event_type as got, event_id % 3 <> 0 as fresh,
        day(ts) % 4 = 0 as subset from events""",
    "v_expected": f"select distinct user_id as case_id, {EXPECTED_EVENT} as expected from events",
}


# What each answer should and must not cite; the answers of one order are samples of a case.
REQUIRED = {0: ["2.1"], 1: ["3.1", "3.2"], 2: [], 3: ["4.2"]}
FORBIDDEN = {0: ["3.1"], 1: [], 2: ["2.2", "2.3"]}


def _arrays(selector: str, table: dict, open_: str, close: str, empty: str) -> str:
    return f"case cast({selector} as int) " + " ".join(
        f"when {k} then " + (f"{open_}{', '.join(o.q(x) for x in v)}{close}" if v else empty) for k, v in table.items()
    ) + f" else {empty} end"


CASE_ID = "cast(floor(claim_id / 100000000000) as bigint)"
o.CTES["v_samples"] = (
    f"select answer_id, {CASE_ID} as case_id, verdict, expected, "
    f"{_arrays('claim_id % 4', REQUIRED, '[', ']', '[]')} as required, "
    f"{_arrays('policy_id % 3', FORBIDDEN, '[', ']', '[]')} as forbidden from v_answers"
)


def samples(spark, sf):
    none = "cast(array() as array<string>)"
    return views.answers(spark, sf).selectExpr(
        "answer_id", f"{CASE_ID} as case_id", "verdict", "expected",
        f"{_arrays('claim_id % 4', REQUIRED, 'array(', ')', none)} as required",
        f"{_arrays('policy_id % 3', FORBIDDEN, 'array(', ')', none)} as forbidden")


def judged(spark, sf):
    audited = quotes.audit_quotes(views.citations(spark, sf), views.policies(spark, sf))
    return evalkit.answer_rows(samples(spark, sf), audited.withColumn("flag", F.expr(FLAG)))


def history(spark, sf):
    return views.table(spark, sf, "events").selectExpr(
        "user_id as case_id", "event_id as run", "cast(ts as date) as day", "event_type as got",
        "event_id % 3 <> 0 as fresh", "day(ts) % 4 = 0 as subset")


def expected_cases(spark, sf):
    return views.table(spark, sf, "events").selectExpr("user_id as case_id", f"{EXPECTED_EVENT} as expected").distinct()


def confusion(spark, sf):
    labels = views.table(spark, sf, "labels").selectExpr("doc_id", f"{EXPECTED} as expected")
    predictions = views.table(spark, sf, "documents").selectExpr("doc_id", f"{PREDICTED} as predicted")
    return evalkit.confusion(labels, predictions, "doc_id")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("e1_confusion", "select expected, predicted, n from v_confusion")
def e1(spark, sf):
    return confusion(spark, sf)


@query("e1_class_metrics", """
  select class, support, tp, fp, round(precision, 6)::double as precision, round(recall, 6)::double as recall, round(f1, 6)::double as f1 from v_metrics""")
def e1m(spark, sf):
    return evalkit.class_metrics(confusion(spark, sf)).select(
        "class", "support", "tp", "fp", *r6("precision", "recall", "f1"))


@query("e1_overall", """
  select round(avg(f1) filter (support > 0 or fp > 0), 6) as macro_f1, round(sum(tp) / sum(support), 6) as accuracy,
    cast(sum(support) as bigint) as labelled from v_metrics""")
def e1o(spark, sf):
    return evalkit.overall_metrics(evalkit.class_metrics(confusion(spark, sf))).select(
        *r6("macro_f1", "accuracy"), "labelled")


TOP_N = 4


@query("e2_ranking_expectations", f"""
  with ranks as (
    select policy_id, number, max(rank) as rank from (
      select policy_id, number, cast(row_number() over (partition by policy_id order by impact desc, order_idx) as int) as rank from v_policies)
    where number <> '' group by all),
  wanted as (
    select p_partkey as policy_id, unnest(['4.2', '3.2', '1.1', '7.7']) as number, unnest([true, true, false, p_partkey % 2 = 0]) as must from part)
  select w.policy_id, w.number, w.must, r.rank,
    case when w.must then coalesce(r.rank <= {TOP_N}, false) else not coalesce(r.rank <= {TOP_N}, false) end as holds
  from wanted w left join ranks r using (policy_id, number)""")
def e2(spark, sf):
    wanted = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("policy_id"),
        F.expr("explode(array(struct('4.2' as number, true as must), struct('3.2' as number, true as must), struct('1.1' as number, false as must), "
               "struct('7.7' as number, p_partkey % 2 = 0 as must)))").alias("w")).select("policy_id", "w.number", "w.must")
    return evalkit.ranking_expectations(views.policies(spark, sf), wanted, TOP_N)


@query("e3_answer_rows", """
  select answer_id, case_id, verdict_ok, len(missing) = 0 as citation_ok, grounded, array_to_string(cited, ',') as cited,
    array_to_string(wrongly_cited, ',') as wrongly_cited, truly_bad, flagged_bad from v_judged""")
def e3(spark, sf):
    return judged(spark, sf).select(
        "answer_id", "case_id", "verdict_ok", "citation_ok", "grounded", F.array_join("cited", ",").alias("cited"),
        F.array_join("wrongly_cited", ",").alias("wrongly_cited"), "truly_bad", "flagged_bad")


_RATES = """
    select count(*) as total, round(count(*) filter (verdict_ok) / count(*), 6) as verdict_accuracy,
      round(coalesce(count(*) filter (len(required) > 0 and len(missing) = 0) / nullif(count(*) filter (len(required) > 0), 0), 1), 6) as citation_recall,
      round(coalesce(count(*) filter (len(forbidden) > 0 and len(wrongly_cited) > 0) / nullif(count(*) filter (len(forbidden) > 0), 0), 0), 6) as false_citation_rate,
      round(count(*) filter (not grounded) / count(*), 6) as fabrication_rate,
      round(coalesce(sum(flagged_bad) / nullif(sum(truly_bad), 0), 1), 6) as detection_integrity,
      cast(sum(truly_bad) as bigint) as fabricated_quotes from v_judged"""
RATES = ["verdict_accuracy", "citation_recall", "false_citation_rate", "fabrication_rate", "detection_integrity"]


@query("e4_run_metrics", _RATES)
def e4(spark, sf):
    return evalkit.run_metrics(judged(spark, sf)).select("total", *r6(*RATES), "fabricated_quotes")


@query("e5_majority", """
  with counts as (select case_id, got, count(*) as n from v_history group by all),
  tops as (select case_id, cast(sum(n) as bigint) as samples, max(n) as agreed, arg_max(got, n) as top from counts group by case_id)
  select case_id, samples, agreed, expected, case when 2 * agreed > samples then top end as majority,
    coalesce(case when 2 * agreed > samples then top end = expected, false) as ok, agreed = samples as unanimous
  from tops join v_expected using (case_id)""")
def e5(spark, sf):
    rows = history(spark, sf).withColumn("expected", F.expr(EXPECTED_EVENT.replace("user_id", "case_id")))
    return evalkit.majority(rows)


@query("e6_unstable", """
  select case_id, array_to_string(list_sort(list(distinct got)), ',') as verdicts, count(*) as fresh_samples
  from v_history where fresh group by case_id having count(distinct got) > 1""")
def e6(spark, sf):
    return evalkit.unstable_cases(history(spark, sf)).withColumn("verdicts", F.array_join("verdicts", ","))


@query("e7_watch_list", """
  select * from (
    select e.case_id, coalesce(l.got <> e.expected, false) as failing, coalesce(u.n > 1, false) as unstable
    from v_expected e left join (select case_id, arg_max(got, run) as got from v_history group by case_id) l using (case_id)
    left join (select case_id, count(distinct got) as n from v_history where fresh group by case_id) u using (case_id))
  where failing or unstable""")
def e7(spark, sf):
    return evalkit.watch_list(history(spark, sf), expected_cases(spark, sf))


@query("e8_run_comparison", """
  select case_id, run, outcome, outcome = 'replayed' and previous_got <> got as drifted from (
    select *, case when previous_got is null then 'no baseline' when not fresh then 'replayed'
      when got = expected and previous_got <> expected then 'fixed' when got <> expected and previous_got = expected then 'broken'
      when got = expected then 'still right' else 'still wrong' end as outcome
    from (select h.*, e.expected, lag(got) over (partition by h.case_id order by run) as previous_got
      from v_history h join v_expected e using (case_id)))""")
def e8(spark, sf):
    return evalkit.compare_runs(
        history(spark, sf), expected_cases(spark, sf), F.floor(F.col("run") / 4096)
    ).select("case_id", "run", "outcome", F.coalesce("drifted", F.lit(False)).alias("drifted"))


@query("e9_stability", """
  select count(*) filter (n >= 2) as measured, count(*) filter (v > 1) as unstable,
    cast(coalesce(sum(n) filter (v > 1), 0) as bigint) as unstable_samples
  from (select case_id, count(*) as n, count(distinct got) as v from v_history where fresh group by case_id)""")
def e9(spark, sf):
    return evalkit.stability_report(history(spark, sf))


@query("e9_accuracy_range", """
  select count(*) as runs, round(min(a), 6) as lowest, round(max(a), 6) as highest from (
    select day, avg(cast(got = expected as int)) as a from v_history join v_expected using (case_id) where not subset group by day)""")
def e9r(spark, sf):
    return evalkit.accuracy_range(history(spark, sf), expected_cases(spark, sf), "day").select(
        "runs", *r6("lowest", "highest"))


@query("e10_citation_problems", """
  select case_id, problem, count(*) as times, any_value(samples) as samples, concat(count(*), ' in ', any_value(samples)) as seen from (
    select case_id, unnest(list_concat(list_transform(missing, lambda c: concat('missing ', c)),
      list_transform(wrongly_cited, lambda c: concat('cited forbidden ', c)))) as problem from v_judged)
  join (select case_id, count(*) as samples from v_judged group by case_id) using (case_id) group by case_id, problem""")
def e10(spark, sf):
    return evalkit.citation_problems(judged(spark, sf))


@query("e11_history_kept", f"""
  select case_id, run, got from v_history where day in (select distinct day from v_history order by day desc limit {fixed.HISTORY_KEPT})""")
def e11(spark, sf):
    return evalkit.keep_latest_runs(history(spark, sf), "day").select("case_id", "run", "got")


@query("e12_reproducibility", """
  with one as (select lang, source, sha256(text) as d, count(*) as n, min(text) as text from documents group by all),
  ranked as (select *, row_number() over (partition by lang, source order by text) as r, sum(n) over (partition by lang, source) as total,
    count(*) over (partition by lang, source) as kinds from one),
  ab as (select lang, source, cast(any_value(total) as bigint) as outputs, any_value(kinds) as distinct_outputs,
    max(text) filter (r = 1) as a, max(text) filter (r = 2) as b from ranked group by lang, source)
  select lang, source, outputs, distinct_outputs, cast(case when b is null then null
    else coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i]), true) - 1,
      least(length(a), length(b))) end as int) as first_difference from ab""")
def e12(spark, sf):
    return evalkit.reproducibility(views.table(spark, sf, "documents"), ["lang", "source"], "text")


def _form_sql(form: str) -> str:
    plain = f"translate(text, {o.q(tx.TRANSLATE_FROM)}, {o.q(tx.TRANSLATE_TO)})"
    return {
        "one_line": r"trim(regexp_replace(text, '\s+', ' ', 'g'))",
        "hyphens_joined": "regexp_replace(text, '([A-Za-z0-9_])-\\s*\\n\\s*([A-Za-z0-9_])', '\\1\\2', 'g')",
        "plain_characters": o.ligatures(plain),
        "curly_apostrophes": "replace(text, chr(39), '’')",
        "all_capitals": "upper(replace(text, 'ß', 'ss'))",  # capitals of that letter are two
        "double_spaces": "replace(text, ' ', '  ')",
    }[form]


@query("e13_format_invariance", " union all ".join(
    f"select {o.q(f)} as form, {o.q(n)} as pattern, cast(count(*) filter ({o.count('text', p)} <> {o.count('form_text', p)}) as bigint) as differs, "
    f"count(*) as texts from (select text, {_form_sql(f)} as form_text from v_documents)"
    for f in evalkit.FORMS for n, p in evalkit.NAMED_PATTERNS.items()))
def e13(spark, sf):
    return evalkit.format_invariance(views.policy_documents(spark, sf))


@query("e14_typography", "select source, " + ", ".join(
    f"cast(sum({o.count('text', p)}) as bigint) as {n}" for n, p in fixed.TYPOGRAPHY.items()) + " from v_documents group by source")
def e14(spark, sf):
    return evalkit.typography(views.policy_documents(spark, sf), "source")


FIELDS = ["age", "pre_existing_condition", "held_days", "sum_insured_rupees"]


@query("e15_extraction_accuracy", """
  with expected as (
    select claim_id, concat('g', policy_id % 3) as grp, unnest(['age', 'pre_existing_condition', 'held_days']) as field,
      unnest([cast(20 + claim_id % 60 as varchar), case when claim_id % 2 = 0 then 'yes' else 'unknown' end, cast(null as varchar)]) as value
    from v_claims),
  facts as (
    select claim_id, unnest(['age', 'pre_existing_condition', 'held_days']) as field,
      unnest([cast(age as varchar), pre_existing_condition, cast(held_days as varchar)]) as got from v_prepared)
  select grp as "group", count(*) filter (wrong = 0) as right, count(*) as total, cast(sum(wrong) as bigint) as wrong_fields from (
    select grp, claim_id, count(*) filter (value is distinct from got) as wrong
    from expected left join facts using (claim_id, field) group by all) group by grp""")
def e15(spark, sf):
    expected = views.claims(spark, sf).select(
        "claim_id", F.expr("concat('g', policy_id % 3)").alias("group"),
        F.expr("explode(array(struct('age' as field, cast(20 + claim_id % 60 as string) as value), "
               "struct('pre_existing_condition' as field, case when claim_id % 2 = 0 then 'yes' else 'unknown' end as value), "
               "struct('held_days' as field, cast(null as string) as value)))").alias("e")).select("claim_id", "group", "e.field", "e.value")
    return evalkit.extraction_accuracy(prepared(spark, sf), expected, "claim_id", FIELDS)


@query("e16_prompt_fit", f"""
  select count(*) as requests, cast(sum(len(kept)) as bigint) as clauses_kept, cast(sum(clauses) as bigint) as clauses_in_all,
    cast(max(chars_in) as bigint) as most_chars, cast(max(used) as bigint) as most_tokens,
    count(*) filter (all_tokens > {SMALL_BUDGET}) as over_budget, count(*) filter (len(kept) = clauses) as whole from v_fitted""")
def e16(spark, sf):
    asked, pol = prepared(spark, sf), views.policies(spark, sf)
    named = dossier.naming(asked, dossier.pack_words(pol))
    return evalkit.prompt_fit(shortlist.shortlist(shortlist.with_room(named), pol, None, SMALL_BUDGET), SMALL_BUDGET)


@query("e17_report", f"""
  with rates as ({_RATES}),
  overall as (select round(avg(f1) filter (support > 0 or fp > 0), 6) as macro_f1, round(sum(tp) / sum(support), 6) as accuracy from v_metrics)
  select scope, metric, value::double as value, kind, case when kind = 'guarantee' then value >= 1 else true end as passes from (
    {" union all ".join(f"select 'answers' as scope, '{m}' as metric, {m} as value, '{'guarantee' if m == 'detection_integrity' else 'quality'}' as kind from rates" for m in RATES)}
    union all select 'labels', 'macro_f1', macro_f1, 'quality' from overall
    union all select 'labels', 'accuracy', accuracy, 'quality' from overall)""")
def e17(spark, sf):
    overall = evalkit.overall_metrics(evalkit.class_metrics(confusion(spark, sf)))
    kinds = {m: "guarantee" if m == "detection_integrity" else "quality" for m in RATES}
    rows = evalkit.report(
        evalkit.metric_rows(evalkit.run_metrics(judged(spark, sf)), "answers", kinds),
        evalkit.metric_rows(overall, "labels", {"macro_f1": "quality", "accuracy": "quality"}))
    return rows.withColumn("value", F.round("value", 6))


STATUS = "case cast(event_id % 7 as int) " + " ".join(
    f"when {i} then '{s}'" for i, s in enumerate(fixed.DOCUMENT_STATES)) + " end"


def status_updates(spark, sf):
    return views.table(spark, sf, "events").selectExpr(
        "user_id as doc_id", "event_id as seq", "ts", f"{STATUS} as status", "round(event_id % 100 / 100D, 3) as progress")


@query("x1_latest_status", f"""
  select user_id as doc_id, arg_max({STATUS}, event_id) as status, round(arg_max(event_id % 100 / 100::double, event_id), 3) as progress,
    max(ts) as ts, count(*) as updates from events group by user_id""")
def x1(spark, sf):
    return status.latest_status(status_updates(spark, sf))

