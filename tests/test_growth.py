"""What must not grow with the tables: broadcast sides, rows of a task."""

import __spark_entry__
import pytest

SF = "/root/testdata/sf0.001"
# Queries over the clauses of policies: a part is a few bytes, its clauses are not.
OVER_CLAUSES = [
    "e2_ranking_expectations", "e3_answer_rows", "e4_run_metrics", "e10_citation_problems", "e16_prompt_fit",
    "f5_waiting_status", "f6_cover_windows", "f7_copayments", "f8_daily_caps", "f9_reductions", "f10_shortlist",
    "f12_rare_terms", "f12_shared_words", "f13_named_in_question", "f14_naming_exclusions", "f15_trigger_pairs",
    "q1_quote_audit", "q2_elided_quotes", "q3_verified_prefixes", "s9_answer_rows", "t14_analysis_profile",
]


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", OVER_CLAUSES)
def test_clauses_of_policies_are_never_broadcast(spark, capsys, name):
    text = plan(__spark_entry__.queries()[name](spark, SF), capsys)
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text


def test_clauses_are_not_broadcast_for_the_report(spark, capsys):
    text = plan(__spark_entry__.queries()["e17_report"](spark, SF), capsys)
    assert text.count("SortMergeJoin") >= 5 and "Scan parquet" in text and "BroadcastHashJoin" not in text.split("labels")[0]


def test_tasks_over_documents_grow_with_the_text(spark):
    from pyspark.sql import functions as F

    from clausewright.plans import views

    def tasks(chars):
        docs = spark.range(60).select(
            F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("some text").alias("text"),
            F.lit(chars).cast("bigint").alias("n_chars"))
        out = views.by_document(docs)
        assert out.columns == ["doc_id", "source", "text"] and out.count() == 60
        return out.rdd.getNumPartitions()

    assert tasks(4_000_000) == 60 and tasks(8_000_000) == 120
    assert tasks(10) <= spark.sparkContext.defaultParallelism


def test_a_form_costs_one_count_in_arrow_and_no_backtracking(spark):
    """Every text against plain Python, with null, empty and unchanged ones; no pattern is left to the JVM."""
    import re

    from clausewright.operators import evalkit

    texts = [
        None, "", "plain words", "don't", "pre-\nexisting, per  day  10 % of Rs. 5", "30 days be-\nfore – admission ﬁne means",
        "WAITING\n\nperiod of 2 years", "é means ß", "a\n\n\nb 5  months",
    ]
    patterns = {k: evalkit.NAMED_PATTERNS[k] for k in ("word", "per_day", "duration", "policy_start", "quantity", "not_held")}
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    out = evalkit.format_invariance(docs, patterns=patterns)
    counted = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in counted and "regexp_extract_all" not in counted
    count = lambda t, p: len(re.findall(p.replace("(?i)", "(?ia)"), t))
    forms = docs.select("text", *[evalkit.text_form(docs["text"], f).alias(f) for f in evalkit.FORMS]).where("text is not null").collect()
    want = {(f, n, sum(count(r[f], p) != count(r["text"], p) for r in forms), len(texts)) for f in evalkit.FORMS for n, p in patterns.items()}
    assert {tuple(r) for r in out.select("form", "pattern", "differs", "texts").collect()} == want


def test_analysis_rows_parse_the_documents_once(spark, monkeypatch):
    import __spark_entry__ as entry
    from clausewright.plans import views

    calls = []
    parse = views.clauses
    monkeypatch.setattr(views, "clauses", lambda *a: calls.append(a) or parse(*a))
    assert entry.queries()["s5_analysis_rows"](spark, SF).count() > 0
    assert len(calls) == 1


def test_a_kept_opening_is_not_picked_by_a_filter(spark):
    """Q3: a filter on the outcome would move below the audit and hold its steps once more for each use of them."""
    text = __spark_entry__.queries()["q3_verified_prefixes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in text.split("Join LeftOuter")[0]


# Clauses written once for several reads: as files they are smaller still.
OVER_WRITTEN_CLAUSES = ["q5_contradictions", "q5_rule_counts", "q6_unraised_reductions", "q7_weak_answers"]


@pytest.mark.parametrize("name", OVER_WRITTEN_CLAUSES)
def test_written_clauses_are_never_broadcast(spark, capsys, name):
    text = plan(__spark_entry__.queries()[name](spark, SF), capsys)
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text


def test_no_span_brings_the_text_of_its_document(spark, capsys):
    from clausewright.operators import layout
    from clausewright.sources import lines as ln

    text = plan(__spark_entry__.queries()["c5_offset_audit"](spark, SF), capsys)
    # Lines and clauses meet as one row for each document, and no exchange moves their texts after the first.
    assert "Union" not in text and text.count("Exchange hashpartitioning") <= 2 and "substring(raw_text" not in text
    docs = spark.createDataFrame([(1, "é one\n\ntwo"), (2, "three"), (3, "")], "doc_id bigint, text string")
    lines = ln.line_table(docs)
    spans = spark.createDataFrame(
        [(1, 0, 5, "é one"), (1, 1, 5, "é one"), (1, 6, 99, "two"), (1, 0, 9, "é one\ntwo"), (2, -1, 5, "three")],
        "doc_id bigint, char_start bigint, char_end bigint, text string")
    assert sorted(map(tuple, layout.offset_audit(lines, spans).collect())) == [(1, 6, 1), (2, 2, 1)]


@pytest.mark.parametrize("name", ["b11_structure_profile", "f16_dangling_annexures"])
def test_documents_are_exchanged_once_and_parsed_once(spark, capsys, name):
    text = plan(__spark_entry__.queries()[name](spark, SF), capsys)
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_clauses_and_their_analyses_parse_the_documents_once(spark, monkeypatch):
    from clausewright.plans import views

    calls = []
    parse = views.clauses
    monkeypatch.setattr(views, "clauses", lambda *a: calls.append(a) or parse(*a))
    out = __spark_entry__.queries()["s6_clauses_with_analyses"](spark, SF)
    assert len(calls) == 1 and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e3_answer_rows", "e17_report"])
def test_claims_of_large_numbers_are_judged(spark, folder, name):
    """A claim's number holds in 64 bits where three times it does not."""
    import os

    from pyspark.sql import functions as F

    for table, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        rows = spark.read.parquet(f"{SF}/{table}.parquet").where(f"{key} < 40")
        rows.withColumn(key, F.col(key) + 54_000_000).write.parquet(f"{folder}/{table}.parquet")
    for table in ("part", "documents", "labels"):
        os.symlink(f"{SF}/{table}.parquet", f"{folder}/{table}.parquet")
    rows = __spark_entry__.queries()[name](spark, folder).collect()
    if name == "e17_report":
        assert len(rows) == 7
        return
    policy = lambda i: i // 10**6 % 10**5
    claims = [r["answer_id"] for r in rows]
    assert claims and min(claims) * 3 > 2**63
    assert all(r["verdict_ok"] == ((i + policy(i)) % 4 == (i * 3 + policy(i)) % 4) for i, r in zip(claims, rows))
