"""Queries over documents: sources, layout, segmentation, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.operators import layout, score, segment
from clausewright.plans import oracle as o
from clausewright.plans import views
from clausewright.plans.registry import query
from clausewright.sources import lines as ln
from clausewright.sources import shared, stores
from clausewright.streaming import incremental

CLAUSE = "doc_id, order_idx, section_path, number, heading, text, page_start, page_end, char_start, char_end, is_heading"


@query("s1_line_offsets", "select doc_id, line_no, page, text, char_start, char_end from v_offsets")
def s1(spark, sf):
    return ln.line_table(views.policy_documents(spark, sf))


@query("s3_page_starts", "select doc_id, page, cast(min(char_start) as bigint) as page_start from v_offsets group by all")
def s3(spark, sf):
    return ln.page_starts(ln.line_table(views.policy_documents(spark, sf)))


@query("c1_control_scrub", """
  select doc_id, cast(count(*) as bigint) as lines, cast(sum(length(text)) as bigint) as chars from v_split group by doc_id""")
def c1(spark, sf):
    return ln.split_lines(views.policy_documents(spark, sf)).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("c2_normal_form", f"select doc_id, {o.plain('text')} as plain, {o.quotable('text')} as quotable from v_documents")
def c2(spark, sf):
    return views.policy_documents(spark, sf).select(
        "doc_id", tx.plain("text").alias("plain"), tx.quotable("text").alias("quotable"))


@query("c4_body_size", "select doc_id, body_size, weight from v_body")
def c4(spark, sf):
    return layout.body_sizes(views.styled_lines(spark, sf))


@query("c6_letter_spacing", f"select doc_id, line_no, {o.despaced('text')} as repaired from v_lines")
def c6(spark, sf):
    return layout.despaced_lines(views.styled_lines(spark, sf)).select("doc_id", "line_no", "repaired")


@query("c7_lone_markers", "select doc_id, line_no, joined, read_text from v_read")
def c7(spark, sf):
    return layout.as_read(views.styled_lines(spark, sf)).select("doc_id", "line_no", "joined", "read_text")


@query("b1_line_classes", "select doc_id, line_no, is_section, section_title, is_start from v_class")
def b1(spark, sf):
    return segment.classify_lines(views.styled_lines(spark, sf)).select(
        "doc_id", "line_no", "is_section", "section_title", "is_start")


@query("b2_numbering", f"""
  select doc_id, line_no, {o._NUMBER} as number, coalesce({o._STRONG}, false) as strong
  from (select *, false as is_section from v_read) where ({o._NUMBER}) is not null""")
def b2(spark, sf):
    lines = layout.as_read(views.styled_lines(spark, sf)).withColumn("n", segment.numbering("read_text"))
    return lines.filter("n is not null").select("doc_id", "line_no", "n.number", "n.strong")


@query("b3_bold_numbers", """
  select doc_id, bool_or(numbers_bold) as numbers_bold, round(max(share), 6) as bold_share,
    cast(count(numbering) as bigint) as numbered from v_class group by doc_id""")
def b3(spark, sf):
    df = segment.classify_lines(views.styled_lines(spark, sf))
    numbered = (~F.col("is_section")) & F.col("number").isNotNull()
    return df.groupBy("doc_id").agg(
        F.bool_or("numbers_bold").alias("numbers_bold"),
        F.round(F.avg(F.when(numbered, F.col("bold").cast("int"))), 6).alias("bold_share"),
        F.count(F.when(numbered, 1)).alias("numbered"))


@query("b4_sections", "select doc_id, line_no, section_path from v_started")
def b4(spark, sf):
    return segment.clause_starts(views.styled_lines(spark, sf)).select("doc_id", "line_no", "section_path")


@query("b5_outline_sections", "select doc_id, line_no, read_text, is_spent from v_outline where is_outline or is_spent")
def b5(spark, sf):
    return segment.outline_sections(segment.classify_lines(views.styled_lines(spark, sf))).filter(
        "is_outline or is_spent").select("doc_id", "line_no", "read_text", "is_spent")


@query("b6_defined_terms", "select doc_id, line_no, term from v_class where term is not null")
def b6(spark, sf):
    return segment.classify_lines(views.styled_lines(spark, sf)).filter("term is not null").select(
        "doc_id", "line_no", "term")


@query("b7_list_restarts", """
  select c.doc_id, c.line_no, c.number, s.is_start as accepted from v_class c join v_started s using (doc_id, line_no)
  where c.is_start and regexp_matches(c.number, '^\\d+$')""")
def b7(spark, sf):
    lines = views.styled_lines(spark, sf)
    candidates = segment.classify_lines(lines).filter("is_start and number rlike '^[0-9]+$'").select(
        "doc_id", "line_no", "number")
    starts = segment.clause_starts(lines).select("doc_id", "line_no", F.col("is_start").alias("accepted"))
    return candidates.join(starts, ["doc_id", "line_no"])


@query("b8_clause_islands", """
  select doc_id, is_clause, cast(char_start as bigint) as char_start, cast(char_end as bigint) as char_end,
    page_start, page_end, number, heading, section_path, text from v_islands""")
def b8(spark, sf):
    return segment.assemble(segment.clause_starts(views.styled_lines(spark, sf))).drop("joint")


@query("b9_oversize_split", """
  select doc_id, is_clause, cast(char_start as bigint) as char_start, cast(char_end as bigint) as char_end, heading, text
  from v_pieces""")
def b9(spark, sf):
    pieces = segment.split_oversize(segment.assemble(segment.clause_starts(views.styled_lines(spark, sf))))
    return pieces.select("doc_id", "is_clause", "char_start", "char_end", "heading", "text")


@query("b9b_lead_ins", """
  select doc_id, cast(char_start as bigint) as char_start, cast(char_end as bigint) as char_end, number, heading,
    section_path, text from v_merged""")
def b9b(spark, sf):
    pieces = segment.split_oversize(segment.assemble(segment.clause_starts(views.styled_lines(spark, sf))))
    return segment.merge_lead_ins(pieces).select(
        "doc_id", "char_start", "char_end", "number", "heading", "section_path", "text")


@query("b9c_clauses", f"""
  select {CLAUSE.replace('char_start, char_end', 'cast(char_start as bigint) as char_start, cast(char_end as bigint) as char_end')}
  from v_clauses""")
def b9c(spark, sf):
    return views.clauses(spark, sf)



@query("s2_html_lines", f"""
  with texts as (
    select *, regexp_matches(tag, '^h[1-6]$') as heading,
      len(list_filter(regexp_split_to_array(inside, '(?is)</?(?:b|strong)\\b[^>]*>'),
        lambda s: trim(regexp_replace(s, {o.q(ln.RE_TAG)}, '', 'g')) <> '')) as spans
    from v_html_lines)
  select page_id, block_no, tag, text, coalesce({o.case_of('tag', ln.TAG_SIZES)}, {ln.TEXT_SIZE})::double as size,
    heading or {o.matches('inside', ln.RE_BOLD)} as bold,
    case when heading then true when spans <= 1 then {o.matches('inside', ln.RE_BOLD)}
      else {o.matches('inside', ln.RE_BOLD_LATER)} end as words_bold
  from texts""")
def s2(spark, sf):
    return ln.html_lines(views.table(spark, sf, "pages"))


@query("s2_visible_characters", f"""
  select page_id, n as visible, n as in_lines from (
    select page_id, length(regexp_replace({o.unescape(
      "regexp_replace(regexp_replace(html, " + o.q(ln.RE_DROPPED) + ", '', 'g'), " + o.q(ln.RE_TAG) + ", ' ', 'g')")}, '[\\x00-\\x20]+', '', 'g')) as n
    from pages)""")
def s2_visible(spark, sf):
    """Every visible character of a page is in a line: what is left of the page without its tags, and the lines."""
    pages = views.table(spark, sf, "pages")
    blank = r"[\x00-\x20]+"
    seen = ln.unescape(F.regexp_replace(F.regexp_replace("html", ln.RE_DROPPED, ""), ln.RE_TAG, " "))
    visible = pages.select("page_id", F.length(F.regexp_replace(seen, blank, "")).cast("bigint").alias("visible"))
    held = ln.html_lines(pages).groupBy("page_id").agg(F.sum(F.length(F.regexp_replace("text", blank, ""))).alias("in_lines"))
    return visible.join(held, "page_id", "left").select("page_id", "visible", F.coalesce("in_lines", F.lit(0)).alias("in_lines"))


def _clause_store(spark, sf):
    """Two batches on disk: in the second every fifth document has its first clause only, and every seventh none."""
    path = shared.scratch(spark, "clause-store")
    rows = stores.written_once(views.clauses(spark, sf), "clauses")
    docs = views.table(spark, sf, "documents").select("doc_id")
    stores.write_clauses(rows, path, "first", docs.withColumn("revision", F.lit(1)))
    stores.write_clauses(
        rows.where("doc_id % 5 = 0 and doc_id % 7 <> 0 and order_idx = 0"), path, "second",
        docs.where("doc_id % 5 = 0 or doc_id % 7 = 0").withColumn("revision", F.lit(2)))
    return path


@query("s4_store_rows", """
  select doc_id, order_idx, concat(doc_id, ':', order_idx) as clause_key from v_clauses
  where doc_id % 7 <> 0 and (doc_id % 5 <> 0 or order_idx = 0)""")
def s4(spark, sf):
    """The store written in two batches, and a late third one of old revisions, read back."""
    path = _clause_store(spark, sf)
    late = stores.read_store(spark, path).where("doc_id % 3 = 0").select("doc_id", F.lit(99).alias("order_idx"), F.lit("late").alias("text"))
    stores.write_clauses(late, path, "third", late.select("doc_id", F.lit(0).alias("revision")).distinct())
    return stores.read_store(spark, path).select("doc_id", "order_idx", "clause_key")


@query("s4_store_heads", """
  select doc_id, case when doc_id % 5 = 0 or doc_id % 7 = 0 then 2 else 1 end as revision,
    case when doc_id % 7 = 0 then 0 when doc_id % 5 = 0 then least(n, 1) else n end as n_rows
  from (select d.doc_id, count(c.order_idx) as n from documents d left join v_clauses c using (doc_id) group by d.doc_id)""")
def s4_heads(spark, sf):
    """What compaction keeps: a head for every document, deleted ones with no rows."""
    path, target = _clause_store(spark, sf), shared.scratch(spark, "clause-store")
    stores.compact(spark, path, target)
    return stores.read_heads(spark, target).select("doc_id", "revision", "n_rows")


@query("s5_analysis_rows", """
  select doc_id, order_idx, concat(doc_id, ':', order_idx) as clause_key, clause_type, impact, 'model-1' as model, 'v2' as prompt_version
  from v_scored where impact > 10 and doc_id % 7 <> 0 and doc_id % 5 <> 0""")
def s5(spark, sf):
    """Rows with provenance, written and read; what was analysed before a document changed is not seen."""
    path, target = _clause_store(spark, sf), shared.scratch(spark, "analysis-store")
    # The documents are parsed once: the store has their clauses, which are analysed and scored.
    held = spark.read.parquet(f"{path}/rows").where("batch = 'b-first'").drop("batch", "clause_key")
    rows = stores.written_once(views.scored(views.analysed(held)).select("doc_id", "order_idx", "clause_type", "impact"), "scored")
    keys = rows.select("doc_id", "order_idx")
    analysed = rows.filter("clause_type is not null").select("doc_id", "order_idx", "clause_type")
    scores = rows.filter("impact > 10").select("doc_id", "order_idx", "impact")
    rows = stores.analysis_rows(keys, analysed, scores, "model-1", "v2")
    first = spark.read.parquet(f"{path}/heads").where("batch = 'b-first'")
    stores.write_analyses(rows, target, "first", first)
    return stores.read_analyses(spark, target, path).select(
        "doc_id", "order_idx", "clause_key", "clause_type", "impact", "model", "prompt_version")


@query("s8_fingerprints", """
  with f as (select doc_id // 100 as k from documents group by all)
  select concat('f', k) as name, case when k % 11 = 3 then 'extra' when k % 13 = 4 then 'missing' when k % 7 = 0 then 'changed' else 'ok' end as status
  from f where not (k % 11 = 3 and k % 13 = 4)""")
def s8(spark, sf):
    """Files of a hundred texts each, written and read as binary, against a manifest.

    It lacks some files, names some that are not there and gives some another content.
    """
    path = shared.scratch(spark, "files")
    docs = views.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 100).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumn("name", F.concat(F.lit("f"), "k"))
    (rows.where("k % 13 <> 4").repartition("name").sortWithinPartitions("name", "doc_id").select("name", "text")
     .write.partitionBy("name").text(path))
    said = rows.where("k % 11 <> 3").groupBy("name", "k").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    content = F.array_join(F.transform("t", lambda x: F.concat(x["text"], F.lit("\n"))), "")
    manifest = said.select("name", F.sha2(F.when(F.col("k") % 7 == 0, F.concat(content, F.lit("."))).otherwise(content), 256).alias("sha256"))
    files = stores.read_binary(spark, path, "*.txt")
    return stores.fingerprint_audit(files, manifest, F.regexp_extract("path", "name=([^/]+)/", 1)).select("name", "status")


@query("x2_newest_revisions", """
  select doc_id, sha256(case when doc_id % 3 = 0 then substring(text, 1, 40) else text end) as text_sha256 from documents""")
def x2(spark, sf):
    """A batch in which every third document arrives again, corrected and shorter."""
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    batch = docs.withColumn("revision", F.lit(1)).union(
        docs.where("doc_id % 3 = 0").select("doc_id", F.substring("text", 1, 40), F.lit(2)))
    return incremental.newest_revisions(batch).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("x2_streams_to_store", f"""
  select {CLAUSE.replace("is_heading", "concat(doc_id, ':', order_idx) as clause_key")} from v_clauses where doc_id % 7 <> 0""")
def x2_streams(spark, sf):
    """Two streams of arrivals into one store, read back.

    The second brings the right text of every odd document, old revisions of every
    fourth, which come too late, and a blank revision of every seventh.
    """
    base = shared.scratch(spark, "arrivals")
    docs = stores.written_once(views.policy_documents(spark, sf).select("doc_id", "text"), "documents")
    part = F.substring("text", 1, 40)

    def revision(rows, text, number):
        return rows.select("doc_id", text.alias("text"), F.lit(number).cast("bigint").alias("revision"))

    whole = F.col("text")
    first = revision(docs.where("doc_id % 2 = 0"), whole, 5).union(revision(docs.where("doc_id % 2 <> 0"), part, 1))
    second = (
        revision(docs.where("doc_id % 2 <> 0"), whole, 2).union(revision(docs.where("doc_id % 4 = 0"), part, 3))
        .union(revision(docs.where("doc_id % 7 = 0"), F.lit(" "), 9)))
    for name, rows in (("a", first), ("b", second)):
        rows.write.parquet(f"{base}/{name}")
        incremental.stream_clauses(
            spark, f"{base}/{name}", f"{base}/store", f"{base}/checkpoint-{name}", views.styled).awaitTermination()
    return stores.read_store(spark, f"{base}/store").selectExpr(*CLAUSE.replace("is_heading", "clause_key").split(", "))


@query("s6_clauses_with_analyses", """
  select c.doc_id, c.order_idx, c.number, a.clause_type, a.likelihood, a.severity
  from v_clauses c left join (select doc_id, order_idx, clause_type, likelihood, severity from v_analysed
    where clause_type is not null) a using (doc_id, order_idx)""")
def s6(spark, sf):
    # The documents are parsed once. As files the keys are few bytes: the hint keeps them from a broadcast.
    clauses = stores.written_once(views.clauses(spark, sf).select("doc_id", "order_idx", "number"), "clauses")
    analyses = views.analysed(clauses).filter("clause_type is not null").select(
        "doc_id", "order_idx", "clause_type", "likelihood", "severity")
    return stores.clauses_with_analyses(clauses, analyses.hint("merge"))


@query("s7_claim_side_clauses", """
  select doc_id, order_idx, clause_id, clause_type, heading, page_start + 1 as page from v_ids where not is_heading""")
def s7(spark, sf):
    return stores.claim_side_clauses(views.analysed_clauses(spark, sf)).select(
        "doc_id", "order_idx", "clause_id", "clause_type", "heading", "page")


@query("c3_repeated_lines", """
  select doc_id, band, margin_key, n_pages, doc_pages from v_repeated""")
def c3(spark, sf):
    keyed = layout.margin_keys(views.page_lines(spark, sf))
    return layout.repeated_margin_keys(keyed)


@query("c3_lines_kept", """
  select doc_id, page, cast(line_no as bigint) as line_no, text, cast(char_start as bigint) as char_start from (
    select *, coalesce(sum(length(text) + 1) over (partition by doc_id order by page, line_no
      rows between unbounded preceding and 1 preceding), 0) as char_start
    from v_margins m where not exists (
      select 1 from v_repeated r where r.doc_id = m.doc_id and r.band = m.band and r.margin_key = m.margin_key))""")
def c3_kept(spark, sf):
    kept = layout.drop_margin_lines(views.page_lines(spark, sf))
    return ln.paged_offsets(kept).select(
        "doc_id", "page", F.col("line_no").cast("bigint").alias("line_no"), "text", "char_start")


@query("c5_offset_audit", """
  with raw as (select doc_id, string_agg(text, chr(10) order by line_no) as raw_text from v_split group by doc_id)
  select doc_id, cast(count(*) as bigint) as spans,
    cast(count(*) filter (substring(raw_text, char_start + 1, char_end - char_start) <> text) as bigint) as violations
  from (select doc_id, char_start, char_end, text from v_clauses union all
        select doc_id, char_start, char_end, text from v_offsets) join raw using (doc_id)
  group by doc_id""")
def c5(spark, sf):
    lines = views.styled_lines(spark, sf)
    return layout.offset_audit(lines, segment.segment(lines))


@query("b10_citation_ids", "select doc_id, order_idx, number, clause_id from v_ids")
def b10(spark, sf):
    analysed = views.analysed_clauses(spark, sf).filter("clause_type is not null")
    return segment.citation_ids(analysed).select("doc_id", "order_idx", "number", "clause_id")


@query("b11_structure_profile", """
  with lens as (select doc_id, list_sort(list(length(text))) as l from v_clauses group by doc_id),
  nums as (
    select doc_id, count(*) filter (n > 1) as shared_numbers, coalesce(sum(n) filter (n > 1), 0) as shared_clauses
    from (select doc_id, number, count(*) as n from v_clauses where number <> '' group by all) group by doc_id)
  select c.doc_id, count(*) as clauses, median(length(text))::double as median_chars,
    any_value(l.l[1 + cast(floor(len(l.l) * 0.9) as int)])::bigint as p90_chars, max(length(text))::bigint as max_chars,
    count(*) filter (ends_with(heading, '(cont.)')) as continuations, count(*) filter (number = '') as unnumbered,
    count(distinct section_path) as sections, count(*) filter (is_heading) as group_headings,
    coalesce(any_value(shared_numbers), 0)::bigint as shared_numbers, coalesce(any_value(shared_clauses), 0)::bigint as shared_clauses
  from v_clauses c join lens l using (doc_id) left join nums n using (doc_id) group by c.doc_id""")
def b11(spark, sf):
    return segment.structure_profile(views.clauses(spark, sf)).withColumn(
        "p90_chars", F.col("p90_chars").cast("bigint")).withColumn("max_chars", F.col("max_chars").cast("bigint"))


@query("t1_readability", """
  select doc_id, order_idx, words, units, syllables, round(grade, 6) as grade from v_signals""")
def t1(spark, sf):
    return score.readability(views.clauses(spark, sf)).select(
        "doc_id", "order_idx", "words", "units", "syllables", F.round("grade", 6).alias("grade"))


@query("t2_cross_references", """
  select doc_id, order_idx, crossrefs, round(crossref, 6) as crossref from v_signals""")
def t2(spark, sf):
    return views.clauses(spark, sf).withColumn("crossrefs", score.crossref_count("text")).select(
        "doc_id", "order_idx", "crossrefs", F.round(F.least(F.col("crossrefs") / 4.0, F.lit(1.0)), 6).alias("crossref"))


@query("t3_defined_terms", "select doc_id, term from v_terms")
def t3(spark, sf):
    return score.defined_terms(views.analysed_clauses(spark, sf))


@query("t4_term_dependence", "select doc_id, order_idx, terms_used from v_used")
def t4(spark, sf):
    return score.term_use(views.analysed_clauses(spark, sf)).select("doc_id", "order_idx", "terms_used")


@query("t5_position", """
  select doc_id, order_idx, round(percent_rank() over (partition by doc_id order by order_idx), 6) as position from v_clauses""")
def t5(spark, sf):
    return score.positions(views.clauses(spark, sf)).select(
        "doc_id", "order_idx", F.round("position", 6).alias("position"))


@query("t6_buriedness", "select doc_id, order_idx, position, reading, crossref, jargon, buriedness from v_scored")
def t6(spark, sf):
    return views.scored_clauses(spark, sf).select(
        "doc_id", "order_idx", "position", "reading", "crossref", "jargon", "buriedness")


@query("t7_impact", "select doc_id, order_idx, clause_type, impact from v_scored")
def t7(spark, sf):
    return views.scored_clauses(spark, sf).select("doc_id", "order_idx", "clause_type", "impact")


@query("t8_top_risks", f"""
  select doc_id, order_idx, clause_type, impact, buriedness, risk_rank from (
    select *, cast(row_number() over (partition by doc_id order by impact desc, order_idx) as int) as risk_rank from v_scored)
  where risk_rank <= {fixed.TOP_RISKS_DEFAULT}""")
def t8(spark, sf):
    return score.top_risks(views.scored_clauses(spark, sf)).select(
        "doc_id", "order_idx", "clause_type", "impact", "buriedness", "risk_rank")


@query("t9_type_counts", """
  select *, cast(row_number() over (partition by doc_id order by clauses desc, clause_type) as int) as type_rank from (
    select doc_id, clause_type, count(*) as clauses from v_analysed where clause_type is not null group by all)""")
def t9(spark, sf):
    return score.type_counts(views.analysed_clauses(spark, sf))


@query("t9_unanalysed", """
  select doc_id, count(*) as clauses, count(*) filter (clause_type is null) as unanalysed from v_analysed group by doc_id""")
def t9u(spark, sf):
    return score.unanalysed_counts(views.analysed_clauses(spark, sf))


@query("t10_clause_listing", """
  select doc_id, order_idx, impact, cast(row_number() over (partition by doc_id order by impact desc, order_idx) as int) as listing_rank
  from v_scored where clause_type = 'exclusion'""")
def t10(spark, sf):
    return score.clause_listing(views.scored_clauses(spark, sf), "exclusion").select(
        "doc_id", "order_idx", "impact", "listing_rank")


@query("t11_clause_details", """
  select s.doc_id, s.order_idx, s.text, s.char_start::bigint as char_start, s.char_end::bigint as char_end, s.impact, s.likelihood, s.severity
  from v_scored s semi join labels l on l.doc_id = s.doc_id and l.quality = s.order_idx""")
def t11(spark, sf):
    keys = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("order_idx"))
    return score.clause_details(keys, views.scored_clauses(spark, sf)).select(
        "doc_id", "order_idx", "text", "char_start", "char_end", "impact", "likelihood", "severity")


@query("t12_burial_reasons", f"""
  select doc_id, order_idx, buriedness,
    array_to_string(list_filter([{", ".join(f"case when {k} >= {v[0]} then {o.q(v[1])} end" for k, v in fixed.BURIED_REASONS.items())}],
      lambda x: x is not null), '; ') as reasons,
    case {" ".join(f"when buriedness >= {f} then {o.q(w)}" for f, w in fixed.BURIED_BANDS)} else {o.q(fixed.BURIED_PLAIN)} end as buried_label
  from v_scored""")
def t12(spark, sf):
    return score.burial_reasons(views.scored_clauses(spark, sf)).select(
        "doc_id", "order_idx", "buriedness", F.array_join("reasons", "; ").alias("reasons"), "buried_label")


@query("t13_risk_chips", f"""
  select doc_id, clause_type, clauses, clause_type in {o.q_list(fixed.RISKY_TYPES)} as is_risky,
    cast(coalesce(sum(clauses) filter (clause_type in {o.q_list(fixed.RISKY_TYPES)}) over (partition by doc_id), 0) as bigint) as risky_total,
    cast(row_number() over (partition by doc_id order by case when clause_type in {o.q_list(fixed.RISKY_TYPES)} then 0 else 1 end,
      clauses desc, clause_type) as int) as chip_rank
  from (select doc_id, clause_type, count(*) as clauses from v_analysed where clause_type is not null group by all)""")
def t13(spark, sf):
    return score.risk_chips(score.type_counts(views.analysed_clauses(spark, sf))).drop("type_rank")
