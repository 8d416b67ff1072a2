import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.operators import layout, score, segment
from clausewright.sources import lines as ln

SIZE, BODY = 14.0, 10.0


def styled(spark, rows):
    """rows: (text, bold, size, x0, y0); offsets are computed, one document."""
    data = [
        (1, i, 0, t, s, b, b if w is None else w, float(x), float(y), float(y) + 10)
        for i, (t, b, s, x, y, w) in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data, "doc_id long, line_no int, page int, text string, size double, bold boolean, "
              "words_bold boolean, x0 double, y0 double, y1 double")
    return ln.with_offsets(df)


def line(text, bold=False, size=BODY, x=72, y=None, words_bold=None):
    line.y += 14
    return (text, bold, size, x, line.y if y is None else y, words_bold)


line.y = 0


def cut(spark, rows):
    return [
        (r.number, r.heading, r.section_path, r.text, r.is_heading)
        for r in segment.segment(styled(spark, rows)).orderBy("order_idx").collect()
    ]


def test_line_offsets_slice_back(spark):
    docs = spark.createDataFrame([(7, "One line\n\n  two\x07 lines \n\x0cnext page\n")], "doc_id long, text string")
    lines = ln.line_table(docs)
    raw = ln.raw_text(lines).collect()[0].raw_text
    rows = lines.orderBy("line_no").collect()
    assert [r.text for r in rows] == ["One line", "two  lines", "next page"]
    assert [r.page for r in rows] == [0, 0, 1]
    assert all(raw[r.char_start:r.char_end] == r.text for r in rows)
    assert [r.page_start for r in ln.page_starts(lines).orderBy("page").collect()] == [0, 20]


def test_paged_offsets_equal_plain_offsets(spark):
    rows = [(1, p, i, "x" * (1 + (p * 7 + i) % 5)) for p in range(0, 9000, 3) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, page long, line_no int, text string")
    got = ln.paged_offsets(df).orderBy("page", "line_no").collect()
    cursor = 0
    for r in got:
        assert r.char_start == cursor
        cursor += len(r.text) + 1


NUMBERS = [
    ("4.2 Room rent", ("4.2", True)), ("1.5 times the rate", ("1.5", False)), ("24 hours of care", None),
    ("7.5 Lakhs", None), ("(a) Any loss", ("(a)", True)), ("(iv) Any loss", ("(iv)", True)),
    ("List  I - Items", ("List I", True)), ("a. Old ailments: Code – Excl01", ("Excl01", True)),
    ("List Items of cost", None), ("7. it carries on", ("7.", False)), ("Plain words", None),
]


def test_numbering(spark):
    df = spark.createDataFrame([(t,) for t, _ in NUMBERS], "text string")
    rows = df.select("text", segment.numbering("text").alias("n")).collect()
    got = {r.text: None if r.n is None else (r.n.number, r.n.strong) for r in rows}
    assert got == dict(NUMBERS)


def test_despaced_heading(spark):
    df = spark.createDataFrame(
        [("G E N E R A L  T E R M S",), ("P A Y M ENT S",), ("A plain line of words",)], "t string")
    got = [r[0] for r in df.select(tx.despaced("t")).collect()]
    assert got == ["GENERAL TERMS", "PAYMENTS", "A plain line of words"]


def test_sections_numbers_and_lone_markers(spark):
    got = cut(spark, [
        line("SECTION 1 BENEFITS"),
        line("1.1 Stay"), line("We pay for a stay."),
        line("1.2", y=100), line("Day care", x=120, y=100), line("We pay for a day."),
        line("WAITING PERIODS"), line("(a) Thirty days hold."),
    ])
    assert got == [
        ("1.1", "1.1 Stay", "SECTION 1 BENEFITS", "1.1 Stay\nWe pay for a stay.", False),
        ("1.2", "1.2 Day care", "SECTION 1 BENEFITS", "1.2\nDay care\nWe pay for a day.", False),
        ("(a)", "(a) Thirty days hold.", "WAITING PERIODS", "(a) Thirty days hold.", False),
    ]


def test_list_restart_stays_inside_a_dotted_clause(spark):
    got = cut(spark, [
        line("2.12 Options"), line("1. First choice"), line("2. Second choice"),
        line("4. Not the next"), line("5. Nor this one"),
    ])
    assert [g[0] for g in got] == ["2.12", "4", "5"]
    assert got[0][3] == "2.12 Options\n1. First choice\n2. Second choice"


def test_bold_numbers_make_plain_ones_items(spark):
    got = cut(spark, [
        line("1. Cover", bold=True), line("2. Sums", bold=True), line("7. Hernia of all kinds"), line("Body text"),
    ])
    assert [g[0] for g in got] == ["1", "2"]


def test_outline_heading_carries_on_the_count(spark):
    got = cut(spark, [
        line("4.1 Cover"), line("We pay."), line("5. Exclusions"), line("5.1 Never paid"), line("Theft."),
        line("c. Other Benefits:"), line("6.1 Extra"),
    ])
    assert [(g[0], g[2]) for g in got] == [("4.1", ""), ("5.1", "5. Exclusions"), ("6.1", "c. Other Benefits:")]


def test_defined_terms_start_clauses(spark):
    got = cut(spark, [
        line("“Ward” means a shared room.", bold=True), line("“Suite” means a private room.", bold=True),
    ])
    assert [g[1] for g in got] == ["Ward", "Suite"]


def test_lead_ins_join_the_clause_below(spark):
    got = cut(spark, [
        line("We shall not pay for:"), line("EXCLUSIONS"), line("any of the following;"),
        line("4.1 Theft"), line("4.2 Ends with a colon:"), line("4.3 Last one:"),
    ])
    assert [g[0] for g in got] == ["4.1", "4.2", "4.3"]
    assert got[0][3] == "We shall not pay for:\nEXCLUSIONS\nany of the following;\n4.1 Theft"


def walked_chain(parts, limit):
    """(end, page) of the pieces of joined parts (text, page), by walking up from the last part."""
    text, starts = "", []
    for part, _ in parts:
        starts.append(len(text) + (1 if text else 0))
        text += ("\n" if text else "") + part
    pieces = [(len(text), parts[-1][1])]
    for at, (_, page) in reversed(list(zip(starts, parts))[:-1]):
        end = pieces.pop(0)[0]
        cut = [at + e for e in brute_cuts(text[at:end], limit)] if end - at > limit else [end]
        pieces = [(e, page) for e in cut] + pieces
    return text, starts, pieces


def test_chains_are_cut_link_by_link(spark):
    sentence = "The company pays nothing for such harm.\n"
    last = (sentence * 80)[:2990]
    cases = [
        ([("We shall not pay for:", 1), ("any of these;", 2), ("in the case of:", 3), ("harm by:", 4), (last, 5)], 3000),
        ([("a:", 1), ("b:", 2), (last[:200], 3)], 3000),
        ([(sentence * 30 + "all of:", 1), (sentence * 40 + "none of:", 2), (last, 3)], 3000),
        ([(last, 9)], 3000),
        ([("p:", 1), ("q" * 90 + ":", 2), ("r:", 3), ((sentence * 4)[:95], 4)], 100),
    ]
    for parts, limit in cases:
        text, starts, want = walked_chain(parts, limit)
        links = [(at, page) for at, (_, page) in zip(starts, parts)]
        row = spark.createDataFrame([(text, links)], "text string, links array<struct<at:int,page:int>>")
        got = row.select(segment.chain_ends(F.col("text"), F.col("links"), limit).alias("p")).first()["p"]
        assert [tuple(x) for x in got] == want
    assert len(walked_chain(*cases[0])[2]) > 1


def test_a_chain_over_the_limit_differs_from_one_cut(spark):
    body = "\n".join(["The company pays nothing for such harm."] * 74)
    got = cut(spark, [line("We shall not pay for:"), line("any of the following;"), line("in the case of:")]
              + [line("4.1 Theft")] + [line(x) for x in body.split("\n")])
    assert [g[0] for g in got] == ["4.1", "4.1"] and got[0][3].startswith("We shall not pay for:\nany")
    assert got[1][1].endswith("(cont.)") and all(len(g[3]) <= 3000 for g in got)


def test_group_headings_are_marked(spark):
    got = cut(spark, [line("1. Hospital cover"), line("1.1 Room"), line("2. Capped at 2% a day"), line("2.1 Ward")])
    assert [g[4] for g in got] == [True, False, False, False]


def brute_cuts(text, limit=3000):
    """Piece ends found one character at a time."""
    ends, start = [], 0
    while start < len(text):
        end = min(start + limit, len(text))
        if end < len(text):
            best = None
            for p in range(start + limit // 2, end):
                head = text[start:p].rstrip(" \t")
                if text[p] == "\n" and head and head[-1] in ".;" and head[-4:-1].isalpha() and len(head) >= 4:
                    best = p
            if best is None:
                spots = [p for p in range(start + 1, end) if text[p] == "\n"]
                best = spots[-1] if spots else None
            end = best if best is not None else end
        ends.append(end)
        start = end + 1
    return ends


def test_oversize_cuts_match_brute_force(spark):
    texts = [
        "A sentence that ends.\n" * 400, "words without an end\n" * 400, "x" * 7000, "No. 5\nfine words here;\n" * 500,
        "a\n" + "y" * 5000 + "\nend.", "é😀 end.\n" * 900, "x" * 3000, "\n" * 3001, "y" * 2999 + "\n" + "z" * 3000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", segment.piece_ends(F.col("t")).alias("e"))
    for r in df.collect():
        assert r.e == brute_cuts(texts[r.i]), texts[r.i][:20]


def test_oversize_pieces_keep_offsets(spark):
    rows = [line("9.1 Long clause")] + [line("Some words that end here.") for _ in range(300)]
    lines = styled(spark, rows)
    raw = ln.raw_text(lines).collect()[0].raw_text
    got = segment.segment(lines).orderBy("order_idx").collect()
    assert len(got) == 3 and got[1].heading == "9.1 Long clause (cont.)"
    assert all(raw[r.char_start:r.char_end] == r.text for r in got)
    assert layout.offset_violations(ln.raw_text(lines), segment.segment(lines), ["order_idx"]).count() == 0


def test_result_does_not_depend_on_partitioning(spark):
    from clausewright.plans import views

    def digest(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = views.scored_clauses(spark, "/root/testdata/sf0.001").select("doc_id", "order_idx", "text", "impact")
        return sorted(map(tuple, df.collect()))

    one, many = digest(1), digest(17)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert one == many and len(one) > 500


def test_citation_ids_mark_repeats(spark):
    df = spark.createDataFrame(
        [(1, 0, "10"), (1, 1, ""), (1, 2, "10"), (1, 3, "10")], "doc_id long, order_idx int, number string")
    got = [r.clause_id for r in segment.citation_ids(df).orderBy("order_idx").collect()]
    assert got == ["10", "c1", "10#2", "10#3"]


def test_margin_lines_go_only_when_they_repeat(spark):
    rows = []
    for page in range(6):
        rows += [(1, page, 0, f"Insurer {page + 1} / 6", 5.0, 12.0), (1, page, 1, f"Body {page}", 300.0, 310.0)]
    rows += [(2, 0, 0, "Top", 5.0, 12.0), (2, 1, 0, "Top", 5.0, 12.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, y0 double, y1 double").withColumn(
        "page_height", F.lit(800.0))
    kept = layout.drop_margin_lines(df).collect()
    assert sorted(r.text for r in kept) == ["Body 0", "Body 1", "Body 2", "Body 3", "Body 4", "Body 5", "Top", "Top"]


# Counted by hand: runs of vowels, an e at the end left out unless it follows l or e, one at least.
SYLLABLES = {
    "scale": 2, "table": 2, "employee": 2, "indemnify": 4, "the": 1, "he": 1, "rhythm": 1, "hmm": 1, "queue": 1, "care": 1,
    "e": 1, "pole": 2, "agree": 2, "idea": 2, "Xyz": 1, "bee": 1, "sea": 1, "made": 1, "re-entry": 3, "don't": 1,
}


def test_syllables(spark):
    df = spark.createDataFrame([(w,) for w in SYLLABLES], "w string").select("w", tx.syllable_count("w").alias("n"))
    assert {r.w: r.n for r in df.collect()} == SYLLABLES


def test_scores_stay_in_range_and_omit_unanalysed(spark):
    from clausewright.plans import views

    scored = views.scored_clauses(spark, "/root/testdata/sf0.001", None)
    row = scored.agg(F.min("impact"), F.max("impact"), F.count("*"), F.min("position"), F.max("position")).collect()[0]
    assert 0 <= row[0] and row[1] <= 100 and row[2] > 500 and row[3] >= 0 and row[4] <= 1
    assert scored.filter("clause_type is null").count() == 0


def test_top_risks_limits():
    with pytest.raises(ValueError):
        score.top_risks(None, 51)


def test_lines_to_top_risks_in_one_exchange(spark):
    import contextlib
    import io

    from clausewright.plans import registry

    registry.load()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.QUERIES["t8_top_risks"](spark, "/root/testdata/sf0.001").explain()
    plan = out.getvalue()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and plan.count("FileScan") == 1


def test_markup_is_told_from_text(spark):
    from clausewright.sources import lines as ln

    pages = [
        (1, "<p>1 < 2 and b > c</p><p>a <b title='x > y'>bold</b> <3 end"),
        (2, '<p data-x="1 > 0">caf&eacute; &#x27;&uuml;&#x1F600;&#233;&#0;&#xD800; &unknown; &amp;lt; &AMP; &nbsp;&apos;</p>'),
        (3, "<!DOCTYPE html><h1 class=a>Head &copy</h1></><p>" + "x" * 20000 + " <i " + "y" * 20000 + ">z</i>"),
        (4, None), (5, ""), (6, "no tag & no end <b"),
    ]
    got = {}
    for r in ln.html_lines(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "block_no").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == ["1 < 2 and b > c", "a bold <3 end"]
    assert got[2] == ["café 'ü😀é&#0;&#xD800; &unknown; &lt; &AMP; '"]
    assert got[3] == ["Head &copy", "x" * 20000 + " z"]
    assert got[6] == ["no tag & no end <b"] and 4 not in got and 5 not in got
