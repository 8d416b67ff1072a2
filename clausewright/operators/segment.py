"""Lines to clauses, as gaps and islands over the line order.

All windows share the one partitioning by `doc_id`, so the whole chain costs a
single shuffle of the lines. A document's lines come from one row of text,
which bounds each window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.operators import layout


def _doc(order: str = "line_no") -> "Window":
    return Window.partitionBy("doc_id").orderBy(order)


def _so_far(order: str = "line_no") -> "Window":
    return _doc(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(order: str = "line_no") -> "Window":
    return _doc(order).rowsBetween(Window.unboundedPreceding, -1)


def numbering(c):
    """B2: (number, strong) of a line, null where it has no clause numbering."""
    c = tx.col(c)
    decimal = F.regexp_extract(c, fixed.RE_DECIMAL, 1)
    return (
        F.when(
            c.rlike(fixed.RE_PAREN),
            F.struct(F.regexp_extract(c, fixed.RE_PAREN_MARK, 1).alias("number"), F.lit(True).alias("strong")),
        )
        .when(
            c.rlike(fixed.RE_LABELLED),
            F.struct(
                F.regexp_replace(F.regexp_extract(c, fixed.RE_LABELLED, 0), r"\s+", " ").alias("number"),
                F.lit(True).alias("strong"),
            ),
        )
        .when(
            c.rlike(fixed.RE_CODED_ITEM),
            F.struct(
                F.format_string(
                    "Excl%02d", F.regexp_extract(c, fixed.RE_CODED_ITEM, 1).cast("int")
                ).alias("number"),
                F.lit(True).alias("strong"),
            ),
        )
        .when(c.rlike(fixed.RE_BARE_INT) | c.rlike(fixed.RE_DECIMAL_MONEY), F.lit(None))
        .when(
            c.rlike(fixed.RE_DECIMAL),
            F.struct(decimal.alias("number"), c.rlike(fixed.RE_DECIMAL_STRONG).alias("strong")),
        )
    )


def with_body_size(lines: DataFrame) -> DataFrame:
    """C4 as windows, so that it needs no join back."""
    size = F.round("size", 1)
    by_size = Window.partitionBy("doc_id", "_size")
    weighed = (
        lines.withColumn("_size", size)
        .withColumn("_weight", F.sum(F.length("text")).over(by_size))
        .withColumn("_first", F.min("line_no").over(by_size))
    )
    best = F.max_by("_size", F.struct("_weight", -F.col("_first"))).over(Window.partitionBy("doc_id"))
    return weighed.withColumn("body_size", best).drop("_size", "_weight", "_first")


def classify_lines(lines: DataFrame) -> DataFrame:
    """B1-B3 with C4, C6, C7: section / clause start / body, per line."""
    df = layout.as_read(with_body_size(lines))
    head = tx.despaced(F.trim("text"))
    section = (
        ((F.col("size") >= F.col("body_size") * fixed.SECTION_SIZE_RATIO) & F.col("bold"))
        | (F.col("bold") & F.trim("text").rlike(fixed.RE_ANNEXURE_HEAD))
        | (
            (F.length("_head") <= fixed.SECTION_MAX_CHARS)
            & tx.is_upper("_head")
            & (
                F.col("_head").rlike(fixed.RE_SECTION_HEAD)
                | F.lower("_head").rlike(fixed.RE_SECTION_WORD)
            )
        )
    )
    df = df.withColumn("_head", head).withColumn("is_section", section)
    df = df.withColumn(
        "numbering", F.when(~F.col("is_section"), numbering("read_text"))
    ).withColumn("section_title", F.when(F.col("is_section"), F.col("_head")))
    numbered = F.col("numbering").isNotNull()
    share = F.avg(F.when(numbered, F.col("bold").cast("int"))).over(Window.partitionBy("doc_id"))
    df = df.withColumn(
        "numbers_bold", F.coalesce(share >= fixed.BOLD_NUMBER_SHARE, F.lit(False))
    )
    term = F.regexp_extract("read_text", fixed.RE_DEFINED_TERM, 1)
    df = df.withColumn(
        "term",
        F.when(
            ~F.col("is_section") & F.col("bold") & F.col("read_text").rlike(fixed.RE_DEFINED_TERM), term
        ),
    )
    start = (
        numbered
        & F.col("term").isNull()
        & (
            F.col("numbering.strong")
            | F.col("read_words_bold")
            | (F.col("size") >= F.col("body_size") * fixed.CLAUSE_SIZE_RATIO)
        )
        & ~(
            F.col("numbers_bold")
            & ~F.col("bold")
            & F.col("numbering.number").rlike(fixed.RE_SINGLE_LEVEL)
        )
    )
    return (
        df.withColumn("is_start", F.coalesce(start, F.lit(False)))
        .withColumn("number", F.regexp_replace("numbering.number", r"\.+$", ""))
        .drop("_head", "numbering")
    )


def _list_state(df: DataFrame, outline) -> DataFrame:
    """B7 state: the anchor a digits-only start hangs on, and whether it carries on the list."""
    digits = F.col("is_start") & F.col("number").rlike(r"^\d+$") & ~outline
    anchor = (
        F.col("is_section") | outline | F.col("term").isNotNull()
        | (F.col("is_start") & ~F.col("number").rlike(r"^\d+$"))
    )
    anchor_number = F.when(
        anchor,
        F.when(F.col("is_section") | outline | F.col("term").isNotNull(), F.lit("")).otherwise(
            F.col("number")
        ),
    )
    df = (
        df.withColumn("_digits", digits)
        .withColumn("_anchor", F.sum(anchor.cast("int")).over(_so_far()))
        .withColumn("_anchor_number", F.last(anchor_number, ignorenulls=True).over(_so_far()))
        .withColumn("_item", F.when(F.col("_digits"), F.col("number").cast("bigint")))
    )
    group = Window.partitionBy("doc_id", "_anchor").orderBy("line_no")
    earlier = group.rowsBetween(Window.unboundedPreceding, -1)
    last_item = F.coalesce(F.last("_item", ignorenulls=True).over(earlier), F.lit(-1))
    carries = (F.col("_item") == 1) | (F.col("_item") == last_item + 1)
    df = df.withColumn(
        "_ok", F.when(F.col("_digits"), F.coalesce(carries, F.lit(False)).cast("int"))
    )
    return df.withColumn(
        "_ok_so_far",
        F.coalesce(F.min("_ok").over(group.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)),
    ).withColumn("_ok_before", F.coalesce(F.min("_ok").over(earlier), F.lit(1)))


def outline_sections(lines: DataFrame) -> DataFrame:
    """Outline-numbered section headings, by letter or by the top-level count."""
    label = F.regexp_extract("read_text", fixed.RE_OUTLINE, 1)
    words = F.split(F.lower(F.regexp_extract("read_text", fixed.RE_OUTLINE, 2)), r"\s+")
    name = F.array_join(
        F.filter(words, lambda w: ~w.isin(fixed.OUTLINE_FILLER) & (w != "")), " "
    )
    shaped = (
        ~F.col("is_section")
        & F.col("read_text").rlike(fixed.RE_OUTLINE)
        & name.rlike(fixed.RE_OUTLINE_NAME)
    )
    df = lines.withColumn("_label", F.when(shaped, label))
    letter = F.coalesce(F.col("_label").rlike("^[a-h]$"), F.lit(False))
    df = _list_state(df, letter)
    first_child = F.concat(F.col("_label"), F.lit(".1"))
    follows = None
    for n in (1, 2, 3):
        here = F.coalesce(
            F.lead("read_text", n).over(_doc()).startswith(first_child), F.lit(False)
        )
        follows = here if follows is None else follows | here
    eligible = (
        F.coalesce(F.col("_label").rlike(r"^\d"), F.lit(False))
        & F.coalesce(
            F.col("_anchor_number").startswith(
                F.concat((F.col("_label").cast("int") - 1).cast("string"), F.lit("."))
            ),
            F.lit(False),
        )
        & (F.col("_ok_before") == 1)
        & follows
    )
    df = df.withColumn("_eligible", eligible.cast("int"))
    group = Window.partitionBy("doc_id", "_anchor").orderBy("line_no")
    first = (
        F.coalesce(F.sum("_eligible").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    )
    outline = letter | ((F.col("_eligible") == 1) & first)
    df = df.withColumn("is_outline", outline).drop(
        "_label", "_eligible", "_digits", "_anchor", "_anchor_number", "_item", "_ok",
        "_ok_so_far", "_ok_before",
    )
    # The words beside a lone marker were read with it; their own line is spent.
    spent = F.coalesce(F.lag(F.col("is_outline") & F.col("joined")).over(_doc()), F.lit(False))
    return df.withColumn("is_spent", spent)


def clause_starts(lines: DataFrame) -> DataFrame:
    """Sections, outline headings, accepted starts and the island of each line.

    A list restarting at 1 inside a dotted clause is not a start while it
    counts up; the first item that does not is one, and so are all after it.
    """
    df = outline_sections(classify_lines(lines))
    df = (
        df.withColumn("is_outline", F.col("is_outline") & ~F.col("is_spent"))
        .withColumn("is_section", F.col("is_section") & ~F.col("is_spent"))
        .withColumn("section_title", F.when(F.col("is_section"), F.col("section_title")))
        .withColumn("term", F.when(~F.col("is_outline") & ~F.col("is_spent"), F.col("term")))
        .withColumn("is_start", F.col("is_start") & ~F.col("is_outline") & ~F.col("is_spent"))
    )
    df = _list_state(df, F.col("is_outline"))
    suppressed = (
        F.col("_digits")
        & F.contains(F.coalesce(F.col("_anchor_number"), F.lit("")), F.lit("."))
        & (F.col("_ok_so_far") == 1)
    )
    df = (
        df.withColumn("is_start", (F.col("is_start") & ~suppressed) | F.col("term").isNotNull())
        .withColumn("is_break", F.col("is_section") | F.col("is_outline"))
    )
    title = F.coalesce(F.col("section_title"), F.when(F.col("is_outline"), F.col("read_text")))
    return (
        df.withColumn("section_path", F.coalesce(F.last(title, ignorenulls=True).over(_so_far()), F.lit("")))
        .withColumn("island", F.sum((F.col("is_start") | F.col("is_break")).cast("int")).over(_so_far()))
        .withColumn("is_heading_line", F.col("is_break") | F.col("is_spent"))
        .withColumn("number", F.when(F.col("is_start") & F.col("term").isNull(), F.col("number")).otherwise(F.lit("")))
        .withColumn(
            "heading",
            F.when(F.col("term").isNotNull(), F.col("term"))
            .when(
                F.col("is_start") & (F.length("read_text") <= fixed.HEADING_MAX_CHARS),
                F.trim("read_text"),
            )
            .otherwise(F.lit("")),
        )
        .drop("_digits", "_anchor", "_anchor_number", "_item", "_ok", "_ok_so_far", "_ok_before")
    )


def assemble(started: DataFrame) -> DataFrame:
    """One row per island; heading lines stay as rows of their own (`is_clause` false)."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    first = F.min_by(
        F.struct("number", "heading", "section_path", "page"), F.col("line_no")
    )
    rows = started.groupBy("doc_id", "island", "is_heading_line").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"),
        first.alias("_first"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.min("char_start").alias("char_start"),
        F.max("char_end").alias("char_end"),
    )
    return rows.select(
        "doc_id", (~F.col("is_heading_line")).alias("is_clause"), "char_start", "char_end",
        "page_start", "page_end", "_first.number", "_first.heading", "_first.section_path",
        "text", F.lit("\n").alias("joint"),
    )


_LINKS = "array<struct<at:int,page:int,is_clause:boolean>>"


def piece_ends(text: Column, limit: int = fixed.CLAUSE_MAX_CHARS, sentence: str = fixed.RE_SENTENCE_LINE_END) -> Column:
    """Ends of the pieces of an oversize text: array<int>, at least one.

    A piece ends at a sentence end in the window's second half, else at the
    last newline, else where the window ends. Every step of the fold cuts one
    piece; a piece ends at a newline or has half a window at least, which bounds
    the number of steps.
    """
    size = F.length(text)
    steps = F.regexp_count(text, F.lit("\n")) + F.ceil(size * 2 / limit).cast("int") + 1

    def cut(state: Column, _: Column) -> Column:
        start = state["at"]
        window = F.substring(text, start + 1, F.lit(limit))
        whole = start + F.length(window)
        at = F.length(F.regexp_extract(window, sentence, 1))
        newline = F.instr(F.reverse(window), "\n")
        at = F.when(at >= limit // 2, at).otherwise(F.when(newline > 0, F.length(window) - newline).otherwise(0))
        end = F.when((whole < size) & (at > 0), start + at).otherwise(whole)
        # The end is named once and used twice.
        grown = F.transform(F.array(end), lambda e: F.struct(
            (e + 1).alias("at"), F.concat(state["ends"], F.array(e)).alias("ends")))[0]
        return F.when(start < size, grown).otherwise(state)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(F.sequence(F.lit(1), steps), begin, cut)["ends"]


def split_oversize(rows: DataFrame) -> DataFrame:
    """Clauses over the limit become pieces; one character is skipped at each cut."""
    over = F.col("is_clause") & (F.length("text") > fixed.CLAUSE_MAX_CHARS)
    ends = F.when(over, piece_ends(F.col("text"))).otherwise(F.array(F.length("text").cast("int")))
    pieces = F.transform(ends, lambda e: F.struct(e.alias("end"), F.col("page_start").alias("page")))
    return _pieces_at(rows.withColumn("_pieces", pieces))


def _pieces_at(rows: DataFrame) -> DataFrame:
    """The pieces of each row, by `_pieces`: where each ends in the text, and its first page."""
    pieces = rows.withColumn("_starts", F.transform(
        "_pieces", lambda _, i: F.when(i == 0, F.lit(0)).otherwise(F.get("_pieces", i - 1)["end"] + 1)))
    pieces = pieces.select(
        *[c for c in rows.columns if c not in ("_pieces", "page_start")],
        F.posexplode(F.arrays_zip("_starts", "_pieces")).alias("_n", "_cut"))
    start, end = F.col("_cut._starts"), F.col("_cut._pieces.end")
    return pieces.select(
        "doc_id", "is_clause",
        (F.col("char_start") + start).alias("char_start"),
        F.when(F.col("is_clause"), F.col("char_start") + end).otherwise(F.col("char_end")).alias("char_end"),
        F.col("_cut._pieces.page").alias("page_start"), "page_end", "number",
        F.when(F.col("_n") == 0, F.col("heading"))
        .otherwise(F.concat("heading", F.lit(" (cont.)"))).alias("heading"),
        "section_path",
        F.substring("text", start + 1, end - start).alias("text"),
        F.when(F.col("_n") == 0, F.col("joint")).otherwise(F.substring("text", start, F.lit(1))).alias("joint"),
    )


def merge_lead_ins(rows: DataFrame) -> DataFrame:
    """An unnumbered clause ending in a colon or semicolon joins the one below.

    Chains collapse: the island id is a running count from the end of the
    document of the clauses that are not lead-ins. `_links` holds for each clause
    of a chain where it begins in the joined text, and on which page.
    """
    whole = Window.partitionBy("doc_id")
    last_start = F.max(F.when(F.col("is_clause"), F.col("char_start"))).over(whole)
    lead_in = (
        F.col("is_clause") & (F.col("number") == "")
        & F.col("text").rlike(fixed.RE_LEAD_IN) & (F.col("char_start") < F.col("_last_start"))
    )
    upwards = (
        Window.partitionBy("doc_id").orderBy(F.desc("char_start"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    df = (
        rows.withColumn("_last_start", last_start)
        .withColumn("_keeps", (F.col("is_clause") & ~lead_in).cast("int"))
        .withColumn("_group", F.sum("_keeps").over(upwards))
    )
    parts = F.array_sort(
        F.collect_list(F.struct("char_start", "is_clause", "joint", "text", "page_start"))
    )
    clause_only = lambda c: F.when(F.col("is_clause"), F.col(c))
    merged = df.groupBy("doc_id", "_group").agg(
        parts.alias("_parts"),
        F.min(clause_only("char_start")).alias("char_start"),
        F.max(clause_only("char_end")).alias("char_end"),
        F.min(clause_only("page_start")).alias("page_start"),
        F.max(clause_only("page_end")).alias("page_end"),
        # The follower: the last clause row of the group.
        F.max_by(
            F.struct("number", "heading", "section_path"), clause_only("char_start")
        ).alias("_follower"),
        F.min_by("joint", clause_only("char_start")).alias("joint"),
    ).filter(F.col("char_start").isNotNull())
    kept = F.filter(F.col("_parts"), lambda p: p["char_start"] >= F.col("char_start"))
    text = F.array_join(
        F.transform(
            kept, lambda p, i: F.when(i == 0, p["text"]).otherwise(F.concat(p["joint"], p["text"]))
        ),
        "",
    )
    # Where each part begins: what stands before it, joints included.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_LINKS).alias("links"))

    def placed(held: Column, p: Column) -> Column:
        start = F.when(F.size(held["links"]) == 0, F.lit(0)).otherwise(held["at"] + F.length(p["joint"]))
        grown = F.struct(start.alias("at"), p["page_start"].alias("page"), p["is_clause"].alias("is_clause"))
        return F.struct((start + F.length(p["text"])).alias("at"), F.concat(held["links"], F.array(grown)).alias("links"))

    links = F.filter(F.aggregate(kept, begin, placed)["links"], lambda x: x["is_clause"])
    return merged.select(
        "doc_id", F.lit(True).alias("is_clause"), "char_start", "char_end", "page_start", "page_end",
        "_follower.number", "_follower.heading", "_follower.section_path",
        text.alias("text"), "joint", links.alias("_links"),
    )


def chain_ends(text: Column, links: Column, limit: int = fixed.CLAUSE_MAX_CHARS) -> Column:
    """Pieces of a joined text as array<struct<end, page>>: cut again at each link, from the last clause up.

    A link adds its clause in front of the first piece so far; if that grows
    over the limit it is cut, and only its own first piece takes the next link.
    """
    first = F.struct(F.length(text).alias("end"), F.element_at(links, -1)["page"].alias("page"))
    above = F.reverse(F.slice(links, 1, F.size(links) - 1))

    def link(pieces: Column, x: Column) -> Column:
        size = pieces[0]["end"] - x["at"]
        whole = F.array(F.struct(pieces[0]["end"].alias("end"), x["page"].alias("page")))
        cut = F.transform(
            piece_ends(F.substring(text, x["at"] + 1, size), limit),
            lambda e: F.struct((x["at"] + e).alias("end"), x["page"].alias("page")))
        return F.concat(F.when(size > limit, cut).otherwise(whole), F.slice(pieces, 2, F.size(pieces)))

    folded = F.aggregate(above, F.array(first), link)
    return F.when(F.length(text) > limit, folded).otherwise(
        F.array(F.struct(F.length(text).alias("end"), links[0]["page"].alias("page"))))


def split_chains(merged: DataFrame) -> DataFrame:
    """B9b, second half: the clauses of `merge_lead_ins`, those over the limit cut link by link."""
    return _pieces_at(merged.withColumn("_pieces", chain_ends(F.col("text"), F.col("_links"))).drop("_links"))


def mark_group_headings(clauses: DataFrame) -> DataFrame:
    """B9c with the final order: a top-level number directly above its first child."""
    w = Window.partitionBy("doc_id").orderBy("char_start")
    child = F.lead(F.struct("number", "text")).over(w)
    heading = (
        F.col("number").rlike(fixed.RE_TOP_NUMBER)
        & ~F.col("heading").endswith("(cont.)")
        & ~F.col("text").rlike(fixed.RE_QUANTITY)
        & (
            (F.col("_child.number") == F.concat("number", F.lit(".1")))
            | F.col("_child.text").rlike(fixed.RE_FIRST_ITEM)
        )
    )
    return (
        clauses.withColumn("_child", child)
        .withColumn("is_heading", F.coalesce(heading, F.lit(False)))
        .withColumn("order_idx", (F.row_number().over(w) - 1).cast("int"))
        .select(
            "doc_id", "order_idx", "section_path", "number", "heading", "text", "page_start",
            "page_end", "char_start", "char_end", "is_heading",
        )
    )


def segment(lines: DataFrame) -> DataFrame:
    """Lines to clauses: B1-B9c in order."""
    pieces = split_oversize(assemble(clause_starts(lines)))
    return mark_group_headings(split_chains(merge_lead_ins(pieces)))


def citation_ids(clauses: DataFrame) -> DataFrame:
    """The clause's own number (or c<idx>), repeats marked #2, #3."""
    base = F.when(F.col("number") != "", F.col("number")).otherwise(
        F.concat(F.lit("c"), F.col("order_idx").cast("string"))
    )
    w = Window.partitionBy("doc_id", "_base").orderBy("order_idx")
    n = F.row_number().over(w)
    return (
        clauses.withColumn("_base", base)
        .withColumn("_n", n)
        .withColumn(
            "clause_id",
            F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("#", "_base", F.col("_n").cast("string"))),
        )
        .drop("_base", "_n")
    )


def structure_profile(clauses: DataFrame) -> DataFrame:
    """Per document, how it was cut.

    One grouping by document, which its clauses have met for: lengths and numbers are sorted lists, bounded by the document.
    """
    length = F.length("text")
    lists = clauses.groupBy("doc_id").agg(
        F.count("*").alias("clauses"),
        F.array_sort(F.collect_list(length)).alias("_lengths"),
        F.array_sort(F.collect_list(F.when(F.col("number") != "", F.col("number")))).alias("_numbers"),
        F.count_if(F.col("heading").endswith("(cont.)")).alias("continuations"),
        F.count_if(F.col("number") == "").alias("unnumbered"),
        F.size(F.collect_set("section_path")).cast("bigint").alias("sections"),
        F.count_if("is_heading").alias("group_headings"),
    )
    known = F.size("_lengths")
    at = lambda n: F.get("_lengths", n.cast("int"))
    # Places of the sorted numbers that equal the one before, or the one after.
    before = lambda x, i: F.coalesce(x == F.get("_numbers", i - 1), F.lit(False))
    after = lambda x, i: F.coalesce(x == F.get("_numbers", i + 1), F.lit(False))
    shared = F.size(F.filter("_numbers", lambda x, i: before(x, i) | after(x, i)))
    kinds = F.size(F.filter("_numbers", lambda x, i: after(x, i) & ~before(x, i)))
    return lists.select(
        "doc_id", "clauses",
        ((at(F.floor((known - 1) / 2)) + at(F.floor(known / 2))) / 2.0).alias("median_chars"),
        # The length nine tenths of the way up the sorted list, not interpolated.
        at(F.floor(F.col("clauses") * 0.9)).alias("p90_chars"),
        F.get("_lengths", known - 1).alias("max_chars"),
        "continuations", "unnumbered", "sections", "group_headings",
        kinds.cast("bigint").alias("shared_numbers"), shared.cast("bigint").alias("shared_clauses"),
    )
