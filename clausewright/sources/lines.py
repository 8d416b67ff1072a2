"""Line tables with offsets, from plain text and from HTML pages.

A text document is one row, so all lines of a document come from one row and a
window over `doc_id` is bounded by it. Documents put together from many rows
(the pages of a host) have no such bound; their offsets go through
`paged_offsets`, which never holds a whole document in one task.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.operators import scale


def document_window() -> "Window":
    return Window.partitionBy("doc_id").orderBy("line_no")


def split_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Document rows to non-blank lines; a form feed starts a page."""
    pages = documents.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\f")).alias("page", "_p")
    )
    lines = pages.select(
        "doc_id", "page", F.posexplode(F.split("_p", "\n")).alias("_i", "_raw")
    ).withColumn("text", tx.scrub("_raw"))
    w = Window.partitionBy("doc_id").orderBy("page", "_i")
    return (
        lines.filter(F.col("text") != "")
        .withColumn("line_no", (F.row_number().over(w) - 1).cast("int"))
        .select("doc_id", "line_no", "page", "text")
    )


def with_offsets(lines: DataFrame) -> DataFrame:
    """Offsets into the lines joined by a newline; the cursor moves by length + 1."""
    w = document_window().rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("bigint")
    return lines.withColumn("char_start", start).withColumn(
        "char_end", F.col("char_start") + F.length("text")
    )


def line_table(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line with page and offsets."""
    return with_offsets(split_lines(documents, doc_id, text))


def raw_text(lines: DataFrame) -> DataFrame:
    """The text the offsets point into, one row per document."""
    joined = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]
        ),
        "\n",
    )
    return lines.groupBy("doc_id").agg(joined.alias("raw_text"))


# Type sizes by tag; other text has the size of a paragraph.
TAG_SIZES = {"h1": 20.0, "h2": 17.0, "h3": 14.0, "h4": 12.0, "h5": 11.0, "h6": 10.5,
             "p": 10.0, "li": 10.0, "td": 9.0, "th": 9.0}
TEXT_SIZE = 10.0
# Tags that begin or end a line; all others stand inside one.
BLOCKS = (
    "html|body|main|section|article|aside|header|footer|nav|div|address|blockquote|figure|figcaption|form|fieldset|"
    "h[1-6]|p|br|hr|li|ul|ol|dl|dt|dd|table|caption|thead|tbody|tfoot|tr|th|td|pre"
)
RE_DROPPED = r"(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
# The rest of a tag up to its end: a quoted value may hold what would end it.
RE_ATTRIBUTES = r"""[^'">]*(?:(?:"[^"]*"|'[^']*')[^'">]*)*"""
RE_BLOCK_TAG = rf"(?is)^<(/?(?:{BLOCKS}))\b{RE_ATTRIBUTES}>"
RE_BOLD = r"(?is)<(?:b|strong)\b"
RE_BOLD_LATER = r"(?is)[^\s<>][^<>]*<(?:b|strong)\b|^\s*<(?:b|strong)\b[^>]*>[^<]*</(?:b|strong)>.*<(?:b|strong)\b"
# A tag begins with a letter, a slash or a declaration; any other `<` is text.
RE_TAG = rf"(?s)<[A-Za-z/!?]{RE_ATTRIBUTES}>"
# What may be a character reference, up to its semicolon.
RE_REFERENCE = r"#[0-9]{1,7};|#[xX][0-9A-Fa-f]{1,6};|[A-Za-z][A-Za-z0-9]{1,7};"
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def unescape(c):
    """Characters named by HTML 4, and numbers in decimal and hexadecimal form, each reference once.

    What names nothing stays as it is: an unknown name, zero, half a pair, a number past the last character.
    """
    parts = F.split(c, f"&(?={RE_REFERENCE})")
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def read(p):
        name = F.substring_index(p, ";", 1)
        number = (
            F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 7), 16, 10).cast("bigint"))
            .when(name.startswith("#"), F.substring(name, 2, 7).cast("bigint")))
        valid = (number > 0) & ~number.between(0xD800, 0xDFFF) & (number <= 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(
            number.isNull(), named[name])
        rest = F.substring(p, F.instr(p, ";") + 1, F.length(p))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), p))

    found = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), read)
    return F.when(F.size(parts) > 1, F.concat(parts[0], F.array_join(found, ""))).otherwise(c)


def html_lines(pages: DataFrame, page_id: str = "page_id", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """HTML pages to styled lines, with the columns `keep` of the page.

    Every text node outside the head, scripts, styles and comments is in a line.
    A line begins at each tag of `BLOCKS`; its tag is the one that opens it, or
    `text` where it follows a closing tag or a break. A heading tag or a bold run
    makes a line bold.
    """
    # A piece before the first tag, so that all pages are counted alike.
    body = F.concat(F.lit(" "), F.regexp_replace(F.col(html), RE_DROPPED, ""))
    pieces = F.split(body, rf"(?is)(?=</?(?:{BLOCKS})\b)", -1)
    rows = pages.select(F.col(page_id).alias("page_id"), *(keep or []), F.posexplode(pieces).alias("block_no", "_b"))
    opened = F.lower(F.regexp_extract("_b", RE_BLOCK_TAG, 1))
    tag = F.when((opened == "") | opened.startswith("/") | opened.isin("br", "hr"), "text").otherwise(opened)
    inner = F.regexp_replace("_b", RE_BLOCK_TAG, "")
    spans = F.filter(
        F.split(inner, r"(?is)</?(?:b|strong)\b[^>]*>"), lambda s: F.trim(F.regexp_replace(s, RE_TAG, "")) != ""
    )
    text = F.trim(F.regexp_replace(unescape(F.regexp_replace(inner, RE_TAG, " ")), r"[\x00-\x20]+", " "))
    heading = tag.rlike("^h[1-6]$")
    return (
        rows.select(
            "page_id", *(keep or []), "block_no", tag.alias("tag"), text.alias("text"),
            F.coalesce(tx.lookup(tag, TAG_SIZES), F.lit(TEXT_SIZE)).alias("size"),
            (heading | inner.rlike(RE_BOLD)).alias("bold"),
            # Bold past the first run of text; a line of one run is all words.
            F.when(heading, F.lit(True))
            .when(F.size(spans) <= 1, inner.rlike(RE_BOLD))
            .otherwise(inner.rlike(RE_BOLD_LATER)).alias("words_bold"),
        )
        .filter(F.col("text") != "")
    )


def paged_offsets(lines: DataFrame) -> DataFrame:
    """Offsets for documents of many page rows (doc_id, page, line_no within the page).

    Inside a page the lines are ordered by a window over the page; the page
    starts come from a blocked running sum over page lengths.
    """
    inside = Window.partitionBy("doc_id", "page").orderBy("line_no")
    local = lines.withColumn(
        "_local",
        F.coalesce(
            F.sum(F.length("text") + 1).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    pages = lines.groupBy("doc_id", "page").agg(F.sum(F.length("text") + 1).alias("_chars"))
    starts = scale.prefix_sum(pages, ["doc_id"], "page", "_chars", "page_start")
    return (
        local.join(starts.select("doc_id", "page", "page_start"), ["doc_id", "page"])
        .withColumn("char_start", (F.col("page_start") + F.col("_local")).cast("bigint"))
        .withColumn("char_end", F.col("char_start") + F.length("text"))
        .drop("_local", "page_start")
    )


def page_starts(lines: DataFrame) -> DataFrame:
    """S3: first offset of each page of a document, in page order."""
    first = lines.groupBy("doc_id", "page").agg(F.min("char_start").alias("page_start"))
    return first
