"""Cleaning and layout over a line table."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.operators import scale
from clausewright.sources.shared import bounded_batches


def margin_keys(lines: DataFrame) -> DataFrame:
    """The band and digit-masked text of every line that sits in a margin.

    Needs y0, y1 and page_height. A bare number outside the bands is keyed by
    its height on the page.
    """
    top = F.col("y0") < F.col("page_height") * fixed.MARGIN_BAND
    bottom = F.col("y1") > F.col("page_height") * (1 - fixed.MARGIN_BAND)
    number = F.trim("text").rlike(r"^\d+$")
    masked = F.regexp_replace(
        F.trim(F.regexp_replace("text", r"\s+", " ")), r"\d+", "#"
    )
    height = F.format_string("%.2f", F.col("y0") / F.col("page_height"))
    return lines.withColumn(
        "band",
        F.when(top, "top").when(bottom, "bottom").when(number, "number"),
    ).withColumn(
        "margin_key",
        F.when(top | bottom, masked).when(number, height),
    )


def repeated_margin_keys(keyed: DataFrame) -> DataFrame:
    """Keys present on max(3, half of the pages) distinct pages of a document."""
    per_page = keyed.filter("band is not null").select(
        "doc_id", "band", "margin_key", "page"
    ).distinct()
    seen = per_page.groupBy("doc_id", "band", "margin_key").agg(F.count("*").alias("n_pages"))
    # Distinct pages before counting: partial aggregation keeps a hot document split.
    pages = (
        keyed.select("doc_id", "page").distinct()
        .groupBy("doc_id").agg(F.count("*").alias("doc_pages"))
    )
    needed = F.greatest(
        F.lit(float(fixed.MARGIN_MIN_PAGES)), F.col("doc_pages") * fixed.MARGIN_PAGE_SHARE
    )
    return seen.join(pages, "doc_id").filter(F.col("n_pages") >= needed)


def drop_margin_lines(lines: DataFrame) -> DataFrame:
    """The lines that are not running headers, footers or page numbers.

    The keys are few, because each one repeats.
    """
    keyed = margin_keys(lines)
    repeated = repeated_margin_keys(keyed).select("doc_id", "band", "margin_key")
    inside = keyed.filter("band is null")
    margin = scale.salted_join(
        keyed.filter("band is not null"), repeated, ["doc_id", "band", "margin_key"], "left_anti"
    )
    return inside.unionByName(margin).drop("band", "margin_key")


def body_sizes(lines: DataFrame) -> DataFrame:
    """C4: the font size that carries most characters; the first seen wins a tie."""
    per_size = lines.groupBy("doc_id", F.round("size", 1).alias("body_size")).agg(
        F.sum(F.length("text")).alias("weight"), F.min("line_no").alias("first_line")
    )
    return per_size.groupBy("doc_id").agg(
        F.max_by("body_size", F.struct("weight", -F.col("first_line"))).alias("body_size"),
        F.max("weight").alias("weight"),
    )


def offset_violations(documents: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans whose slice of raw_text differs from their text."""
    joined = spans.join(documents.select("doc_id", "raw_text"), "doc_id", "left")
    cut = F.substring(
        F.col("raw_text"), F.col("char_start").cast("int") + 1,
        (F.col("char_end") - F.col("char_start")).cast("int"),
    )
    return joined.filter(~cut.eqNullSafe(F.col("text"))).select(*keys, "char_start", "char_end", "text")


def _wrong_spans():
    """Number of spans (char_start, char_end, text) whose slice of the raw text differs from their text."""

    @F.arrow_udf(T.LongType())
    def wrong(raw: pa.Array, spans: pa.Array) -> pa.Array:
        own = spans.flatten()
        starts, ends = own.field("char_start").to_pylist(), own.field("char_end").to_pylist()
        texts, sizes = own.field("text").to_pylist(), pc.list_value_length(spans).to_pylist()
        out, at = [], 0
        for text, n in zip(raw.to_pylist(), sizes):
            out.append(sum(
                starts[i] < 0 or text[starts[i]:ends[i]] != texts[i] for i in range(at, at + n)))
            at += n
        return pa.array(out, pa.int64())

    return wrong


def offset_audit(lines: DataFrame, clauses: DataFrame) -> DataFrame:
    """C5 as counts: per document the spans of its lines and clauses, and those that `offset_violations` would name.

    A document is one row with its spans: its text is never repeated for each of them, and Arrow's strings are
    cut at a place without a walk from the beginning, as `substring` needs it.
    """
    bounded_batches(lines.sparkSession)
    span = ["char_start", "char_end", "text"]
    read = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", *span))).alias("_lines"))
    cut = clauses.groupBy("doc_id").agg(F.collect_list(F.struct(*span)).alias("_clauses"))
    only = F.transform("_lines", lambda x: F.struct(*[x[f].alias(f) for f in span]))
    rows = read.join(cut.hint("merge"), "doc_id", "left").select(
        "doc_id", F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("_raw"),
        F.concat(only, F.coalesce("_clauses", F.slice(only, 1, 0))).alias("_spans"))
    return rows.select(
        "doc_id", F.size("_spans").cast("bigint").alias("spans"), _wrong_spans()("_raw", "_spans").alias("violations"))


def as_read(lines: DataFrame) -> DataFrame:
    """A lone marker is read with the next line on its row, to its right."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    mate = F.lead(F.struct("text", "page", "x0", "y0", "bold")).over(w)
    beside = (
        F.col("text").rlike(fixed.RE_MARKER_ONLY)
        & (F.col("_mate.page") == F.col("page"))
        & (F.abs(F.col("_mate.y0") - F.col("y0")) < (F.col("y1") - F.col("y0")) / 2)
        & (F.col("_mate.x0") > F.col("x0"))
    )
    return (
        lines.withColumn("_mate", mate)
        .withColumn("joined", F.coalesce(beside, F.lit(False)))
        .withColumn(
            "read_text",
            F.when(F.col("joined"), F.concat_ws(" ", "text", "_mate.text")).otherwise(F.col("text")),
        )
        # The words' styling, not the number's.
        .withColumn(
            "read_words_bold",
            F.when(F.col("joined"), F.col("_mate.bold")).otherwise(F.col("words_bold")),
        )
        .drop("_mate")
    )


def despaced_lines(lines: DataFrame) -> DataFrame:
    """C6 as a table: lines whose letter-spacing is repaired."""
    return lines.withColumn("repaired", tx.despaced("text"))
