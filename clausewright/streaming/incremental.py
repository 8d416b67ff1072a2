"""Newly arrived documents to lines to clauses to the store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.operators import segment
from clausewright.sources import lines as ln
from clausewright.sources import stores

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("revision", T.LongType())]
)


def plain_style(lines: DataFrame) -> DataFrame:
    """Lines of unstyled text: one size, no bold, no place on the page."""
    return lines.select(
        "*", F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("words_bold"),
        F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("y0"),
        F.lit(None).cast("double").alias("y1"),
    )


def newest_revisions(documents: DataFrame) -> DataFrame:
    """(doc_id, text), one row per document: the greatest `revision`, then the latest `arrived`.

    Either column may be absent. Equal in both, the greater text stands, so that
    the result doesn't depend on the order of rows.
    """
    order = [F.col(c) for c in ("revision", "arrived") if c in documents.columns]
    return documents.groupBy("doc_id").agg(F.max_by("text", F.struct(*order, "text")).alias("text"))


def clause_batch(
    documents: DataFrame, store: str, style: Callable[[DataFrame], DataFrame] = plain_style, batch: str | None = None
) -> None:
    """One batch of documents through the batch jobs into the clause store.

    If a document arrives twice in a batch the newest revision stands. In the
    store the greatest (revision, arrived) stands, in whatever batch it came; a
    blank revision deletes the document's clauses.
    """
    once = newest_revisions(documents)
    stores.write_clauses(segment.segment(style(ln.line_table(once))), store, batch, documents)


def stream_clauses(
    spark: SparkSession, arrivals: str, store: str, checkpoint: str,
    style: Callable[[DataFrame], DataFrame] = plain_style, files_per_batch: int = 1000,
    trigger: dict | None = None,
):
    """Watch a folder of parquet documents; every batch is idempotent per document.

    A batch is stored under its number and the stream's checkpoint: done again,
    it replaces only itself, and streams may share a store.
    """
    arriving = (
        spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
        .select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    )
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    writer = arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, number: clause_batch(rows, store, style, f"{stream}-{number}")
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()
