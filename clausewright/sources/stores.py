"""The stored tables, and the joined views read from them.

A store is two Parquet folders. `rows` holds the rows of each batch, `heads` one
row for each document of a batch: its revision, when it arrived, and how many rows
it has. A document shows the rows of its greatest (revision, arrived, batch), so
that an old revision may come late, and a head without rows deletes. Heads are
written after rows: a batch without heads has not happened. Nothing stored is read
or rewritten by a batch.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators import segment
from clausewright.sources.shared import written_once  # noqa: F401

VERSION = ["revision", "arrived"]


def clause_key(doc_id="doc_id", order_idx="order_idx") -> Column:
    return F.concat_ws(":", F.col(doc_id).cast("string"), F.col(order_idx).cast("string"))


def versioned(documents: DataFrame) -> DataFrame:
    """One (doc_id, revision, arrived) for each document; a missing column counts as null, which is less than any value."""
    have = set(documents.columns)
    revision = F.col("revision").cast("bigint") if "revision" in have else F.lit(None).cast("bigint")
    arrived = F.col("arrived").cast("timestamp") if "arrived" in have else F.lit(None).cast("timestamp")
    rows = documents.select("doc_id", revision.alias("revision"), arrived.alias("arrived"))
    return rows.groupBy("doc_id").agg(F.max(F.struct(*VERSION)).alias("v")).select("doc_id", "v.*")


def _write(rows: DataFrame, path: str, batch: str) -> None:
    """The partition of this batch: written again, as a stream does after a failure, it replaces only itself."""
    (
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    )


def _append(rows: DataFrame, path: str, batch: str | None, documents: DataFrame | None, arrived: datetime | None) -> None:
    if documents is None:
        documents = rows.select("doc_id").distinct()
    if arrived is None:
        arrived = datetime.now(timezone.utc)
    # A name that no reader takes for a number or a date.
    name = f"b-{batch or uuid.uuid4().hex}"
    of = versioned(documents).withColumn("arrived", F.coalesce("arrived", F.lit(arrived).cast("timestamp")))
    _write(rows.sortWithinPartitions("doc_id", "order_idx"), f"{path}/rows", name)
    stored = rows.sparkSession.read.parquet(f"{path}/rows").where(F.col("batch") == name)
    counts = stored.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    _write(of.join(counts, "doc_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))), f"{path}/heads", name)


def current_heads(heads: DataFrame) -> DataFrame:
    """Of each document the head that counts, deleted documents too."""
    newest = F.max(F.struct(*VERSION, "batch", "n_rows")).alias("h")
    return heads.groupBy("doc_id").agg(newest).select("doc_id", "h.*")


def visible(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows that a reader sees.

    Only heads are aggregated. Rows go by an anti-join with the heads that were
    overtaken, which are few beside them, and by batch, which prunes partitions.
    """
    now = heads.withColumn("key", F.struct(*VERSION, "batch"))
    best = now.groupBy("doc_id").agg(F.max("key").alias("best"), F.count("*").alias("n"))
    overtaken = now.join(best.where("n > 1"), "doc_id").where("key < best").select("doc_id", "batch")
    known = heads.select("batch").distinct()
    return rows.join(overtaken, ["doc_id", "batch"], "left_anti").join(known, "batch", "left_semi")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/heads")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return visible(*_tables(spark, path)).drop("batch")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, revision, arrived, batch, n_rows) of each document; zero rows where it was deleted."""
    return current_heads(spark.read.parquet(f"{path}/heads"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """What a reader sees as a new store of one batch, to be put in its place.

    Heads of deleted documents stay: an old revision that comes later must still lose.
    """
    rows, heads = _tables(spark, path)
    _write(visible(rows, heads).drop("batch"), f"{target}/rows", "compacted")
    _write(current_heads(heads).drop("batch"), f"{target}/heads", "compacted")


def clause_rows(clauses: DataFrame) -> DataFrame:
    """The rows that are stored."""
    return clauses.withColumn("clause_key", clause_key())


def write_clauses(
    clauses: DataFrame, path: str, batch: str | None = None, documents: DataFrame | None = None, arrived: datetime | None = None
) -> None:
    """Clause store; writing a document again replaces its rows for readers.

    `documents` (doc_id, and revision and arrived where there are such) names all
    documents of the batch. One without clauses loses those it had. Left out, the
    documents are those of the rows. `arrived` stands where a document brings none.
    """
    _append(clause_rows(clauses), path, batch, documents, arrived)


def analysis_rows(
    clauses: DataFrame, analyses: DataFrame, scores: DataFrame, model: str, prompt_version: str
) -> DataFrame:
    """Analysed and scored clauses with provenance; anything lacking either is left out."""
    keys = ["doc_id", "order_idx"]
    return (
        clauses.select(*keys)
        .join(analyses, keys)
        .join(scores, keys)
        .withColumn("clause_key", clause_key())
        .withColumn("model", F.lit(model))
        .withColumn("prompt_version", F.lit(prompt_version))
    )


def write_analyses(
    rows: DataFrame, path: str, batch: str | None = None, documents: DataFrame | None = None, arrived: datetime | None = None
) -> None:
    """The same sink. `documents` are best the heads of the clauses that were analysed."""
    _append(rows, path, batch, documents, arrived)


def read_analyses(spark: SparkSession, path: str, clauses: str) -> DataFrame:
    """The analyses of the clauses that are now in the store at `clauses`.

    Those of an overtaken or deleted revision are not seen, as writing clauses
    deletes their analyses.
    """
    rows, heads = _tables(spark, path)
    shown = current_heads(heads).select("doc_id", *[F.col(v).alias(f"_{v}") for v in VERSION])
    held = read_heads(spark, clauses).where("n_rows > 0").join(shown, "doc_id").where(
        " AND ".join(f"{v} <=> _{v}" for v in VERSION)).select("doc_id")
    return visible(rows, heads).drop("batch").join(held, "doc_id", "left_semi")


def clauses_with_analyses(clauses: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every clause, with its analysis where there is one."""
    return clauses.join(analyses, ["doc_id", "order_idx"], "left")


def claim_side_clauses(joined: DataFrame) -> DataFrame:
    """Analysed clauses as a claim sees them; ids are given before headings go."""
    analysed = joined.filter("clause_type is not null")
    return (
        segment.citation_ids(analysed)
        .withColumn("page", F.col("page_start") + 1)
        .filter(~F.col("is_heading"))
    )


def fingerprint_audit(files: DataFrame, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """Binary files against a manifest (name, sha256): ok, changed, missing or extra.

    `name` is what the manifest calls a file, by default the last part of its path.
    """
    actual = files.select(
        (F.element_at(F.split("path", "/"), -1) if name is None else name).alias("name"),
        F.sha2("content", 256).alias("actual"),
        F.col("length").alias("bytes"),
    )
    expected = manifest.select("name", F.col("sha256").alias("expected"))
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("actual") == F.col("expected"), "ok")
        .otherwise("changed")
    )
    return expected.join(actual, "name", "full_outer").withColumn("status", status)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


CITATION_FIELDS = ["pos", "clause_id", "quote", "effect", "verified", "reason"]


def answer_rows(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per answered claim with its citations in order.

    Citations per answer are few: the model is held to a handful.
    """
    packed = citations.groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct(*CITATION_FIELDS))).alias("citations")
    )
    empty = F.array().cast(packed.schema["citations"].dataType)
    return (
        answers.join(packed.hint("merge"), "answer_id", "left")
        .withColumn("citations", F.coalesce("citations", empty))
    )


def append_answers(rows: DataFrame, path: str) -> None:
    """Append sink."""
    rows.write.mode("append").parquet(path)
