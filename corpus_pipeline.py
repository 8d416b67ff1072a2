"""From documents to token ids: quality, near-duplicates, benchmark passages, personal data, encoding.

Each stage takes the documents that its predecessor kept and returns documents
with the same columns; the last returns ids. A stage is one operator of
`clausewright.llm` with its production parameters, over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import bpe, common, decontaminate, near, pii, quality

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _like(result: DataFrame, docs: DataFrame) -> DataFrame:
    return result.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: the base rule, or a histogram too far from those of the language."""
    return _like(quality.filter_quality(docs).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document of least id stays."""
    return _like(near.one_of_each(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    scanned = decontaminate.scan(docs, common.table(spark, sf_dir, "benchmark"))
    return _like(decontaminate.remove_documents(scanned), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; the number of characters follows the new text."""
    done = pii.replace(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn(
            "n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _like(done, docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to."""
    import public_tokenizers

    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    coded = bpe.round_trip(rows, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

# Histograms against trained references, fingerprints, keyed hashes and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of `sf_dir`; each result goes through Parquet."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
