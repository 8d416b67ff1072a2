"""Token counts behind a cache of digests.

A count is stored under the digest of the content and the digest of the
tokenizer file. Counting joins the digests of the input to the store, encodes
one copy of each content that the store lacks, appends those counts, and joins
again. The store is a Parquet folder on the shared file system; a lost task
writes its file again under the commit protocol of the sink.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import common
from clausewright.sources.shared import shared_folder

STORE = "content string, tokenizer string, n_tokens bigint"


@lru_cache(maxsize=4)
def _encoder(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _counter(path: str):
    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoder(path)
        out: list[int] = []
        for part in common.chunks(texts):
            out += encode([x.decode() for x in part])
        return pa.array(out, pa.int64())

    return count


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: library by file kind, and the bytes of its file."""
    with open(path, "rb") as f:
        return f"{path.rpartition('.')[2]}:{hashlib.sha256(f.read()).hexdigest()}"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts, one row for each pair of digests; a store that isn't there is empty."""
    try:
        rows = spark.read.schema(STORE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], STORE)
    return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, store: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, its texts counted through the store at `store`.

    Content is normalised only so far that the count can't change: null becomes
    empty. Repeated texts are encoded once. Two runs that add the same content at
    once leave two equal rows, which reading makes one. An input column
    n_tokens gives way.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    version = tokenizer_digest(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    known = read_store(spark, store).where(F.col("tokenizer") == version)
    # Copies meet inside each task before the exchange; the text of each content moves once.
    misses = (
        docs.select(F.sha2(content, 256).alias("content"), content.alias("t"))
        .groupBy("content").agg(F.first("t").alias("t"))
        .join(known, "content", "left_anti")
    )
    misses.select(
        "content", F.lit(version).alias("tokenizer"), _counter(tokenizer)("t").alias("n_tokens")
    ).write.mode("append").parquet(store)
    own, found = common.unused(docs, "content"), common.unused(docs, "counted")
    counts = (
        read_store(spark, store).where(F.col("tokenizer") == version)
        .select(F.col("content").alias(own), F.col("n_tokens").alias(found))
    )
    rows = docs.withColumn(own, F.sha2(content, 256)).join(counts, own, "left").drop(own)
    return rows.drop("n_tokens").withColumnRenamed(found, "n_tokens")


def shared_store(spark: SparkSession, tokenizer: str) -> str:
    """The store of a tokenizer's version in the folder that the cluster shares: the same for every run."""
    return f"{shared_folder(spark)}/token-counts-{hashlib.sha256(tokenizer_digest(tokenizer).encode()).hexdigest()[:16]}"
