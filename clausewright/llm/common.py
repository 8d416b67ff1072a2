"""What the operators share: input tables, shared scratch tables, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.sources.shared import BATCH_BYTES, bounded_batches, scratch, written_once  # noqa: F401

# Text that a Python worker handles at a time; a longer document is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: later work starts from the files."""
    return written_once(df, name)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    hidden = f"_{name}"
    while hidden in taken:
        hidden += "_"
    return hidden


def attach(df: DataFrame, result: Column, fields: list[str]) -> DataFrame:
    """`df` with the fields of a struct; an input column of the same name gives way."""
    hidden = unused(df, "result")
    taken = {f.lower() for f in fields}
    return df.withColumn(hidden, result).select(
        *[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken],
        *[F.col(hidden)[f].alias(f) for f in fields],
    )


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 bytes of a column (null: empty), in lists of about `limit` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    held: list[bytes] = []
    size = 0
    for value in texts.cast(pa.large_binary()):
        raw = value.as_buffer()
        data = b"" if raw is None else raw.to_pybytes()
        if held and size + len(data) > limit:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held
    # A worker is used again for other stages: what Arrow no longer needs goes back.
    pa.default_memory_pool().release_unused()
