"""SimHash near-duplicates by multi-index hashing.

Fingerprints that differ in at most three of 64 bits agree, in one of their two
halves, up to one bit. Every distinct fingerprint is put into a table under both
halves; a search asks for the half itself and for the halves one bit away, and
the complete distance of each match is verified in the join. Of two halves one
bit apart just one lacks the bit, so only set bits are tried: half of the ball.

Equal fingerprints meet before any search, so a group of copies costs one row.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import common, graph

SHINGLE = 3
DISTANCE = 3
SEED = 42
# Fixed value: A-Z to a-z, other bytes as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 15


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64 bits of UTF-8 bytes; 0 without a word. A text of fewer words is one shingle."""
    tokens = data.translate(FOLD).split()  # of bytes: at the six ASCII spaces only
    if not tokens:
        return 0
    n = max(1, len(tokens) - shingle + 1)
    parts = map(b" ".join, zip(*(tokens[k:] for k in range(shingle)), strict=False)) if len(tokens) >= shingle else iter([b" ".join(tokens)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=n)
    return of_hashes(hashes)


def of_hashes(hashes: np.ndarray) -> int:
    """64 bits of the hashes of shingles; 0 of none."""
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[k : k + _BLOCK].astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = [fingerprint(data) for part in common.chunks(texts) for data in part]
    return pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint as a 64-bit number (null: as empty). A column of that name gives way."""
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _fingerprints(F.col(text)))


def links(distinct: DataFrame, column: str = "fp", distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most `distance` bits apart, each once or twice.

    `distance` is at most 3: two halves and one bit of ball.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of one bit reach distance 3")
    halves = F.array(F.shiftrightunsigned(column, 32), F.col(column).bitwiseAND(F.lit(2**32 - 1)))
    rows = distinct.select(F.col(column).alias("fp"), F.posexplode(halves).alias("half", "key"))
    # The key itself, and the key with each bit set that it lacks.
    ball = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
        lambda bit: F.col("key").bitwiseAND(bit) == 0,
    )
    probes = rows.select(
        F.col("fp").alias("a"), "half", F.col("key").alias("own"),
        F.explode(F.concat(F.array("key"), F.transform(ball, lambda bit: F.col("key").bitwiseOR(bit)))).alias("key"),
    )
    table = rows.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    once = (F.col("own") != F.col("key")) | (F.col("a") < F.col("b"))
    return (
        # Both sides grow with the input.
        probes.hint("merge").join(table, ["half", "key"]).where(near & once).select("a", "b")
    )


def groups(fingerprints: DataFrame, doc_id: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """(fingerprint, component_id) of every distinct fingerprint: the least id that its links reach.

    Rows without an id take part in linking and never give a group its name; a
    group of such rows only has a null name.
    """
    nodes = common.stored(
        fingerprints.groupBy(F.col(column).alias("fp")).agg(F.min(doc_id).alias("least")), "simhash-nodes")
    roots = graph.components(common.stored(links(nodes), "simhash-links"))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min_by("fp", "least").alias("keeper"))
    return rooted.join(names, "root").select(F.col("fp").alias(column), "component_id", "keeper")


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of `docs`."""
    found = common.stored(with_fingerprint(docs.select(doc_id, text), text).select(doc_id, "fingerprint"), "simhash")
    return found.join(groups(found, doc_id), "fingerprint").select(
        doc_id, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group the one with the least id, with all its columns.

    Of rows that repeat an id and a fingerprint one stays.
    """
    own, kept, least = (common.unused(docs, c) for c in ("fingerprint", "kept", "least"))
    marked = with_fingerprint(docs, text, own)
    found = common.stored(marked.select(F.col(doc_id).alias("_id"), F.col(own).alias("fingerprint")), "simhash")
    keep = (
        groups(found, "_id").where(F.col("fingerprint") == F.coalesce("keeper", "fingerprint"))
        .select(F.col("fingerprint").alias(kept), F.col("component_id").alias(least))
    )
    rows = marked.join(keep, (F.col(own) == F.col(kept)) & F.col(doc_id).eqNullSafe(F.col(least)), "left_semi")
    return rows.dropDuplicates([doc_id, own]).drop(own)
