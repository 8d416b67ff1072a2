"""Near-duplicates by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Operator 8 goes first: fingerprints of the shingles at most three bits apart make
candidates (`simhash.links`). Texts at similarity 0.8 differ by more bits than its index
reaches, so bands bring the rest.

Candidates beyond it share a band: a hash of six minima of the set under six keyed
permutations. With 32 bands a pair at exactly 0.8 shares one with probability
0.99994, a pair at 0.9 with 1 - 2e-11. Every link is verified on the whole sets, in
integers, so nothing below the limit is joined.

Texts of equal sets are one node. In each band the texts are first compared with
one of them, so a large group of copies costs one comparison a member. What is left
are bands that still hold different groups. Their texts meet again, exactly, by a
prefix filter: the shingles of a set are ordered by the number of these texts that
hold them, rarest first. Sets of similarity s share a shingle, the first that both
hold, after which each has room for the whole intersection that s demands. So a text
is filed under its first fifth of shingles, and the shorter of two under its first
ninth; what many texts share comes last and is a key only of texts that hold little
else. A bitmap of parities in the join tells most others apart. Texts of one group
are not compared again.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import common, graph, simhash

SHINGLE = 5
# The least similarity as a fraction, 4/5.
LEAST = (4, 5)
BANDS = 32
ROWS = 6
SEED = 42
_BLOCK = 1 << 12
_FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(data: bytes, words: int = SHINGLE) -> np.ndarray:
    """Different hashes of the word shingles of UTF-8 bytes, ascending. A text of fewer words is one shingle."""
    tokens = data.translate(simhash.FOLD).split()  # of bytes: at the six ASCII spaces only
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(tokens) - words + 1)
    parts = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)) if len(tokens) >= words else iter([b" ".join(tokens)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=n))


def node(found: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def bands(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), _BLOCK):
        least = np.minimum(least, (_FACTORS[:, None] * found[None, k : k + _BLOCK]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _signed(bits: int) -> int:
    """The number with these 64 bits as Spark holds it."""
    return bits - (1 << 64) if bits >> 63 else bits


_SIGNED = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType()),
])


@F.arrow_udf(_SIGNED)
def _signatures(texts: pa.Array) -> pa.Array:
    sets = (shingles(data) for part in common.chunks(texts) for data in part)
    rows = [(node(s), len(s), bands(s), _signed(simhash.of_hashes(s))) for s in sets]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "n", "bands", "fp"])


@F.arrow_udf(T.LongType())
def _nodes(texts: pa.Array) -> pa.Array:
    return pa.array([node(shingles(data)) for part in common.chunks(texts) for data in part], pa.int64())


def _node(text: Column) -> Column:
    """The node of a text, never null: for a key that may be, a join puts a filter below it, which runs Python once more."""
    return F.coalesce(_nodes(text), F.lit(0).cast("bigint"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sets(texts: pa.Array) -> pa.Array:
    found = [shingles(data).view(np.int64) for part in common.chunks(texts) for data in part]
    return pa.array(found, pa.list_(pa.int64()))


def _near_sizes() -> Column:
    """What sets of such sizes can reach: the smaller is the largest possible intersection."""
    least, of = LEAST
    return F.least("na", "nb") * of >= F.greatest("na", "nb") * least


def _prefixes(sets: DataFrame) -> DataFrame:
    """(key, node, n, rest): the shingles under which a set is filed, of those that two sets or more hold.

    `rest` is the number of shingles from this one on, in the order of their frequency.
    """
    least, of = LEAST
    held = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("key"))
    often = common.stored(held.groupBy("key").agg(F.count("*").alias("f")).where("f > 1"), "near-often")
    # Those that one set alone holds come first and are no keys: they only move the others back.
    own = held.hint("merge").join(often, "key").groupBy("node").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "key"))).alias("own"))
    return own.select("node", "n", F.size("own").alias("m"), F.posexplode("own").alias("at", "x")).select(
        F.col("x.key").alias("key"), "node", "n", (F.col("m") - F.col("at")).alias("rest")).where(
        F.col("rest") * of >= F.col("n") * least)


def _parity(shingles: Column) -> Column:
    """256 bits as four numbers: bit h of a set is the parity of its shingles that end in h."""
    def word(k: int) -> Column:
        own = F.filter(shingles, lambda s: F.shiftright(s, 6).bitwiseAND(F.lit(3)) == k)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda held, s: held.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), s.bitwiseAND(F.lit(63)).cast("int"))))

    return F.array(*[word(k) for k in range(4)])


def _prefix_pairs(filed: DataFrame) -> DataFrame:
    """The pairs (a, b) of different groups that may have the similarity, from (key, node, n, rest, root, parity).

    Each bit in which two parities differ is a shingle that one of the sets lacks.
    """
    least, of = LEAST

    def side(x: str) -> DataFrame:
        return filed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "rest", "root", "parity")])

    differ = sum((F.bit_count(F.col("parity_a")[k].bitwiseXOR(F.col("parity_b")[k])) for k in range(4)), F.lit(0))
    shorter = side("a").where(F.col("rest_a") * (least + of) >= F.col("n_a") * 2 * least)
    return (
        shorter.hint("merge").join(side("b"), "key").where("root_a <> root_b")
        .where("n_a < n_b or (n_a = n_b and node_a < node_b)")
        .where(F.least("rest_a", "rest_b") * (least + of) >= (F.col("n_a") + F.col("n_b")) * least)
        .where(differ * (least + of) <= (F.col("n_a") + F.col("n_b")) * (of - least))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity: i / (na + nb - i) >= least / of."""
    least, of = LEAST
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        .where(both * (of + least) >= (F.size("sa") + F.size("sb")) * least).select("a", "b"))


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that operator 8 links: each set with the least of its fingerprint, and those of near fingerprints."""
    # A set without a shingle has no similarity to any other.
    some = nodes.where("n > 0")
    hubs = common.stored(some.groupBy("fp").agg(
        F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("most")), "near-prints")
    same = some.join(hubs.where("hub.node < most").hint("merge"), "fp").where("node <> hub.node").select(
        F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"))
    at = lambda x: hubs.select(F.col("fp").alias(x), F.col("hub.node").alias(f"_{x}"), F.col("hub.n").alias(f"n{x}")).hint("merge")
    near = simhash.links(hubs).distinct().join(at("a"), "a").join(at("b"), "b").select(
        F.col("_a").alias("a"), F.col("_b").alias("b"), "na", "nb")
    return same.union(near).where(_near_sizes()).select("a", "b")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = graph.components(links).withColumnRenamed("node", "_linked")
    return nodes.join(roots, F.col("node") == F.col("_linked"), "left").withColumn(
        "root", F.coalesce("root", "node")).drop("_linked")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, least, root) of every different set: texts of one root are joined by links.

    `least` is the least id of the node's rows, null where none has an id.
    """
    common.bounded_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    signed = common.stored(own.withColumn("s", _signatures("t")).select("id", "s.*"), "near")
    nodes = common.stored(signed.groupBy("node").agg(
        F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "near-nodes")
    printed = common.stored(_fingerprint_pairs(nodes), "near-printed")
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("most")).where("hub.node < most")
    shared = common.stored(
        rows.join(hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("n_hub")), "key"), "near-shared")
    star = common.stored(
        shared.where("node <> hub").select(
            F.col("node").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("n_hub").alias("nb"))
        .where(_near_sizes()).select("a", "b").union(printed).distinct(), "near-star")
    # The sets of the texts that share a band or a fingerprint with another; one row of a node is enough.
    met = shared.select("node").union(printed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = met.join(nodes.select("node", "least"), "node").select(
        F.col("node").alias("_node"), "least")
    sets = common.stored(
        own.join(wanted.select("least").distinct(), F.col("id").eqNullSafe(F.col("least")), "left_semi")
        .withColumn("set", _sets("t")).withColumn("node", _node(F.col("t"))).select("node", "set")
        .join(wanted, F.col("node") == F.col("_node"), "left_semi").groupBy("node").agg(F.first("set").alias("set")), "near-sets")
    links = common.stored(_verified(star, sets), "near-links")
    parted = common.stored(_roots(met, links), "near-parted")
    placed = common.stored(shared.select("key", "node", "n").join(parted, "node"), "near-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    left = common.stored(
        placed.join(mixed, "key", "left_semi").select("node", "root").distinct().join(sets, "node"), "near-left")
    filed = common.stored(_prefixes(left).join(
        left.select("node", "root", _parity(F.col("set")).alias("parity")), "node"), "near-filed")
    across = common.stored(_prefix_pairs(filed), "near-across")
    more = common.stored(_verified(across, sets), "near-more")
    return _roots(nodes.select("node", "least"), links.union(more))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group the one with the least id, with all its columns.

    Of rows that repeat an id and a set of shingles one stays; of a group without any id one row does.
    """
    found = groups(docs, doc_id, text)
    own, kept, first = (common.unused(docs, c) for c in ("node", "kept", "least"))
    keep = found.groupBy("root").agg(
        F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("first")).select(
        F.col("first.node").alias(kept), F.col("first.least").alias(first))
    marked = docs.withColumn(own, _node(F.col(f"`{text}`")))
    rows = marked.join(
        keep, (F.col(own) == F.col(kept)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(first)), "left_semi")
    return rows.dropDuplicates([doc_id, own]).drop(own)
