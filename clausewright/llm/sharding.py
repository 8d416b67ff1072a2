"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by a key of two 64-bit hashes: of the text, then of the whole
row. Equal texts so stand together, and a splitter falls inside such a group
only where the group alone outweighs the tolerance. Candidate boundaries are
probed in rounds: each round counts the bytes of every bucket of a finer grid
around the open splitters, over all partitions, and keeps the bucket in which
the target lies, until the bytes below a boundary are within the tolerance.
The driver holds `PROBES` counts for each open splitter and never a row.

The splitters are literals, so a row finds its shard by comparison, and the rows
move once: to the blocks in which their place in the shard is counted.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm import common

SHARDS = 8
TOLERANCE = 0.002
PROBE_BITS = 10
PROBES = 1 << PROBE_BITS
BLOCK_BITS = 6


@dataclass
class _Search:
    """A splitter under way: the level of the key, what is fixed of it, and the bytes below that."""

    target: float
    below: int = 0
    level: int = 0
    first: int | None = None  # the value of level 0, once it is fixed
    prefix: int = 0
    bits: int = 0
    found: tuple[int, int] | None = None


def _low(prefix: int, bits: int) -> int:
    """Least signed 64-bit number with these leading bits."""
    return (prefix << (64 - bits)) if bits else -(1 << 63)


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The first keys of shards 1, 2, ... from rows (k1, k2, size). Rows with equal keys can't be parted."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    searches = [_Search(total * i / shards) for i in range(1, shards)]
    while open_ := [s for s in searches if s.found is None]:
        asked = {(s.level, s.first, s.prefix, s.bits): s for s in open_}
        counts: dict[tuple, dict[int, int]] = {k: {} for k in asked}
        parts = []
        for n, (level, first, prefix, bits) in enumerate(asked):
            column = F.col("k1" if level == 0 else "k2")
            inside = F.lit(True) if level == 0 else F.col("k1") == first
            if bits:
                inside = inside & (F.shiftright(column, 64 - bits) == prefix)
            step = min(PROBE_BITS, 64 - bits)
            parts.append(F.when(inside, F.struct(
                F.lit(n).alias("ask"), F.shiftright(column, 64 - bits - step).alias("probe"))))
        keys = list(asked)
        rows = (
            sizes.select("size", F.explode(F.array_compact(F.array(*parts))).alias("at"))
            .groupBy("at.ask", "at.probe").agg(F.sum("size").alias("size"))
        )
        for r in rows.collect():  # at most PROBES rows for each open splitter
            counts[keys[r["ask"]]][r["probe"]] = r["size"]
        for s in open_:
            held = counts[(s.level, s.first, s.prefix, s.bits)]
            s.bits += min(PROBE_BITS, 64 - s.bits)
            probes = sorted(held)
            sums, below = [], s.below
            for p in probes:
                below += held[p]
                sums.append(below)
            at = min(bisect_left(sums, s.target), len(probes) - 1)
            if at < 0:  # no rows at all
                s.found = (-(1 << 63), -(1 << 63))
                continue
            high, low = sums[at], sums[at] - held[probes[at]]

            def boundary(probe: int, s: _Search = s) -> tuple[int, int]:
                edge = _low(probe, s.bits)
                return (edge, -(1 << 63)) if s.level == 0 else (s.first, edge)

            last = s.bits == 64 and s.level == 1
            if s.target - low <= slack or last and s.target - low <= high - s.target:
                s.found = boundary(probes[at])
            elif high - s.target <= slack or last:
                after = probes[at] + 1
                s.found = boundary(after) if after < 1 << (s.bits - 1) else ((1 << 63) - 1, (1 << 63) - 1)
            elif s.bits == 64:
                s.level, s.first, s.prefix, s.bits, s.below = 1, probes[at], 0, 0, low
            else:
                s.prefix, s.below = probes[at], low
    return sorted(s.found for s in searches)


def _before(key: tuple[int, int], k1: str, k2: str) -> Column:
    """Whether a row's key is at or after `key`."""
    return (F.col(k1) > key[0]) | ((F.col(k1) == key[0]) & (F.col(k2) >= key[1]))


def assign(
    docs: DataFrame, text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, identity: list[str] | None = None,
) -> DataFrame:
    """`docs` with size, shard and slot: byte sizes near equal, slots gapless from 0 in each shard.

    A size is the UTF-8 bytes of the text (null: none) plus one. `identity` are
    the columns, beside the text, that tell rows with equal texts apart (all
    others by default); rows equal in these stay in one shard, in any order.
    Columns named size, shard or slot give way.
    """
    docs = docs.drop("size", "shard", "slot")
    others = identity if identity is not None else [c for c in docs.columns if c != text]
    k1, k2, block, row, offset = (common.unused(docs, c) for c in ("k1", "k2", "block", "row", "offset"))
    rows = docs.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1,
        k1: F.xxhash64(text),
        k2: F.xxhash64(*[F.col(f"`{c}`") for c in others], F.lit(1)),
    })
    sizes = common.stored(rows.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "size"), "shard-sizes")
    # Without rows in between, shards may share a first key; the later ones are then empty.
    cuts = splitters(sizes, shards, tolerance)
    shard = sum((_before(k, k1, k2).cast("int") for k in cuts), F.lit(0))
    # Blocks of both hashes: a group of equal texts is spread, and the number of blocks is fixed.
    fine = F.shiftright(k1, 64 - BLOCK_BITS) * (1 << BLOCK_BITS) + F.shiftright(k2, 64 - BLOCK_BITS)
    placed = rows.withColumns({"shard": shard.cast("int"), block: fine})
    keyed = sizes.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).withColumns(
        {"shard": shard.cast("int"), block: fine})
    counts = keyed.groupBy("shard", block).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", block, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(offset))
    inside = Window.partitionBy("shard", block).orderBy(k1, k2)
    return (
        placed.withColumn(row, F.row_number().over(inside) - 1)
        # At most 4,096 blocks and one more for each splitter.
        .join(F.broadcast(offsets), ["shard", block])
        .withColumn("slot", (F.col(row) + F.col(offset)).cast("bigint"))
        .select(*[F.col(f"`{c}`") for c in rows.columns if c not in (k1, k2)], "shard", "slot")
    )


def write(assigned: DataFrame, path: str) -> None:
    """One folder per shard, as many files as tasks; a lost task writes its files again."""
    assigned.write.partitionBy("shard").parquet(path)
