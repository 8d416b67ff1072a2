"""Matches of a pattern with their places, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
MATCH = "array<struct<start:int,end:int,hit:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, hit>>, in code points, end exclusive.

    The pattern must not match the empty string. What stands between matches
    comes from the same scan as a split, so the places are running sums of
    lengths, taken block by block: an array grows by one element only inside a
    block.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())  # the last gap has no match after it
    blocks = F.transform(
        F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK)), lambda i: F.slice(pairs, i, BLOCK))

    def step(held: Column, p: Column) -> Column:
        start = held["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(found)).alias("out"))

    def block(held: Column, part: Column) -> Column:
        empty = F.struct(held["at"].alias("at"), F.array().cast(MATCH).alias("out"))
        # Named once, used twice.
        inner = F.transform(F.array(F.aggregate(part, empty, step)), lambda v: F.struct(
            v["at"].alias("at"), F.concat(held["out"], F.array(v["out"])).alias("out")))
        return inner[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCH}>").alias("out"))
    found = F.flatten(F.aggregate(blocks, start, block)["out"])
    # A text without a match, the usual case, skips the rest.
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(MATCH))
