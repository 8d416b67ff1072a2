"""Building blocks that keep hot groups split.

One key may hold a third of all rows, so nothing here puts a whole group into
one task:

* `prefix_sum` and `previous` cut a group's order into blocks, work inside the
  blocks, and carry only one row per block across the group;
* `salted_join` leaves hot keys to adaptive execution, and salts on request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _same(left: DataFrame, right: DataFrame, keys) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
    spread: str | Column | None = None, salts: int | None = None,
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    By default a plain join: adaptive execution broadcasts a side that has turned
    out small and splits the partitions of a hot key. Where a key is measured to
    be too hot even for that, `salts` deals its left rows over so many tasks,
    told apart by `spread` (a row id), and repeats the right side once per salt;
    it should grow with the executors. `how` must keep the left side: inner,
    left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    if salts is None:
        return left.join(right, on, how)
    row = F.struct("*") if spread is None else (F.col(spread) if isinstance(spread, str) else spread)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The estimate does not see the copies: never broadcast them.
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def prefix_sum(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Exclusive running sum of `value` along the integer `order` of each group.

    `order` is unique within the group. A block is a range of `order`, so a
    task sees at most `block` rows of a group, and the carry is computed from
    one row per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    part = blocked.withColumn(
        out,
        F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_block")
    carry = totals.select(
        *keys, "_block",
        F.coalesce(
            F.sum("_total").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_carry"),
    )
    return (
        part.join(carry, [*keys, "_block"])
        .withColumn(out, F.col(out) + F.col("_carry"))
        .drop("_block", "_carry")
    )


def previous(
    df: DataFrame, keys: list[str], order: str, columns: list[str], block: Column,
    prefix: str = "previous_",
) -> DataFrame:
    """The columns of the row before, along `order`, without one task per group.

    `block` must not decrease along `order` (a day, a range of run numbers).
    """
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    row = F.struct(F.lit(True).alias("_seen"), *[F.col(c) for c in columns])
    lagged = blocked.withColumn("_prev", F.lag(row).over(inside))
    lasts = blocked.groupBy(*keys, "_block").agg(F.max_by(row, F.col(order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    carry = lasts.select(*keys, "_block", F.lag("_last").over(across).alias("_carry"))
    joined = lagged.join(carry, [*keys, "_block"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    for c in columns:
        joined = joined.withColumn(prefix + c, prev[c])
    return (
        joined.withColumn(f"has_{prefix.rstrip('_')}", prev.isNotNull())
        .drop("_block", "_prev", "_carry")
    )
