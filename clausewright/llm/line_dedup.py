"""Removal of lines that several documents share.

Lines are exploded with their position and normalised: the six ASCII spaces go at
both ends, A-Z become small. Two chained 64-bit hashes name a line from there on,
so that no text takes part in counting. A hash that `min_docs` different
documents hold is dropped everywhere but in the document of least id. The
positions that each text loses return to it, and what is left is joined in order.

A line that a third of all documents hold is counted in two steps, by (line,
document) first. Of M (line, document) pairs fewer than `HOT_PARTS` lines can hold
more than M / HOT_PARTS each: these alone are broadcast to the exploded lines;
every other line meets at most that share of the rows in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm import common

MIN_LENGTH = 10  # code points of a normalised line
MIN_DOCS = 2
HOT_PARTS = 10_000
SPACES = " \t\n\x0b\f\r"
_BIG, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["n_lines", "n_dropped", "kept"]


def line_key(line: Column) -> Column:
    return F.trim(F.translate(line, _BIG, _SMALL), F.lit(SPACES))


def keyed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, t1, t2, pos, h1, h2) of every line whose key is long enough; (id, t1, t2) names the row."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("t1"), F.hash(body).alias("t2"),
        F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    keys = lines.select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    return keys.select("id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_docs, first) of the lines that `min_docs` documents hold; rows without an id are one document.

    `first` is the least id; null only where no holder has one.
    """
    held = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("id").alias("first")).where(
        F.col("n_docs") >= min_docs)


def lost_positions(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, t1, t2, lost): the positions that each row loses."""
    goes = ~F.col("id").eqNullSafe(F.col("first"))
    hot_from = lines.count() / HOT_PARTS
    # Fewer than HOT_PARTS rows, as their counts add up to no more than all lines.
    hot = F.broadcast(shared.where(F.col("n_docs") > hot_from).select("h1", "h2", "first"))
    rest = shared.where(F.col("n_docs") <= hot_from).select("h1", "h2", "first")
    marked = lines.join(hot.withColumn("hot", F.lit(True)), ["h1", "h2"], "left")
    of_hot = marked.where("hot").where(goes).select("id", "t1", "t2", "pos")
    of_rest = marked.where("hot is null").drop("hot", "first").join(rest, ["h1", "h2"]).where(goes).select(
        "id", "t1", "t2", "pos")
    return of_hot.union(of_rest).groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("lost"))


def _without(text: Column, lost: Column) -> Column:
    """n_lines, n_dropped and the lines that stay; linear in the lines, as the difference of arrays hashes."""
    def joined(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(lost, F.array().cast("array<int>")))
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(stay)).cast("bigint").alias("n_dropped"),
            F.when(lost.isNull(), text).otherwise(
                F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).alias("kept"))

    # Bound as a lambda variable, so that the split is made once.
    return F.transform(F.array(F.split(text, "\n")), joined)[0]


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
           min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with n_lines, n_dropped and kept, the text without the lines that other documents hold.

    A null or empty text is one empty line. A line repeated inside one document
    only stays. Rows that repeat an id are one document; so are all rows without
    an id, which come after every id. An empty table gives an empty table.
    Input columns of the three names give way.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = common.stored(keyed_lines(docs, doc_id, text, min_length), "lines")
    shared = common.stored(shared_lines(lines, min_docs), "lines-shared")
    lost = lost_positions(lines, shared)
    # The input goes as one struct: its columns can't clash with those of the join.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("id"),
        F.xxhash64(body).alias("t1"), F.hash(body).alias("t2"))
    lost = lost.select(F.col("id").alias("lost_id"), F.col("t1").alias("lost_t1"), F.col("t2").alias("lost_t2"), "lost")
    met = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("t1") == F.col("lost_t1")) & (F.col("t2") == F.col("lost_t2")), "left")
    done = met.select("doc", _without(F.coalesce(F.col("doc")[text], F.lit("")), F.col("lost")).alias("r"))
    taken = set(FIELDS)
    return done.select(
        *[F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in taken], *[F.col("r")[f].alias(f) for f in FIELDS])
