"""Secrets: fixed patterns, and strings that look random to a pair of Markov models.

Two character models, of random strings and of ordinary identifiers, are trained
from labelled samples: transition counts between 64 character classes. A long
token whose log-likelihood ratio per character is high is a secret too. All of
it is DataFrame functions; the models are one constant array of 4,096 numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm import common, spans

# The base patterns, the least length of what they find, and the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "random"]

# Tokens that the models judge, and the ratio per character (nats) from which one is a secret.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.9
# The training reads the documents of least id hash, at most so many.
MAX_DOCUMENTS = 20_000
IDENTIFIER = r"[A-Za-z][A-Za-z_]{7,}"

_CLASSES = 64
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_CODES = [_ALPHABET.find(chr(c)) if chr(c) in _ALPHABET else _CLASSES - 1 for c in range(128)]

SPAN = "array<struct<start:int,end:int,kind:string>>"


def _constant(values: list, kind: str) -> Column:
    """An array as one literal: a list of numbers in a string, which the optimiser folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _classes(token: Column) -> Column:
    return F.transform(
        F.filter(F.split(token, ""), lambda c: c != ""),
        lambda c: F.coalesce(F.get(_constant(_CODES, "int"), F.ascii(c)), F.lit(_CLASSES - 1)))


def _transitions(token: Column) -> Column:
    """Numbers of the class pairs of neighbouring characters."""
    codes = _classes(token)
    return F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: a * _CLASSES + b)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns: array<struct<start, end, kind>>, by start and then kind as listed."""
    def of(kind: str, pattern: str, keep) -> Column:
        return F.transform(F.filter(spans.matches(text, pattern), keep), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    # A run of 32 begins where a run begins, so the shorter runs need not be listed first.
    parts = [
        of("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= LEAST["assign"]),
        of("access", ACCESS, lambda m: F.length(m["hit"]) >= LEAST["access"]),
        of("hex", HEX[:-1] + "{%d,}" % LEAST["hex"], lambda m: F.length(m["hit"]) >= LEAST["hex"]),
    ]
    return _ordered(F.concat(*parts))


def _ordered(found: Column) -> Column:
    rank = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    keyed = F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Labelled strings (value, secret): what the base patterns find, and ordinary words of the same documents.

    Read from at most `max_documents` documents, those of least id hash; rows
    without an id or text give none.
    """
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).where("t is not null and _id is not null")
    chosen = own.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(max_documents).distinct()
    rows = common.stored(own.join(F.broadcast(chosen), "_id").select("t"), "secret-samples")
    secret = F.concat(
        F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST["assign"]),
        F.filter(F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), lambda v: F.length(v) >= LEAST["access"]),
        F.regexp_extract_all("t", F.lit(HEX[:-1] + "{%d,}" % LEAST["hex"]), F.lit(0)),
    )
    plain = F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0))
    return rows.select(F.explode(secret).alias("value"), F.lit(True).alias("secret")).union(
        rows.select(F.explode(plain).alias("value"), F.lit(False).alias("secret")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of all class transitions, random over ordinary, from rows (value, secret).

    Half of the random side is uniform, as keys of other alphabets are random
    too. At most 8,192 counts reach the driver.
    """
    pairs = labelled.where("value is not null and secret is not null").select(
        "secret", F.explode(_transitions(F.col("value"))).alias("pair"))
    counts = {True: [0.0] * _CLASSES**2, False: [0.0] * _CLASSES**2}
    for r in pairs.groupBy("secret", "pair").count().collect():
        counts[r["secret"]][r["pair"]] = float(r["count"])
    out = []
    for a in range(_CLASSES):
        random, plain = (counts[k][a * _CLASSES : (a + 1) * _CLASSES] for k in (True, False))
        total, base = sum(random), sum(plain)
        for b in range(_CLASSES):
            seen = random[b] / total if total else 1 / _CLASSES
            p = 0.5 / _CLASSES + 0.5 * seen
            q = (plain[b] + 0.5) / (base + 0.5 * _CLASSES)
            out.append(round(math.log(p / q), 5))
    return out


def random_spans(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Spans of kind random: tokens whose ratio per transition is at least `threshold`."""
    ratios = _constant(model, "double")

    def ratio(token: Column) -> Column:
        total = F.aggregate(_transitions(token), F.lit(0.0), lambda s, p: s + F.get(ratios, p))
        return total / (F.length(token) - 1)

    return F.transform(
        F.filter(spans.matches(text, TOKEN), lambda m: ratio(m["hit"]) >= threshold),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("random").alias("kind")))


def find(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with base_spans and spans (the base ones and, where they overlap none, the random ones).

    Code points, end exclusive. A null or empty text has none. Columns named as
    a result give way.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop("base_spans", "spans").withColumn("base_spans", base_spans(body))
    return out.withColumn("_random", random_spans(body, model, threshold)).withColumn(
        "spans", F.when(F.size("_random") == 0, F.col("base_spans")).otherwise(_ordered(F.concat(
            "base_spans", F.filter("_random", lambda r: ~F.exists(
                "base_spans", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))))
    ).drop("_random")


def _joined(found: str) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        doc_id, count("assign"), count("access"), count("hex"),
        F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
