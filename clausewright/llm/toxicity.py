"""Toxic passages by maximum-scoring segment search.

Training counts each token in the labelled documents with and without the label
(a document adds at most `PER_DOCUMENT` to a token). The log-odds of a token between the two, with a Dirichlet
prior in proportion to its overall frequency, is its score where it is
significant; every other token costs `drift`, so that a random text drifts down.
The beginnings of words are counted like words, and a word without a weight of
its own has that of its longest beginning, so that endings do not hide a stem.
A linear scan over the running sum finds all maximal scoring segments. Scores of
the best segment of clean documents follow an extreme-value law whose two
parameters are fitted to them; under it every segment has a p-value, the
significant ones are the passages, and the sum of their surprise, through a
logistic curve fitted to labelled documents, is the score of the document.

Weights and curves come from different documents: a third of the training rows
(by a hash of the id) is held back from the counts and used for the curves. Near
copies of one labelled document would lend their rare tokens a false weight, so
of the documents with the same label and the same least hash of five words one counts.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import common, words

# Bounds of the training, both documented parameters: labelled rows read, tokens kept by significance.
MAX_ROWS = 40_000
MAX_TOKENS = 20_000

PRIOR = 100.0
PRIOR_DOCUMENTS = 20.0
MIN_DOCUMENTS = 5
PER_DOCUMENT = 3
MIN_Z = 4.0
DRIFT = 0.15
P_VALUE = 0.05
SHORTEST, LONGEST = 3, 7  # code points of a beginning
CACHED = 300_000

# Letters in lower case; every other ASCII character separates tokens.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else (c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_IS_WORD = np.array([c != 32 for c in _PLAIN], dtype=np.int8)

PASSAGES = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("p", T.DoubleType())]))
FIELDS = ["score", "surprise", "n_passages", "passages"]


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0  # lambda of the extreme-value law
    size: float = 1.0  # K of it
    slope: float = 0.0
    bias: float = -20.0


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, after last) of a series, in order, in linear time.

    Only positive places can begin or extend a segment. Each open segment keeps
    the sums before and after it, and which earlier one has the nearest lower
    sum before it; a search steps along these and never looks at one twice.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    open_: list[tuple[float, float, int, int, int]] = []  # before, after, first, end, nearest lower
    for i in np.flatnonzero(scores > 0).tolist():
        before, after, first, end = float(sums[i]), float(sums[i + 1]), i, i + 1
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][0] >= before:
                j = open_[j][4]
            if j < 0 or open_[j][1] >= after:
                open_.append((before, after, first, end, j))
                break
            before, first = open_[j][0], open_[j][2]
            del open_[j:]
    return [(b - a, f, e) for a, b, f, e, _ in open_]


def tail(score: float, n: int, model: Model) -> float:
    """Natural logarithm of the chance that a clean text of n tokens has a segment of this score."""
    expected = math.log(model.size * max(n, 1)) - model.rate * score
    return min(0.0, expected) if expected < -30 else math.log(-math.expm1(-math.exp(min(expected, 30.0))) or 1e-300)


def _features(word: bytes) -> list[str]:
    """The word and its beginnings (marked by a star), the most telling first."""
    w = word.decode(errors="replace")
    return [w, *(w[:k] + "*" for k in range(min(LONGEST, len(w) - 1), SHORTEST - 1, -1))]


class _Weights(dict):
    """Weights by word, worked out once for each word; emptied when it has grown too much."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHED:
            self.clear()
        found = (self.model.weight[f] for f in _features(word) if f in self.model.weight)
        self[word] = value = next(found, -self.model.drift)
        return value


_weights: list[_Weights] = []


def _scan(data: bytes, model: Model) -> tuple[int, list[tuple[float, int, int]]]:
    if not _weights or _weights[0].model is not model:
        _weights[:] = [_Weights(model)]
    tokens = data.translate(_PLAIN).split()
    scores = np.fromiter(map(_weights[0].__getitem__, tokens), dtype=np.float64, count=len(tokens))
    return len(tokens), segments(scores)


def judge(data: bytes, model: Model) -> tuple[float, float, int, list[dict]]:
    n, found = _scan(data, model)
    passages, surprise = [], 0.0
    held = [(s, a, b, p) for s, a, b in found if (p := tail(s, n, model)) <= math.log(P_VALUE)]
    if held:
        starts, ends = words.split(np.frombuffer(data, dtype=np.uint8), _IS_WORD)
        passages = [
            {"start": int(starts[a]), "end": int(ends[b - 1]), "score": s, "p": math.exp(p)} for s, a, b, p in held]
        surprise = -sum(h[3] for h in held)
    elif found:
        surprise = -tail(max(found)[0], n, model)
    z = model.slope * math.log1p(surprise) + model.bias
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), surprise, len(passages), passages


_TYPE = pa.struct([
    ("score", pa.float64()), ("surprise", pa.float64()), ("n_passages", pa.int64()),
    ("passages", pa.list_(pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])))])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1), surprise, n_passages and passages (ranges of UTF-8 bytes).

    Nothing but the text is read. A null text is scored as an empty one. Columns
    named as a result give way.
    """
    common.bounded_batches(docs.sparkSession)

    @F.arrow_udf(T.StructType([
        T.StructField("score", T.DoubleType()), T.StructField("surprise", T.DoubleType()),
        T.StructField("n_passages", T.LongType()), T.StructField("passages", PASSAGES)]))
    def judged(texts: pa.Array) -> pa.Array:
        rows = [judge(data, model) for part in common.chunks(texts) for data in part]
        return pa.array([dict(zip(FIELDS, r, strict=True)) for r in rows], _TYPE)

    return common.attach(docs, judged(F.col(text)), FIELDS)


@F.arrow_udf(T.LongType())
def _sketch(texts: pa.Array) -> pa.Array:
    """The least hash of five words in a row: near copies mostly share it."""
    out = []
    for part in common.chunks(texts):
        for data in part:
            _, _, hashes = words.word_hashes(np.frombuffer(data, dtype=np.uint8), _IS_WORD, _PLAIN)
            first = np.arange(max(1, len(hashes) - 4))
            grams = words.mix(words.ranges(first, np.minimum(first + 5, len(hashes)), hashes))
            out.append(int(grams.min() >> np.uint64(1)))
    return pa.array(out, pa.int64())


def _document_tokens(batches):
    """(token, toxic, n, documents) of each batch; the empty token has the number of words."""
    for batch in batches:
        counts, holders = (Counter(), Counter()), (Counter(), Counter())
        flags = batch.column("toxic").to_pylist()
        k = 0
        for part in common.chunks(batch.column("text")):
            for data in part:
                own, flag = Counter(), flags[k]
                for w, n in Counter(data.translate(_PLAIN).split()).items():
                    for f in _features(w):
                        own[f] += n
                    own[""] += min(n, PER_DOCUMENT)
                holders[flag].update(own.keys())
                for f, n in own.items():
                    counts[flag][f] += min(n, PER_DOCUMENT) if f else n
                k += 1
        for flag, held in enumerate(counts):
            yield pa.record_batch({
                "token": pa.array(list(held), pa.string()),
                "toxic": pa.array([flag] * len(held), pa.int32()),
                "n": pa.array(list(held.values()), pa.int64()),
                "docs": pa.array([holders[flag][t] for t in held], pa.int64())})


def _fit_tail(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K from the tenth of clean texts with the highest best segments.

    Above a threshold the excess of an extreme-value law is exponential: its
    mean gives lambda, and the share of texts above the threshold gives K.
    """
    threshold = max(float(np.quantile(best, 0.9)), 0.0)
    above = best[best > threshold]
    if not len(above):
        return 1.0, 1.0 / max(1.0, float(n.mean()))
    rate = 1 / max(float((above - threshold).mean()), 1e-3)
    share = len(above) / (len(best) + 1)
    return rate, -math.log1p(-share) * math.exp(rate * threshold) / max(1.0, float(n.mean()))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and bias of a logistic curve, by damped Newton steps with a small ridge."""
    a, b = 1.0, -3.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([np.sum((p - y) * x) + 1e-2 * a, np.sum(p - y) + 1e-4 * b])
        h = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-4]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)), float(b)


def train(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text",
    toxic: str = "toxic", max_rows: int = MAX_ROWS, max_tokens: int = MAX_TOKENS,
) -> Model:
    """A model from the labelled documents for which `learn`, a condition on the labels, holds.

    At most `max_rows` labelled rows are read, those of least hash of the id,
    and at most `max_tokens` tokens kept, so that what is broadcast has a bound.
    Rows without a label, id or text are left out; of two labels of one id the
    higher counts. Without toxic or without clean rows all scores are near 0.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    marked = labels.where(learn if learn is not None else F.lit(True)).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(toxic).cast("int")).alias("toxic")).where("_id is not null and toxic in (0, 1)")
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = common.stored(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where("text is not null")
        .join(F.broadcast(chosen), "_id")  # at most max_rows rows of two numbers
        .select("toxic", "text", (F.pmod(F.xxhash64("_id", F.lit("curve")), F.lit(3)) == 0).alias("curve")),
        "toxicity-rows")
    counted = rows.where("not curve")
    counted = common.stored(
        counted.withColumn("first", _sketch("text")).groupBy("toxic", "first").agg(F.min("text").alias("text")), "toxicity-counted")
    def side(value: int, column: str) -> Column:
        return F.sum(F.when(F.col("toxic") == value, F.col(column)).otherwise(0))

    table = common.stored(
        counted.select("text", "toxic").mapInArrow(_document_tokens, "token string, toxic int, n bigint, docs bigint")
        .groupBy("token").agg(
            side(1, "n").alias("t"), side(0, "n").alias("c"), side(1, "docs").alias("dt"), side(0, "docs").alias("dc"))
        .where(F.col("dt") + F.col("dc") >= MIN_DOCUMENTS),
        "toxicity-tokens")
    sums = table.where("token = ''").first()
    if sums is None or not sums["t"] or not sums["c"]:
        return Model()

    def odds(toxic: str, clean: str, bad: float, good: float, worth: float) -> tuple[Column, Column]:
        """Log-odds under a prior in proportion to the token's share, worth so many observations; their z."""
        prior = worth * (F.col(toxic) + F.col(clean)) / (bad + good) + 0.01
        t, c = F.col(toxic) + prior, F.col(clean) + prior
        value = F.log(t / (bad + worth - t + 1)) - F.log(c / (good + worth - c + 1))
        return value, value / F.sqrt(1 / t + 1 / c)

    # The weight is of occurrences, the significance of documents, which one document can't move far.
    weight, _ = odds("t", "c", float(sums["t"]), float(sums["c"]), PRIOR)
    _, z = odds("dt", "dc", float(sums["dt"]), float(sums["dc"]), PRIOR_DOCUMENTS)
    table = table.select("token", weight.alias("odds"), z.alias("z"))
    top = (
        table.where((F.abs("z") >= MIN_Z) & (F.col("token") != ""))
        .orderBy(F.desc(F.abs("z")), "token").limit(max_tokens).collect()
    )
    model = Model({r["token"]: float(np.clip(r["odds"], -8, 8)) - DRIFT for r in top})

    @F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())]))
    def best(texts: pa.Array) -> pa.Array:
        found = [_scan(data, model) for part in common.chunks(texts) for data in part]
        return pa.StructArray.from_arrays([
            pa.array([n for n, _ in found], pa.int64()),
            pa.array([max((s for s, _, _ in f), default=0.0) for _, f in found], pa.float64())], ["n", "best"])

    curve = rows.where("curve")
    # At most max_rows rows of three numbers.
    seen = curve.select("toxic", best("text").alias("b")).select("toxic", "b.n", "b.best").toPandas()
    clean = seen[seen.toxic == 0]
    if not len(clean) or len(clean) == len(seen):
        return Model()
    model.rate, model.size = _fit_tail(clean.best.to_numpy(), clean.n.to_numpy())
    surprise = score(curve, model).select("toxic", "surprise").toPandas()
    model.slope, model.bias = _fit_curve(np.log1p(surprise.surprise.to_numpy()), surprise.toxic.to_numpy().astype(float))
    return model
