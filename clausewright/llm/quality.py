"""Quality rules by distribution divergence.

Each document gives two histograms: characters by class, and common words. The
sums over all documents of a language that pass the base rule are the reference
of that language; a document is rejected where the Jensen-Shannon distance of
one of its histograms to the reference is too large. A histogram of few
observations is far from any reference by chance, so a minimum length guards
each comparison and the limit falls with the number of observations. A language
of few documents or characters is no reference by itself, as a document would
be compared with little but itself: characters are compared with the sums over
all languages, words with those of the language without the document, and the
limit rises with the noise of that smaller sum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import common

# Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = b"#*$%&|<>"

# Common words of the languages the references are for. One list serves all
# documents: words of another language are as telling as missing ones.
COMMON = (
    "the of and to in a is that for on with as was it be by are this from at or an not have "
    "de la le les et des en un une du que est pour dans qui par sur au pas plus ne se son "
    "el los las y del una con no por su para al lo como más pero sus o es "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch an werden aus er"
).split()


@dataclass(frozen=True)
class Limits:
    """Distances (square root of the divergence in bits) that a document may have, and the guards.

    With n observations the limit is the distance plus the noise over the root of n.
    """

    chars: float = 0.26
    chars_noise: float = 1.5
    words: float = 0.20
    words_noise: float = 2.4
    min_chars: int = 200
    min_words: int = 50
    # References a task holds; those of further languages come with the rows by a join.
    max_languages: int = 200
    # A language is a whole reference from so many documents and characters on.
    least_documents: int = 20
    least_chars: int = 20_000


CLASSES = 14


def _class_table() -> np.ndarray:
    """Class of a byte; bytes inside a code point have none (-1 as 15)."""
    out = np.full(256, 11, dtype=np.uint8)  # other controls and ASCII
    for c in range(256):
        ch = chr(c)
        if 97 <= c <= 122:
            out[c] = 0 if ch in "aeiou" else 1
        elif 65 <= c <= 90:
            out[c] = 2
        elif 48 <= c <= 57:
            out[c] = 3
        elif ch == " ":
            out[c] = 4
        elif ch in "\n\r":
            out[c] = 5
        elif ch in ".,":
            out[c] = 6
        elif ch in "!?":
            out[c] = 7
        elif ch in ";:'\"()-":
            out[c] = 8
        elif ch in "#*$%&|<>":
            out[c] = 9
        elif ch in "@/\\_=+[]{}~^`":
            out[c] = 10
        elif 0x80 <= c <= 0xBF:
            out[c] = 15
        elif 0xC3 <= c <= 0xC9:
            out[c] = 12  # Latin letters with marks
        elif c > 0xBF:
            out[c] = 13
    return out


_CLASS = _class_table()
_CODE_POINT = np.array([not 0x80 <= c <= 0xBF for c in range(256)], dtype=np.int64)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_SYMBOL = np.array([c in SYMBOLS for c in range(256)], dtype=np.int64)
_NUMBER = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON))}
WORDS = len(_NUMBER) + 1
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else (c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def _repeated(tokens: list[bytes]) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    if len(tokens) < 4:
        return 0
    number = dict.fromkeys(tokens)
    if len(number) == len(tokens):
        return 0
    for i, t in enumerate(number):
        number[t] = i
    ids = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    kinds = len(number)
    pairs = ids[:-2] * kinds + ids[1:-1]
    if kinds >= 1 << 21:  # three numbers would not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triple = pairs * kinds + ids[2:]
    ordered = np.sort(triple)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    twice = again[np.minimum(np.searchsorted(again, triple), len(again) - 1)] == triple
    inside = np.zeros(len(tokens), dtype=bool)
    for k in range(3):
        inside[k : len(tokens) - 2 + k] |= twice
    return int(inside.sum())


def _features(data: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), characters by class, common words."""
    view = np.frombuffer(data, dtype=np.uint8)
    by_byte = np.bincount(view, minlength=256)
    tokens = data.split()  # of bytes: at the six ASCII spaces only
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    base = [
        len(tokens),
        int((by_byte * _CODE_POINT)[~_SPACE].sum()),
        int((by_byte * _SYMBOL).sum()),
        len(lines) - len(set(lines)),
        _repeated(tokens),
    ]
    chars = np.bincount(_CLASS, weights=by_byte, minlength=16)[:CLASSES]
    plain = data.translate(_PLAIN).split()
    other = WORDS - 1
    words = np.bincount([_NUMBER.get(w, other) for w in plain] or [other], minlength=WORDS)
    if not plain:
        words[other] = 0
    return base, chars, words.astype(np.float64)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance: the root of the divergence in bits, 0 to 1."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


Sums = tuple[np.ndarray, np.ndarray, float]


def _sums(v) -> Sums:
    """Characters, words and the number of documents."""
    v = np.array(v, dtype=np.float64)
    return v[:CLASSES], v[CLASSES : CLASSES + WORDS], float(v[-1])


@dataclass
class Reference:
    """Sums of each language, and of all documents for rows without a language.

    `further` has (l, sums) of the languages that `by_language` leaves out, if there are any.
    """

    by_language: dict[str, Sums] = field(default_factory=dict)
    overall: Sums | None = None
    further: DataFrame | None = None


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _histograms(texts: pa.Array) -> pa.Array:
    """Both histograms in one row, and a last 1; null where the base rule fails."""
    out = []
    for part in common.chunks(texts):
        for data in part:
            base, chars, words = _features(data)
            out.append(None if base_failed(base[0], base[4]) else [*chars, *words, 1.0])
    return pa.array(out, pa.list_(pa.float64()))


def reference(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> Reference:
    """Summed over all documents; at most `max_languages` rows of fixed width reach the driver.

    The references of all other languages stay a table, for a join.
    """
    common.bounded_batches(docs.sparkSession)
    n = CLASSES + WORDS + 1
    # Sums pass over null histograms; a filter on them would run Python a second time, in workers of its own.
    rows = docs.select(F.col(lang).cast("string").alias("l"), _histograms(F.col(text)).alias("h"))
    sums = rows.groupBy("l").agg(*[F.sum(F.col("h")[i]).alias(f"h{i}") for i in range(n)]).where(f"h{n - 1} is not null")
    sums = common.stored(sums, "quality-reference")
    total = sums.agg(*[F.sum(f"h{i}") for i in range(n)]).first()
    if total[n - 1] is None:
        return Reference()

    own = sums.where("l is not null")
    top = own.orderBy(F.desc(f"h{n - 1}"), "l").limit(limits.max_languages + 1).collect()
    held = {r["l"]: _sums(r[1:]) for r in top[: limits.max_languages]}
    further = None
    if len(top) > limits.max_languages:
        further = own.where(~F.col("l").isin(*held)).select("l", F.array(*[f"h{i}" for i in range(n)]).alias("sums"))
    return Reference(held, _sums(total), further)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]


def judge(data: bytes, own: Sums | None, overall: Sums | None, limits: Limits = Limits()) -> tuple:
    """The fields of a text, `own` being the sums of its language (None: it has none)."""
    base, chars, words = _features(data)
    failed = base_failed(base[0], base[4])
    few = own is not None and (own[2] < limits.least_documents or own[0].sum() < limits.least_chars)
    whole = overall if few or own is None else own
    to_chars, to_words = (None, None) if whole is None else whole[:2]
    if few:
        to_words = own[1] if failed else own[1] - words
    kept, found = not failed, []
    sides = (
        (chars, to_chars, limits.chars, limits.chars_noise, limits.min_chars),
        (words, to_words, limits.words, limits.words_noise, limits.min_words),
    )
    for mine, other, most, noise, least in sides:
        n = mine.sum()
        d = None
        if other is not None and n >= least and other.sum() > 0 and not (few and other is to_words and other.sum() < least):
            d = distance(mine, other)
            rest = 1 / other.sum() if few and other is to_words else 0
            kept = kept and d <= most + noise * np.sqrt(1 / n + rest)
        found.append(d)
    return (*base, failed, *found, kept)


def score(
    docs: DataFrame, ref: Reference, text: str = "text", lang: str = "lang", limits: Limits = Limits(),
) -> DataFrame:
    """`docs` with the base counts, both distances (null under the guard) and the verdict `kept`.

    A null text counts as empty and fails the base rule; a null or unknown
    language is compared with all documents. Columns named as a result give way.
    """
    common.bounded_batches(docs.sparkSession)
    kind = T.StructType([
        *[T.StructField(f, T.LongType()) for f in FIELDS[:5]], T.StructField(FIELDS[5], T.BooleanType()),
        T.StructField(FIELDS[6], T.DoubleType()), T.StructField(FIELDS[7], T.DoubleType()),
        T.StructField(FIELDS[8], T.BooleanType()),
    ])

    held, overall = ref.by_language, ref.overall

    @F.arrow_udf(kind)
    def verdicts(texts: pa.Array, langs: pa.Array, sums: pa.Array) -> pa.Array:
        rows, names = [], langs.to_pylist()
        for part in common.chunks(texts):
            for data in part:
                joined = sums[len(rows)].as_py()
                own = held.get(names[len(rows)]) if joined is None else _sums(joined)
                rows.append(judge(data, own, overall, limits))
        columns = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], FIELDS)

    def judged(rows: DataFrame, sums: Column) -> DataFrame:
        result: Column = verdicts(F.col(text), F.col(lang).cast("string"), sums.cast("array<double>"))
        return common.attach(rows, result, FIELDS)

    if ref.further is None:
        return judged(docs, F.lit(None))
    here = F.col(lang).isNull() | F.col(lang).cast("string").isin(*held)
    name, joined = common.unused(docs, "lang"), common.unused(docs, "sums")
    table = ref.further.select(F.col("l").alias(name), F.col("sums").alias(joined))
    rest = docs.where(~here).join(table, F.col(lang).cast("string") == F.col(name), "left").drop(name)
    return judged(docs.where(here), F.lit(None)).unionByName(judged(rest, F.col(joined)).drop(joined))


def filter_quality(
    docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits(),
) -> DataFrame:
    """All rows with their verdicts, against references made from the same rows."""
    return score(docs, reference(docs, text, lang, limits), text, lang, limits)
