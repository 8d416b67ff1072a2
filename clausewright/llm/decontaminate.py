"""Benchmark decontamination: a broadcast hash set of the test n-grams, scanned by training windows.

The words of the benchmark become windows of `size` words (an item with fewer
words is one shorter window). Their 64-bit hashes go to every task; a training
text is hashed window by window with running sums, the few windows whose hash is
in the set are compared word by word, and what is left is a hit.

The broadcast is bounded: at most `max_windows` windows at a time. A larger
benchmark is dealt into blocks of items, and the documents pass through one scan
per block, in one job and without a shuffle, each scan adding its spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import common, words

WINDOW = 10
MAX_WINDOWS = 2_000_000
# The word characters and the letters that are folded.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)], dtype=np.int8)
_GRAM_BASE = 0xD6E8FEB86659FD93

SPAN = "struct<start:bigint,end:bigint,first:bigint,last:bigint>"
SCAN = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField(n, T.LongType()) for n in ("start", "end", "first", "last")]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


@dataclass
class Grams:
    """The windows of one block of items: sorted hashes by length, and the items of each window."""

    lengths: dict[int, np.ndarray]
    filters: dict[int, np.ndarray]
    items: dict[bytes, list[str]]


def _words_of(text: str | None) -> list[bytes]:
    data = (text or "").encode().translate(FOLD)
    starts, ends = words.split(np.frombuffer(data, dtype=np.uint8), _IS_WORD)
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    first = np.arange(max(0, len(hashes) - n + 1))
    return words.mix(words.ranges(first, first + n, hashes, _GRAM_BASE))


def build(rows, size: int = WINDOW) -> Grams:
    """Windows of (item_id, text) pairs. Items without words have none; one without an id hits unnamed."""
    items: dict[bytes, list[str]] = {}
    by_length: dict[int, list[bytes]] = {}
    for item, text in rows:
        found = _words_of(text)
        n = min(size, len(found))
        for i in range(len(found) - n + 1 if n else 0):
            gram = b" ".join(found[i : i + n])
            if gram not in items:
                items[gram] = []
                by_length.setdefault(n, []).append(gram)
            if item is not None and item not in items[gram]:
                items[gram].append(item)
    lengths, filters = {}, {}
    for n, grams in by_length.items():
        data = np.frombuffer(b"\n".join(grams), dtype=np.uint8)
        _, _, hashes = words.word_hashes(data, _IS_WORD, FOLD)
        keys = np.unique(_gram_hashes(hashes, n)[::n])
        bits = np.zeros(1 << 20, dtype=bool)
        bits[keys >> np.uint64(44)] = True
        lengths[n], filters[n] = keys, bits
    return Grams(lengths, filters, items)


def scan_texts(texts: pa.Array, grams: Grams, old_spans: list | None = None, old_items: list | None = None) -> list[dict]:
    """For each text: its number of words, the spans of hit words (bytes and word numbers), the items met."""
    out: list[dict] = []
    for part in common.chunks(texts):
        data = b"\n".join(part)
        view = np.frombuffer(data, dtype=np.uint8)
        sizes = np.array([len(x) for x in part], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        starts, ends, hashes = words.word_hashes(view, _IS_WORD, FOLD)
        first_word = np.searchsorted(starts, begin)
        bounds = np.append(first_word, len(starts))
        hits: dict[int, tuple[list, set]] = {}
        for n, keys in grams.lengths.items():
            if len(hashes) < n:
                continue
            windows = _gram_hashes(hashes, n)
            maybe = np.flatnonzero(grams.filters[n][windows >> np.uint64(44)])
            if not len(maybe):
                continue
            place = np.minimum(np.searchsorted(keys, windows[maybe]), len(keys) - 1)
            maybe = maybe[keys[place] == windows[maybe]]
            doc = np.searchsorted(first_word, maybe, side="right") - 1
            inside = maybe + n <= bounds[doc + 1]
            for w, d in zip(maybe[inside].tolist(), doc[inside].tolist(), strict=True):
                gram = b" ".join(
                    data[a:b] for a, b in zip(starts[w : w + n].tolist(), ends[w : w + n].tolist(), strict=True)
                ).translate(FOLD)
                if gram in grams.items:
                    spans, items = hits.setdefault(d, ([], set()))
                    spans.append((w, w + n))
                    items.update(grams.items[gram])
        for d in range(len(part)):
            k = len(out)
            low = int(bounds[d])
            spans, items = hits.get(d, ([], set()))
            # Spans of earlier blocks are in words of the document.
            spans = [(a - low, b - low) for a, b in spans]
            if old_spans is not None:
                spans += [(s["first"], s["last"]) for s in old_spans[k] or []]
                items = items | set(old_items[k] or [])
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            at = int(begin[d])
            out.append({
                "n_words": int(bounds[d + 1]) - low,
                "spans": [
                    {"start": int(starts[low + a]) - at, "end": int(ends[low + b - 1]) - at, "first": a, "last": b}
                    for a, b in merged
                ],
                "items": sorted(items),
            })
    return out


_STRUCT = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "first", "last")]))),
    ("items", pa.list_(pa.string())),
])


def _scanner(grams: Grams, again: bool):
    if again:

        @F.arrow_udf(SCAN)
        def scan_more(texts: pa.Array, old: pa.Array) -> pa.Array:
            return pa.array(
                scan_texts(texts, grams, old.field("spans").to_pylist(), old.field("items").to_pylist()), _STRUCT)

        return scan_more

    @F.arrow_udf(SCAN)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array(scan_texts(texts, grams), _STRUCT)

    return scan


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = WINDOW, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """`docs` with n_words, spans (hit words as byte and word ranges) and items (ids met, sorted as text).

    A null or empty text has no words and no hit; an empty benchmark hits nothing.
    Columns of `docs` named n_words, spans or items give way to the results.
    """
    common.bounded_batches(docs.sparkSession)
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    # An item has no more windows than half its bytes plus one.
    total = bench.agg(F.sum(F.octet_length("t") / 2 + 1)).first()[0] or 0
    blocks = int(total // max_windows) + 1
    hidden = "_scan"
    while hidden in docs.columns:
        hidden += "_"
    out = docs
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        grams = build(((r["i"], r["t"]) for r in part.toLocalIterator()), size)
        inputs = [F.col(text)] if b == 0 else [F.col(text), F.col(hidden)]
        out = out.withColumn(hidden, _scanner(grams, b > 0)(*inputs))
    result = F.col(hidden)
    return common.attach(out, result, ["n_words", "spans", "items"]).drop(hidden)


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for raw, cut in zip(texts.cast(pa.large_binary()).to_pylist(), spans.to_pylist(), strict=True):
        if raw is None or not cut:
            out.append(raw)
            continue
        at, kept = 0, []
        for s in cut:
            kept.append(raw[at : s["start"]])
            at = s["end"]
        kept.append(raw[at:])
        out.append(b"".join(kept))
    return pa.array(out, pa.binary()).cast(pa.string())


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """The texts of `scan` without their hit words; what stands between words stays outside a span."""
    return scanned.withColumn(text, _without(F.col(text), F.col("spans")))


def remove_documents(scanned: DataFrame) -> DataFrame:
    """The rows of `scan` without a hit."""
    return scanned.where(F.size("spans") == 0)


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return scanned.select(
        doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
