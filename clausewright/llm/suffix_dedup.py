"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms of shards.

A window is a byte string of `LENGTH`. Every window belongs to one anchor: the
leftmost `GRAM`-byte string of least hash in it. Equal windows have equal
anchors at equal places, so windows need comparing only under one anchor hash,
and an anchor hash that occurs once has no repeated window. The windows of one
anchor in one text are neighbours; together they are a segment.

1. Segments (hash of the anchor, hash of the bytes, text, place) are made from
   every text; hashes that occur twice stay. Equal segments become one, with the
   number of its occurrences as weight.
2. The bytes of one segment of each kind go to the bucket of its anchor hash. An
   anchor with too many different segments is split by the place of the window
   around it: the windows of a half have more bytes in common, and these join the
   key. After a cut parts with equal bytes are one part, with their weights
   summed, and a part whose key has no other has no repeated window; both leave
   before the next cut. A table of numbers holds which part lies where in what
   it was cut from, so that what is found in a part comes back to all segments.
3. In a bucket the segments are dealt into shards. A shard sorts its own
   suffixes; each round then extends all suffixes by one symbol (`STEP` bytes) to
   the left. The interleave says, for each place of the merged order, which shard
   is next; reading the transforms of the shards through it and moving the places
   stably by symbol gives the interleave at the greater depth, while blocks of
   places that have agreed so far are cut where their symbols differ. No suffixes
   of two shards are ever compared or sorted together. Only suffixes that can
   still grow into a whole window are carried. After the last round a block is
   an interval of suffixes with a common prefix of `LENGTH` bytes; one of weight
   two or more is repeated.
4. The places of repeated windows return to all texts with the segment, and each
   text loses the bytes that they cover.

Texts are told apart by 96 bits of hash. Symbols are 64-bit hashes; a second hash
of the whole window must agree too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import common, words

LENGTH = 200
GRAM = 24
STEP = 25
BUCKET_BYTES = 3 << 18
SHARD_BYTES = 128 << 10
MAX_SEGMENTS = 2_000  # different segments of one anchor in one bucket
_BLOCK = 1 << 18
_AS_IS = bytes(range(256))
_OTHER_BASE = 0xC2B2AE3D27D4EB4F

def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of the bytes and place of each segment of a text.

    A place packs the first window, the distance from it to the anchor, and the
    number of windows less one.
    """
    parts = []
    # Blocks of windows; a segment that crosses two blocks becomes two.
    for low in range(0, len(data) - LENGTH + 1, _BLOCK):
        view = np.frombuffer(data, dtype=np.uint8)[low : low + _BLOCK + LENGTH - 1]
        values = words.byte_values(_AS_IS)[view]
        up, down = words.powers(words.BASE, len(view) + 1)
        sums = np.zeros(len(view) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(view)], out=sums[1:])
        start = np.arange(len(view) - GRAM + 1)
        grams = words.mix((sums[GRAM:] - sums[:-GRAM]) * down[start])
        # The least of a window by doubling; the place in the low bits makes it the leftmost.
        least = (grams >> np.uint64(24) << np.uint64(24)) | start.astype(np.uint64)
        wide, span = LENGTH - GRAM + 1, 1
        while 2 * span <= wide:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        count = np.diff(np.append(first, len(anchor)))
        anchor = anchor[first]
        seg = words.mix((sums[first + count + LENGTH - 1] - sums[first]) * down[first])
        place = (first + low) << 16 | (anchor - first) << 8 | (count - 1)
        parts.append((grams[anchor], seg, place))
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _segment_rows(batches):
    """(t1, t2, gram, seg, place) of every segment, as flat columns: no arrays to take apart."""
    for batch in batches:
        t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
        k = 0
        for part in common.chunks(batch.column("t")):
            found = [segments(data) for data in part]
            counts = [len(f[0]) for f in found]
            grams, segs, places = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            own = slice(k, k + len(part))
            k += len(part)
            yield pa.record_batch({
                "t1": pa.array(np.repeat(t1[own], counts)), "t2": pa.array(np.repeat(t2[own], counts)),
                "gram": pa.array(grams), "seg": pa.array(segs), "place": pa.array(places)})


def _gram_rows(batches):
    """The anchor hashes alone, for counting."""
    for batch in batches:
        for part in common.chunks(batch.column("t")):
            grams = np.concatenate([segments(data)[0] for data in part])
            yield pa.record_batch({"gram": pa.array(grams.view(np.int64))})


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _cut(texts: pa.Array, places: pa.Array) -> pa.Array:
    """The bytes of segments, by text and places."""
    out = []
    for raw, own in zip(texts.cast(pa.large_binary()).to_pylist(), places.to_pylist(), strict=True):
        out.append([raw[p >> 16 : (p >> 16) + (p & 255) + LENGTH] for p in own])
    return pa.array(out, pa.list_(pa.binary()))


def _stable(ids: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit numbers, by a counting pass over each half."""
    low = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")
    if len(ids) == 0 or ids.max() <= 0xFFFF:
        return low
    return low[np.argsort((ids >> 16).astype(np.uint16)[low], kind="stable")]


def repeated_windows(keys: np.ndarray, segs: list[bytes], weights: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each segment, which of its windows have weight two or more among the windows of the same key."""
    sizes = np.array([len(s) for s in segs], dtype=np.int64)
    counts = sizes - LENGTH + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(segs), dtype=np.uint8)
    values = words.byte_values(_AS_IS)[data]
    at = np.arange(len(data) - STEP + 1)
    symbols = np.unique(words.mix(words.ranges(at, at + STEP, values)), return_inverse=True)[1].astype(np.int32)
    # One element for each window: its start, the number of its segment and its shard.
    owner = np.repeat(np.arange(len(segs)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[owner]
    shard_of = (np.cumsum(sizes) - 1) // shard_bytes
    element = shard_of[owner]
    group = np.unique(keys, return_inverse=True)[1].astype(np.int32)[owner]
    # Depth 0: all suffixes of a key agree.
    shards = []
    for s in np.unique(element):
        own = np.flatnonzero(element == s)
        shards.append(own[_stable(group[own])])
    joined = np.concatenate(shards)
    order = _stable(group[joined])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s) for s in shards])[order]
    block = group[joined][order].astype(np.int64)
    symbol = np.empty(len(order), dtype=np.int32)
    for back in range(LENGTH - STEP, -1, -STEP):
        # The transform of each shard at this depth, what stands before its suffixes, read through the interleave.
        before = [symbols[window[own] + back] for own in shards]
        symbol[np.argsort(interleave, kind="stable")] = np.concatenate(before)
        shards = [own[_stable(b)] for own, b in zip(shards, before, strict=True)]
        order = _stable(symbol)
        interleave, block, symbol = interleave[order], block[order], symbol[order]
        cut = np.ones(len(order), dtype=bool)
        cut[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(cut)
    merged = np.empty(len(order), dtype=np.int64)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate(shards)
    # Blocks agree by eight symbol hashes; a second hash of the whole must agree as well.
    check = words.ranges(window, window + LENGTH, values, _OTHER_BASE)[merged]
    if len(check) and np.any((check[1:] != check[:-1]) & (block[1:] == block[:-1])):
        by = np.lexsort((check, block))
        merged, block, check = merged[by], block[by], check[by]
        block = np.cumsum(np.concatenate([[True], (block[1:] != block[:-1]) | (check[1:] != check[:-1])]))
    total = np.bincount(block, weights=weights[owner[merged]])
    out = np.zeros(len(merged), dtype=bool)
    out[merged] = total[block] >= 2
    return np.split(out, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true places, in turn."""
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    return np.flatnonzero(np.diff(padded)).tolist()


_RESULT = "gram bigint, seg bigint, runs array<int>"


def _bucket(table: pa.Table) -> pa.Table:
    segs = table.column("bytes").to_pylist()
    keys = table.column("gram").to_numpy()
    found = repeated_windows(keys, segs, table.column("n").to_numpy())
    keep, runs = [], []
    for i, flags in enumerate(found):
        own = _runs(flags)
        if own:
            keep.append(i)
            runs.append(own)
    rows = table.select(["gram", "seg"]).take(pa.array(keep, pa.int64()))
    return rows.append_column("runs", pa.array(runs, pa.list_(pa.int32())))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]


def _halves(rows: DataFrame) -> DataFrame:
    """Each part as two, with the anchor in the left and in the right half of the range; empty ones go.

    (near, far): least and greatest distance from a window to the anchor, as all
    parts of the key may have it; (low, high): as this one has it. `shift` is the
    place of the new part in the old one, named (gram, seg) as (from_gram, from_seg).
    """
    middle = ((F.col("near") + F.col("far")) / 2).cast("int")
    parts = F.array(
        F.struct(F.col("near").alias("near"), middle.alias("far")),
        F.struct((middle + 1).alias("near"), F.col("far").alias("far")))
    cut = rows.withColumn("p", F.explode(parts)).select(
        "gram", "seg", "n", "bytes", F.col("low").alias("l"), F.col("high").alias("h"), "p.near", "p.far",
        F.greatest("low", "p.near").alias("low"), F.least("high", "p.far").alias("high"),
    ).where("low <= high")
    shift = F.col("h") - F.col("high")
    cut = cut.withColumn("shift", shift).withColumn(
        "bytes", F.substring("bytes", F.col("shift") + 1, F.col("high") - F.col("low") + LENGTH))
    wide = F.col("far") - F.col("near")
    shared = F.substring("bytes", F.col("high") - F.col("far") + 1 + wide, LENGTH - wide)
    return cut.select(
        F.col("gram").alias("from_gram"), F.col("seg").alias("from_seg"), "shift", "n", "bytes", "low", "high", "near", "far",
        F.xxhash64("gram", "near", shared).alias("gram")).withColumn("seg", F.xxhash64("low", "high", "bytes"))


def _merged(rows: DataFrame) -> DataFrame:
    """(gram, seg, runs) of different segments (gram, seg, n, bytes, low, high), in one row or several."""
    rows = rows.select("gram", "seg", "n", "bytes", "low", "high", F.lit(0).alias("near"), F.lit(LENGTH - GRAM).alias("far"))
    found, origins = [], []
    while True:
        rows = common.stored(rows, "suffix-segments")
        keys = common.stored(rows.groupBy("gram").agg(F.count("*").alias("different"), F.sum("n").alias("weight")), "suffix-keys")
        large = common.stored(keys.where(F.col("different") > MAX_SEGMENTS).select("gram"), "suffix-large")
        some = not large.isEmpty()
        idle = keys.where((F.col("different") > MAX_SEGMENTS) | (F.col("weight") < 2)).select("gram")
        # Before the first cut every anchor occurs twice or more: nothing to leave out.
        small = rows.join(idle, "gram", "left_anti") if some or origins else rows
        size = small.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        buckets = int(size // BUCKET_BYTES) + 1
        found.append(
            small.select("gram", "seg", "n", "bytes", F.pmod("gram", F.lit(buckets)).alias("bucket"))
            .groupBy("bucket").applyInArrow(_bucket, _RESULT))
        if not some:
            break
        # A part of one window has a key of its own, which is never large: the cuts end.
        cut = common.stored(_halves(rows.join(large, "gram", "left_semi")), "suffix-cut")
        origins.append(cut.select("from_gram", "from_seg", "gram", "seg", "shift"))
        rows = cut.groupBy("gram", "seg").agg(F.sum("n").alias("n"), *[
            F.first(c).alias(c) for c in ("bytes", "low", "high", "near", "far")])
    out = found.pop()
    for origin in reversed(origins):
        back = origin.hint("merge").join(common.stored(out, "suffix-runs"), ["gram", "seg"])
        back = back.select("from_gram", "from_seg", F.expr("transform(runs, x -> x + shift)").alias("runs"))
        out = found.pop().union(back)
    return out


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t1, t2, places) of every different text with repeated windows: where their runs begin and end, in bytes."""
    common.bounded_batches(docs.sparkSession)
    bodies = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") >= LENGTH)
    rows = bodies.select(*_text_key(F.col("t")), "t").mapInArrow(
        _segment_rows, "t1 bigint, t2 int, gram bigint, seg bigint, place bigint")
    twice = bodies.mapInArrow(_gram_rows, "gram bigint").groupBy("gram").count().where("count >= 2").select("gram")
    # A table of its own, so that adaptive execution can split the rows of a hot hash.
    twice = common.stored(twice, "suffix-grams")
    rows = common.stored(rows.hint("merge").join(twice, "gram", "left_semi"), "suffix-anchors")
    kinds = rows.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "place")).alias("r"))
    wanted = kinds.groupBy("r.t1", "r.t2").agg(F.collect_list(F.struct("gram", "seg", "n", "r.place")).alias("w"))
    # The text of each wanted segment moves once; copies meet inside each task.
    held = bodies.groupBy(*_text_key(F.col("t"))).agg(F.first("t").alias("t")).join(wanted, ["t1", "t2"])
    held = held.select("w", _cut("t", F.col("w")["place"]).alias("b"))
    different = held.select(F.explode(F.arrays_zip("w", "b")).alias("x")).select("x.w.*", "x.b")
    high = F.shiftright("place", 8).bitwiseAND(F.lit(255)).cast("int")
    found = _merged(different.select(
        "gram", "seg", "n", F.col("b").alias("bytes"),
        (high - F.col("place").bitwiseAND(F.lit(255)).cast("int")).alias("low"), high.alias("high")))
    # Copies of a text have the same rows; one of each is enough to name the places.
    runs = rows.distinct().join(found, ["gram", "seg"])
    first = F.shiftright("place", 16)
    return runs.groupBy("t1", "t2").agg(
        F.flatten(F.collect_list(F.transform("runs", lambda x: x + first))).alias("places"))


@F.arrow_udf(T.StructType([
    T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]))
def _without(texts: pa.Array, places: pa.Array) -> pa.Array:
    out = []
    for raw, own in zip(texts.cast(pa.large_binary()).to_pylist(), places.to_pylist(), strict=True):
        if not own:
            out.append({"n_removed": 0, "n_spans": 0, "kept": raw})
            continue
        at = np.array(own, dtype=np.int64)
        order = np.argsort(at[::2], kind="stable")
        starts, ends = at[::2][order], np.maximum.accumulate(at[1::2][order] + LENGTH - 1)
        new = np.concatenate([[True], starts[1:] > ends[:-1]])
        starts, ends = starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
        edges = np.concatenate([[0], np.column_stack([starts, ends]).ravel(), [len(raw)]]).tolist()
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append({"n_removed": len(raw) - len(kept), "n_spans": len(starts), "kept": kept})
    return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_removed, n_spans and kept, the bytes that no repeated string of 200 bytes covers.

    A null text counts as empty; texts under 200 bytes lose nothing; repeated
    rows and copies lose all that is long enough. `kept` may break a code point
    in two, so it is binary. Columns of these names give way.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = common.stored(repeated(docs, text), "suffix-places")
    own, k1, k2, places = (common.unused(docs, c) for c in ("text", "k1", "k2", "places"))
    t1, t2 = (common.unused(docs, c) for c in ("t1", "t2"))
    found = found.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("places").alias(places))
    keyed = docs.withColumns({own: body, k1: F.xxhash64(body), k2: F.hash(body)})
    joined = keyed.join(found.hint("merge"), (F.col(k1) == F.col(t1)) & (F.col(k2) == F.col(t2)), "left")
    return common.attach(joined, _without(own, places), ["n_removed", "n_spans", "kept"]).drop(own, k1, k2, t1, t2, places)
