"""Trie of conversation prefixes: what sharing equal beginnings would save.

A node is a sequence of first turns; its name is 128 bits, the running XOR of a
hash of (position, role, text) over them. Equal conversations are one sequence
with a count. Sequences, sorted by their node names, have equal beginnings side by
side; the sorted order is cut into shards, and a shard writes its trie as balanced
parentheses in pre-order. From there all nodes are handled together:

* `findclose` over blocks of the excess with their least values, in a tree of
  minima, delimits the subtree of a node;
* rank of `()` counts the leaves in it;
* running sums give conversations and, from these, the tokens saved.

A shard is final for all nodes but the two spines, its first and last sequence,
which its neighbours may share. A spine goes up as a sequence of its own that
carries what hangs off each of its nodes; the next level merges these by the same
steps, with far fewer rows, until one shard is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm import common

NAME = 16  # bytes of a node's name
SHARD_NODES = 1 << 16
LEAST_ROWS = 64  # sequences of a shard at least, so that spines are far fewer than rows
LAST_ROWS = 4096  # sequences that one task merges at the end
ROWS_A_TASK = 1 << 14
SALTS = 32
BLOCK = 32  # parentheses whose excess one leaf of the tree of minima covers
NOBODY = (1 << 63) - 1
ROOT = bytes(NAME)

_LISTS = ("lens", "n", "conv", "children", "leaves", "saved")
SEQUENCES = "path binary, " + ", ".join(f"{c} array<bigint>" for c in _LISTS)
NODES = ("name binary, depth int, parent binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint")


class Parentheses:
    """Balanced parentheses: rank of openings and leaves, and findclose by blocks of least excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits)
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        pairs = np.zeros(len(bits) + 1, dtype=np.int64)
        pairs[1:-1] = bits[:-1] & (1 - bits[1:])
        self.pairs = np.cumsum(pairs)  # pairs[i + 1]: `()` that begin at i or before
        size = -(-len(bits) // BLOCK)
        width = 1 << max(0, (size - 1).bit_length())
        self.padded = np.full(width * BLOCK, np.iinfo(np.int64).max)
        self.padded[: len(bits)] = self.excess
        self.levels = [self.padded.reshape(-1, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The place of the closing parenthesis of each opening one."""
        target = self.excess[at] - 1
        out = np.full(len(at), -1, dtype=np.int64)
        block = at // BLOCK
        self._scan(at + 1, (block + 1) * BLOCK, target, np.arange(len(at)), out)
        left = np.flatnonzero(out < 0)
        # Up, until a later sibling holds an excess as low as wanted.
        node, level, found = block[left].copy(), 0, np.full(len(left), -1, dtype=np.int64)
        height = np.zeros(len(left), dtype=np.int64)
        active = np.arange(len(left))
        while len(active):
            own = node[active]
            sibling = own + 1
            ok = (own % 2 == 0) & (sibling < len(self.levels[level]))
            ok[ok] = self.levels[level][sibling[ok]] <= target[left[active[ok]]]
            found[active[ok]], height[active[ok]] = sibling[ok], level
            active = active[~ok]
            node[active] //= 2
            level += 1
        # Down, to the first block that does.
        for level in range(int(height.max(initial=0)), 0, -1):
            here = np.flatnonzero(height == level)
            first = 2 * found[here]
            later = self.levels[level - 1][first] > target[left[here]]
            found[here], height[here] = first + later, level - 1
        self._scan(found * BLOCK, (found + 1) * BLOCK, target[left], left, out)
        return out

    def _scan(self, start: np.ndarray, stop: np.ndarray, target: np.ndarray, slot: np.ndarray, out: np.ndarray) -> None:
        for step in range(BLOCK):
            live = start + step < stop
            start, stop, target, slot = start[live], stop[live], target[live], slot[live]
            hit = self.padded[start + step] <= target
            out[slot[hit]] = start[hit] + step
            start, stop, target, slot = start[~hit], stop[~hit], target[~hit], slot[~hit]
            if not len(slot):
                return


def _common(a: bytes, b: bytes) -> int:
    """Nodes that two paths have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // NAME
    low, high = 0, n // NAME
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * NAME] == b[: middle * NAME] else (low, middle)
    return low


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first:last], for each pair, from minima of spans of powers of two."""
    out = np.empty(len(first), dtype=np.int64)
    level = np.frexp(last - first)[1] - 1
    table, span = values, 1
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[first[here]], table[last[here] - span])
        if len(table) > span:
            table = np.minimum(table[:-span], table[span:])
        span *= 2
    return out


def trie(rows: list[dict], last: bool) -> tuple[dict, list[dict]]:
    """The final nodes of a shard of sorted sequences, as columns, and the spines to merge (none if it is the last)."""
    depth = np.array([len(r["path"]) // NAME for r in rows])
    shared = np.array([0] + [_common(a["path"], b["path"]) for a, b in zip(rows[:-1], rows[1:], strict=True)])
    # Parentheses: before a sequence the nodes close that it doesn't share, then its own open.
    closes = np.append(0, depth[:-1] - shared[1:])
    bits = np.repeat(np.tile([0, 1], len(rows)), np.column_stack([closes, depth - shared]).ravel())
    bits = np.append(bits, np.zeros(depth[-1], dtype=bits.dtype))
    tree = Parentheses(bits)
    close = tree.findclose(tree.opens)
    size = (close - tree.opens + 1) // 2
    nodes = np.arange(len(size))
    after = nodes + size
    # The node of each element of each sequence, and what is attached to it.
    stack, ids, fresh = [], [], 0
    for d, s in zip(depth.tolist(), shared.tolist(), strict=True):
        stack[s:] = range(fresh, fresh + d - s)
        fresh += d - s
        ids.append(np.array(stack, dtype=np.int64))
    first, end = ids[0], ids[-1]
    ids = np.concatenate(ids)
    have = {c: np.concatenate([r[c] for r in rows]).astype(np.int64) for c in _LISTS}
    held = {}
    for c in ("n", "children", "leaves", "saved"):
        held[c] = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(held[c], ids, have[c])
    who = np.full(len(nodes), NOBODY, dtype=np.int64)
    np.minimum.at(who, ids, have["conv"])
    lens = np.zeros(len(nodes), dtype=np.int64)
    lens[ids] = have["lens"]
    level = tree.excess[tree.opens] - 1
    names = np.zeros((len(nodes), NAME), dtype=np.uint8)
    names[ids] = np.frombuffer(b"".join(r["path"] for r in rows), dtype=np.uint8).reshape(-1, NAME)
    # The parent opens last before the node one level up.
    parent = np.full(len(nodes), -1, dtype=np.int64)
    by = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by], np.arange(level.max() + 2))
    for k in range(1, int(level.max()) + 1):
        own, up = by[cuts[k] : cuts[k + 1]], by[cuts[k - 1] : cuts[k]]
        parent[own] = up[np.searchsorted(up, own) - 1]
    edge = np.zeros(len(nodes), dtype=bool)
    if not last:
        edge[first] = edge[end] = True

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values))
        return sums[after] - sums[nodes]

    children = held["children"] + np.bincount(parent[1:], minlength=len(nodes))
    n = total(held["n"])
    least = _least(who, nodes, after)
    # Leaves: `()` of the subtree; not those whose children an earlier level has finished, nor spines.
    bare = (size == 1) & ((held["children"] > 0) | edge)
    leaves = tree.pairs[close + 1] - tree.pairs[tree.opens] - total(bare) + total(held["leaves"])
    saved = total(held["saved"] + np.where(edge, 0, (n - 1) * lens))
    inner = np.flatnonzero(~edge)
    up = parent[inner]
    open_parent = np.where(up >= 0, edge[up], False)
    raw = names.tobytes()
    cut = lambda i: raw[i * NAME : (i + 1) * NAME]
    final = {
        "name": [cut(i) for i in inner.tolist()], "depth": level[inner].astype(np.int32),
        "parent": [cut(p) if o else None for p, o in zip(up.tolist(), open_parent.tolist(), strict=True)],
        "conv_id": least[inner],
        "parent_conv_id": pa.array(least[up], mask=open_parent | (up < 0)),
        "n_convs": n[inner], "n_children": children[inner], "n_leaves": leaves[inner], "saved_tokens": saved[inner]}
    if last:
        return final, []
    # A spine node keeps what its subtree holds outside the spines: itself, less its children on a spine.
    spine = np.flatnonzero(edge)
    below = spine[parent[spine] >= 0]
    own = {"n": n.copy(), "children": children.copy(), "leaves": leaves.copy(), "saved": saved.copy()}
    for c, whole in (("n", n), ("leaves", leaves), ("saved", saved), ("children", np.ones_like(n))):
        np.subtract.at(own[c], parent[below], whole[below])
    # The least id of the subtree may be told by every node above: it stays the least.
    own["conv"], own["lens"] = least, lens
    once = end[: 0 if len(rows) == 1 else len(end)]
    spines = []
    for path, seen in ((first, np.zeros(0, dtype=np.int64)), (once, first)):
        if not len(path):
            continue
        again = np.isin(path, seen)
        row = {"path": names[path].tobytes(), "lens": lens[path], "conv": own["conv"][path]}
        row |= {c: np.where(again, 0, own[c][path]) for c in ("n", "children", "leaves", "saved")}
        spines.append(row)
    return final, spines


def _batch(final: dict | None, spines: list[dict]) -> pa.RecordBatch:
    """Nodes and sequences under one schema: nodes have a name, sequences a path."""
    count = 0 if final is None else len(final["name"])
    columns = {}
    for field in _NODE_FIELDS:
        own = pa.array([], field.type) if final is None else pa.array(final[field.name], type=field.type)
        columns[field.name] = pa.concat_arrays([own, pa.nulls(len(spines), field.type)])
    for name, kind in _SEQUENCE_FIELDS:
        columns[name] = pa.concat_arrays([pa.nulls(count, kind), pa.array([r[name] for r in spines], kind)])
    return pa.record_batch(columns)


_NODE_FIELDS = [pa.field(n, {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}[t])
                for n, t in (x.split() for x in NODES.split(", "))]
_SEQUENCE_FIELDS = [("path", pa.binary())] + [(c, pa.list_(pa.int64())) for c in _LISTS]


def _shards(last: bool):
    def run(batches):
        """Sorted sequences in shards of bounded size; a cut between two of them may fall anywhere."""
        held, nodes = [], 0
        for batch in batches:
            paths = batch.column("path").to_pylist()
            lists = {c: batch.column(c) for c in _LISTS}
            for i, path in enumerate(paths):
                held.append({"path": path, **{c: np.asarray(a[i].values) for c, a in lists.items()}})
                nodes += len(path) // NAME
                if not last and nodes >= SHARD_NODES and len(held) >= LEAST_ROWS:
                    yield _batch(*trie(held, False))
                    held, nodes = [], 0
        if held:
            yield _batch(*trie(held, last))

    return run


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, name, len) of each turn of turns(conv_id, pos, role, text): the name of the prefix it ends.

    Positions count from 1 without gaps. The running XOR goes through a window
    that spills; only hashes and lengths are in it.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hashed = turns.select(
        "conv_id", "pos", F.length("text").cast("bigint").alias("len"),
        F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role", "pos").alias("b"))
    # The hash of a null isn't taken into account by Spark, so role and text come without nulls.
    run = hashed.select("conv_id", "pos", "len", F.bit_xor("a").over(before).alias("a"), F.bit_xor("b").over(before).alias("b"))
    return run.select("conv_id", "pos", "len", F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0")).alias("name"))


def sequences(convs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different sequences as rows of SEQUENCES, and (conv_id, name, depth): the node at which each of convs(conv_id) ends."""
    ends = named.groupBy("conv_id").agg(F.max_by("name", "pos").alias("name"), F.max("pos").alias("depth")).select(
        F.col("conv_id").alias("c"), "name", "depth")
    ends = convs.join(ends, F.col("conv_id") == F.col("c"), "left").select(
        "conv_id", F.coalesce("name", F.lit(ROOT.hex())).alias("name"), F.coalesce("depth", F.lit(0)).alias("depth"))
    ends = common.stored(ends, "trie-ends")
    kinds = ends.groupBy("name", "depth").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"))
    # One conversation of each kind brings its path.
    path = named.join(kinds.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "len"))).alias("p"))
    rows = kinds.join(path, "conv_id", "left").select(
        "conv_id", "copies", "depth",
        F.unhex(F.concat(F.lit(ROOT.hex()), F.coalesce(F.array_join("p.name", ""), F.lit("")))).alias("path"),
        F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("p.len", F.array().cast("array<bigint>"))).alias("lens"))
    none = F.array_repeat(F.lit(0).cast("bigint"), F.col("depth"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.col("depth") + 1)
    nobody = F.array_repeat(F.lit(NOBODY), F.col("depth"))
    return rows.select(
        "path", "lens", F.concat(none, F.array("copies")).alias("n"), F.concat(nobody, F.array("conv_id")).alias("conv"),
        zeros.alias("children"), zeros.alias("leaves"), zeros.alias("saved")), ends


def nodes(rows: DataFrame) -> DataFrame:
    """Every node of the trie of sequences, with its name, as NODES; the parent is named by its least id."""
    spark = rows.sparkSession
    common.bounded_batches(spark)
    both = f"{NODES}, {SEQUENCES}"
    names = [x.split()[0] for x in NODES.split(", ")]
    paths = ["path", *_LISTS]
    done, merged = None, None
    while True:
        rows = common.stored(rows, "trie-sequences")
        count = rows.count()
        last = count <= LAST_ROWS
        dealt = rows.coalesce(1) if last else rows.repartitionByRange(count // ROWS_A_TASK + 1, "path")
        out = common.stored(dealt.sortWithinPartitions("path").mapInArrow(_shards(last), both), "trie-shards")
        final = out.where("name is not null").select(*names)
        if done is not None:
            merged = final if merged is None else merged.union(final)
        done = final if done is None else done.union(final)
        if last:
            break
        rows = out.where("path is not null").select(*paths)
    if merged is None:
        return done.drop("parent")
    # Parents on a spine were finished later. They are few, their children may be many: each parent stands under every salt.
    salt = F.pmod(F.xxhash64("conv_id", "name"), F.lit(SALTS)).cast("int")
    parents = merged.select(
        F.col("name").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("found"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    waiting = done.where("parent is not null").withColumn("salt", salt).join(parents, ["parent", "depth", "salt"])
    keep = [c for c in names if c != "parent"]
    return done.where("parent is null").select(*keep).union(
        waiting.withColumn("parent_conv_id", F.col("found")).select(*keep))


def build(turns: DataFrame, convs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of turns(conv_id, pos, role, text), and (conv_id, name, depth) of each conversation's end.

    `convs(conv_id)` names conversations that may have no turns, which end at the
    root. Null role and text count as empty, rows without conv_id belong to no
    conversation, and where there is no conversation there is no node. Columns
    beyond the four play no part.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("pos").cast("int").alias("pos"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = common.stored(prefixes(rows), "trie-names")
    own = (convs if convs is not None else rows).where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    found, ends = sequences(own, named)
    return nodes(found), ends


IDS_A_ROW = 1 << 13


def _joined(batches):
    """Sorted (name, depth, conv_id) as (name, depth, first, ids): runs of ids of one node, joined."""
    for batch in batches:
        names, depths, ids = (batch.column(c) for c in ("name", "depth", "conv_id"))
        keys = list(zip(names.to_pylist(), depths.to_pylist(), strict=True))
        numbers = ids.to_pylist()
        out = {"name": [], "depth": [], "first": [], "ids": []}
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start] or i - start == IDS_A_ROW:
                for c, v in zip(out, (*keys[start], numbers[start], ",".join(map(str, numbers[start:i]))), strict=True):
                    out[c].append(v)
                start = i
        yield pa.record_batch({
            "name": pa.array(out["name"], pa.string()), "depth": pa.array(out["depth"], pa.int32()),
            "first": pa.array(out["first"], pa.int64()), "ids": pa.array(out["ids"], pa.string())})


def _digests(batches):
    """The SHA-256 of the ids of each node, from its sorted runs as they pass."""
    import hashlib

    key, digest = None, None
    for batch in batches:
        out = {"name": [], "depth": [], "ends_sha256": []}
        rows = zip(batch.column("name").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist(), strict=True)
        for name, depth, ids in rows:
            if (name, depth) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                for c, v in zip(out, (*key, digest.hexdigest()), strict=True):
                    out[c].append(v)
            key, digest = (name, depth), hashlib.sha256(ids.encode())
        yield _digest_batch(out)
    if key is not None:
        yield _digest_batch({"name": [key[0]], "depth": [key[1]], "ends_sha256": [digest.hexdigest()]})


def _digest_batch(out: dict) -> pa.RecordBatch:
    return pa.record_batch({
        "name": pa.array(out["name"], pa.string()), "depth": pa.array(out["depth"], pa.int32()),
        "ends_sha256": pa.array(out["ends_sha256"], pa.string())})


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, depth, ends_sha256): SHA-256 of the ascending ids of the conversations that end at a node, comma-joined.

    The ids of a node many conversations end at are sorted and joined in as many
    tasks as they need; the digest itself reads a row for each few thousand ids.
    """
    count = ends.count()
    runs = ends.repartitionByRange(count // (1 << 18) + 1, "name", "depth", "conv_id").sortWithinPartitions(
        "name", "depth", "conv_id").mapInArrow(_joined, "name string, depth int, first bigint, ids string")
    runs = common.stored(runs, "trie-runs")
    return runs.repartition("name", "depth").sortWithinPartitions("name", "depth", "first").mapInArrow(
        _digests, "name string, depth int, ends_sha256 string")
