"""Least-cost repair of the structure of conversations.

A good conversation has the role initials `(s?(ua)+)?`: four states, nothing yet,
after system, after user, after assistant. A turn is kept, given another role,
or deleted, and empty turns are inserted; blank and duplicate turns must go. The
cheapest edits are wanted, and of those the audit (the initials K, R, D, I of the
edits) that comes first by ASCII.

Hirschberg's division finds them in linear space. Forward cost vectors of the four
states come from the left end to the middle turn, backward vectors from the right
end; a state with the least sum is a crossing. The forward vector also ranks the
audits of its states. The edits of a turn, insertions first, are codes of which none
begins another, and an audit decides the states it passes, so audits of as many
turns differ before either ends: of equally cheap crossings the one of least rank
is right. Both halves follow, with no table of the whole.

A task holds one byte a turn of one conversation; texts stream past it in order.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm import common

RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\f\r"
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
# What may follow a state, and the state it leads to.
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
WORDS = {"u": "user", "a": "assistant"}


def _inserted(state: int) -> tuple[str, int]:
    """The only role that can be inserted or given in a state, and what follows."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


@lru_cache(maxsize=None)
def moves(kind: int) -> tuple:
    """Ways through a turn: (from state, to state, cost, edits, place of the edits in ASCII order).

    A kind is 4 * initial (0-2: one of `sua`, 3: other) + 2 * must go + truncated.
    Three insertions before a turn never help: two come back to the state they began in or
    behind it.
    """
    initial, gone, short = INITIALS[kind >> 2 : (kind >> 2) + 1], kind & 2, TRUNCATED * (kind & 1)
    found = []
    for state in STEPS:
        now, cost, edits = state, 0, ""
        for _ in range(3):
            found.append((state, now, cost + DELETE, edits + "D"))
            if not gone:
                if initial in STEPS[now]:
                    found.append((state, STEPS[now][initial], cost + short, edits + "K"))
                found.append((state, _inserted(now)[1], cost + RELABEL + short, edits + "R"))
            now, cost, edits = _inserted(now)[1], cost + INSERT, edits + "I"
    order = {e: k for k, e in enumerate(sorted({f[3] for f in found}))}
    best: dict = {}
    for s, t, cost, edits in found:
        if (s, t) not in best or (cost, order[edits]) < best[s, t][:2]:
            best[s, t] = (cost, order[edits], edits)
    return tuple((s, t, *v) for (s, t), v in best.items())


@lru_cache(maxsize=None)
def _places() -> dict:
    """Order of all edits that a turn can have, the same for every kind of turn."""
    return {e: k for k, e in enumerate(sorted({m[4] for kind in range(16) for m in moves(kind)}))}


def tails(state: int) -> str | None:
    """Insertions that end a conversation in a good state."""
    return {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]


def forward(kinds: bytes, state: int) -> tuple[list[int], list[int]]:
    """Least cost from `state` to each state over all of `kinds`, and the rank of its audit among the states."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[state] = 0
    place = _places()
    for kind in kinds:
        best = [(NEVER, 0, 0)] * 4
        for s, t, c, _, edits in moves(kind):
            if cost[s] < NEVER:
                way = (cost[s] + c, rank[s], place[edits])
                if way < best[t]:
                    best[t] = way
        audits = sorted({b[1:] for b in best})
        cost, rank = [b[0] for b in best], [audits.index(b[1:]) for b in best]
    return cost, rank


def backward(kinds: bytes, state: int) -> list[int]:
    """Least cost from each state over all of `kinds` to `state`."""
    cost = [NEVER] * 4
    cost[state] = 0
    for kind in reversed(kinds):
        best = [NEVER] * 4
        for s, t, c, _, _ in moves(kind):
            if c + cost[t] < best[s]:
                best[s] = c + cost[t]
        cost = best
    return cost


def _single(kind: int, start: int, end: int) -> str:
    return next(m[4] for m in moves(kind) if m[:2] == (start, end))


def edits(kinds: bytes) -> tuple[int, list[str], str]:
    """Cost, the edits of each turn, and the insertions at the end."""
    if not kinds:
        return 0, [], ""
    cost, rank = forward(kinds, START)
    whole = [cost[s] + INSERT * len(tails(s)) for s in range(4)]
    end = min(range(4), key=lambda s: (whole[s], rank[s]))
    out: list[str] = []
    todo = [(0, len(kinds), START, end)]
    while todo:
        low, high, a, b = todo.pop()
        if high - low == 1:
            out.append(_single(kinds[low], a, b))
            continue
        middle = (low + high) // 2
        ahead, ranks = forward(kinds[low:middle], a)
        back = backward(kinds[middle:high], b)
        cross = min(range(4), key=lambda s: (ahead[s] + back[s], ranks[s]))
        # The left half is taken first, so that edits come in order.
        todo += [(middle, high, cross, b), (low, middle, a, cross)]
    return whole[end], out, tails(end)


def outcomes(kinds: bytes, found: list[str], tail: str) -> list[tuple[str, str]]:
    """For each turn and the end: the initials inserted before it, and its new initial (empty: as it was)."""
    state, out = START, []
    for kind, e in zip([*kinds, None], [*found, tail], strict=True):
        before, fresh = "", ""
        for c in e:
            if c == "I":
                letter, state = _inserted(state)
                before += letter
            elif c == "R":
                fresh, state = _inserted(state)
            elif c == "K":
                state = STEPS[state][INITIALS[kind >> 2]]
        out.append((before, fresh))
    return out


def last_character(text: Column) -> Column:
    """The last character that is not one of the six ASCII spaces; empty for a blank text."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def faults(turns: DataFrame) -> DataFrame:
    """`turns`(conv_id, turn, pos, role, text) as (conv_id, turn, pos, role, text, initial, fault).

    The first fault counts: blank (nothing but ASCII spaces), duplicate (role and
    text seen earlier in the conversation), truncated (last character not one of
    `.!?`), or none (null). Null role and text count as one space, so such a text is blank.
    """
    rows = turns.select(
        "conv_id", "turn", "pos", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # Told apart by 128 bits; a conversation has far too few turns for two to agree by chance.
    same = Window.partitionBy("conv_id", "a", "b").orderBy("pos")
    marked = rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "text", "role")}).withColumn(
        "again", F.row_number().over(same) > 1)
    end = last_character(F.col("text"))
    fault = (
        F.when(end == "", "blank").when(F.col("again"), "duplicate")
        .when(~end.isin(".", "!", "?"), "truncated"))
    return marked.select("conv_id", "turn", "pos", "role", "text", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


EDITS = "conv_id bigint, pos int, edits string, before string, fresh string, cost bigint"


def _solved(conv, pos: list, kinds: bytes):
    cost, found, tail = edits(kinds)
    ways = outcomes(kinds, found, tail)
    return pa.record_batch({
        "conv_id": pa.array([conv] * (len(pos) + 1), pa.int64()), "pos": pa.array([*pos, None], pa.int32()),
        "edits": pa.array([*found, tail]), "before": pa.array([w[0] for w in ways]), "fresh": pa.array([w[1] for w in ways]),
        "cost": pa.array([None] * len(pos) + [cost], pa.int64())})


def _edit_rows(batches):
    """Sorted (conv_id, pos, kind) as EDITS; the row without a position is the end of its conversation."""
    conv, pos, kinds, open_ = None, [], bytearray(), False
    held, rows = [], 0
    for batch in batches:
        for c, p, k in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "pos", "kind")), strict=True):
            if open_ and c != conv:
                held.append(_solved(conv, pos, bytes(kinds)))
                rows += len(pos)
                pos, kinds = [], bytearray()
                if rows > 4096:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
            conv, open_ = c, True
            pos.append(p)
            kinds.append(k)
    if open_:
        held.append(_solved(conv, pos, bytes(kinds)))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def edit_table(checked: DataFrame) -> DataFrame:
    """EDITS for the rows of `faults`: one for each turn, and one with null `pos`, insertions at the end and the cost."""
    initial = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in INITIALS]), F.col("initial")), F.lit(0))
    kind = (
        4 * F.when(initial > 0, initial - 1).otherwise(3)
        + F.when(F.col("fault").isin("blank", "duplicate"), 2).otherwise(0)
        + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    return (
        checked.select("conv_id", "pos", kind.cast("int").alias("kind")).repartition("conv_id")
        .sortWithinPartitions("conv_id", "pos").mapInArrow(_edit_rows, EDITS))


def repair(checked: DataFrame, edited: DataFrame) -> DataFrame:
    """The repaired turns: (conv_id, pos, part, turn, role, text, edit).

    `pos` is that of the turn in the rows of `faults`, and of inserted turns that of
    the next one (null at the end); `part` orders the rows of one position.
    Inserted turns have an empty text and no turn number. Conversations of which
    nothing is left have no rows.
    """
    e = edited.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), "edits", "before", "fresh")
    word = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    kept = checked.join(e, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p"))).where("right(edits, 1) <> 'D'").select(
        "conv_id", "pos", F.lit(9).alias("part"), "turn", F.coalesce(word[F.col("fresh")], F.col("role")).alias("role"), "text",
        F.expr("right(edits, 1)").alias("edit"))
    added = edited.where("before <> ''").select(
        "conv_id", "pos", F.posexplode(F.split("before", "")).alias("part", "letter")).select(
        "conv_id", "pos", "part", F.lit(None).cast("bigint").alias("turn"), word[F.col("letter")].alias("role"),
        F.lit("").alias("text"), F.lit("I").alias("edit"))
    return kept.unionByName(added)


def summary(checked: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows."""
    told = Window.partitionBy("conv_id").orderBy("pos")
    pair = F.concat(F.lag("initial").over(told), "initial")
    counted = checked.select("conv_id", "fault", (~pair.isin("su", "ua", "au")).alias("bad")).groupBy("conv_id").agg(
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count(F.when(F.col("bad"), 1)).alias("illegal"))
    # The audit is a byte an edit; the end, without a position, comes last.
    said = edited.groupBy("conv_id").agg(
        F.max("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit((1 << 31) - 1)).alias("k"), "edits"))), lambda x: x["edits"]), "").alias("audit"))
    return counted.join(said.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def _digest_rows(batches):
    """Sorted repaired turns as (conv_id, repaired_sha256), texts as they pass."""
    conv, digest = None, None
    for batch in batches:
        done = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield _digest_batch(done)
    if digest is not None:
        yield _digest_batch([(conv, digest.hexdigest())])


def _digest_batch(rows: list) -> pa.RecordBatch:
    return pa.record_batch({
        "conv_id": pa.array([r[0] for r in rows], pa.int64()), "repaired_sha256": pa.array([r[1] for r in rows], pa.string())})


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of `role:text` of the repaired turns, newline-joined."""
    common.bounded_batches(repaired.sparkSession)
    return repaired.select("conv_id", F.coalesce("pos", F.lit((1 << 31) - 1)).alias("pos"), "part", "role", "text").repartition(
        "conv_id").sortWithinPartitions("conv_id", "pos", "part").mapInArrow(_digest_rows, "conv_id bigint, repaired_sha256 string")
