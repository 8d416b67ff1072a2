"""Line dedup, the prefix trie and the repair of conversations, against plain Python."""

import collections
import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import conversation_repair as repair
from clausewright.llm import line_dedup, prefix_trie, queries


# Lines

def plain_lines(rows, min_docs=2):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(line_dedup.SPACES)
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(key(line), ())
            ids = [x for x in own if x is not None]
            if len(own) < min_docs or doc == (min(ids) if ids else None):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINES = [
    (1, "a shared line of text\nown words here\n\n"), (2, " A SHARED line of text\t\nshort\nshort"), (3, None), (4, ""),
    (5, "a shared line of text\r\nshort\nÄ SHARED LINE ÄÄ"), (6, "Ä SHARED LINE ÄÄ\nä shared line ää"), (None, "own words here\nno id at all"),
    (None, "no id at all\nown words here"), (7, "\n".join(f"number {k % 900} of many" for k in range(20000))),
    (8, "number 77 of many\nnumber 899 of many\nx"), (9, "twice in this one\ntwice in this one"), (9, "twice in this one"),
    (2, " A SHARED line of text\t\nshort\nshort"), (10, "123456789\nabcdefghij"), (11, "123456789\nabcdefghij"),
]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_against_plain_python(spark, min_docs):
    df = spark.createDataFrame(LINES, "doc_id bigint, text string").withColumn("lost", F.lit(1)).withColumn("kept", F.lit("old"))
    out = line_dedup.remove(df.repartition(3), min_docs=min_docs)
    assert out.columns == ["doc_id", "text", "lost", "n_lines", "n_dropped", "kept"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=str)
    assert got == plain_lines(LINES, min_docs)
    assert line_dedup.remove(df.limit(0)).count() == 0


def test_a_hot_line_is_spread_and_counted(spark):
    rows = [(k, f"the very common line\nonly of {k} itself") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = line_dedup.remove(df).agg(F.sum("n_dropped"), F.min("n_lines")).first()
    assert tuple(out) == (599, 2)
    lines = line_dedup.keyed_lines(df)
    assert line_dedup.shared_lines(lines).count() == 1


# The trie

def test_findclose_of_random_trees():
    draw = random.Random(3)
    for size in (1, 2, 31, 32, 33, 200, 3000):
        for deep in (0.3, 0.5, 0.9):
            bits, depth, left = [], 0, size
            while left or depth:
                if left and (depth == 0 or draw.random() < deep):
                    bits.append(1)
                    depth, left = depth + 1, left - 1
                else:
                    bits.append(0)
                    depth -= 1
            stack, want = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            tree = prefix_trie.Parentheses(np.array(bits))
            assert tree.findclose(tree.opens).tolist() == [want[i] for i in tree.opens.tolist()]


def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, below = collections.Counter(), collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]] += 1
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    out = []
    for k, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(k))
        out.append((
            min(own), len(k), min(members[k[:-1]]) if k else None, len(own), kids[k],
            sum(1 for b in below[k] if not kids[b]),
            sum((len(members[b]) - 1) * len(b[-1][1]) for b in below[k] if b),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, convs, extra=()):
    rows = [(c, i + 1, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, pos int, role string, text string").withColumn("depth", F.lit("clash"))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id bigint")
    nodes, ends = prefix_trie.build(df, ids)
    digests = {(bytes.fromhex(r["name"]), r["depth"]): r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((
        r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
        digests.get((bytes(r["name"]), r["depth"]), empty)) for r in nodes.collect()), key=str)


def random_convs(seed, count, longest=7, words=3):
    draw = random.Random(seed)
    convs = {}
    for c in range(count):
        convs[c * 3] = [(draw.choice(["user", "assistant"]), draw.choice(["", "é", "aaaa", "b\x00"][:words])) for _ in range(draw.randrange(longest))]
        if draw.random() < 0.4:
            convs[c * 3] = convs[draw.choice(list(convs))]
    return convs


@pytest.mark.parametrize("last", [6, 4096])
def test_trie_with_many_tasks_and_levels(spark, monkeypatch, last):
    monkeypatch.setattr(prefix_trie, "ROWS_A_TASK", 20)
    monkeypatch.setattr(prefix_trie, "LAST_ROWS", last)
    convs = random_convs(last, 120)
    assert built(spark, convs) == plain_trie(convs)


def test_shards_merge_to_the_same_trie():
    """Every way to cut sorted sequences, merged over levels in this process, gives the plain trie."""
    for seed, cut in itertools.product(range(12), (2, 3, 5, 50)):
        convs = random_convs(seed, 40, words=4)
        name = lambda turns: hashlib.md5(repr(turns).encode()).digest() if turns else prefix_trie.ROOT
        kinds = collections.defaultdict(list)
        for c, turns in convs.items():
            kinds[tuple(turns)].append(c)
        rows = []
        for turns, own in kinds.items():
            d = len(turns)
            zeros = np.zeros(d + 1, dtype=np.int64)
            rows.append({
                "path": b"".join(name(turns[:k]) for k in range(d + 1)), "lens": np.array([0] + [len(t) for _, t in turns]),
                "n": np.append(zeros[1:], len(own)), "conv": np.append(np.full(d, prefix_trie.NOBODY), min(own)),
                "children": zeros, "leaves": zeros, "saved": zeros})
        done = []
        while True:
            rows.sort(key=lambda r: r["path"])
            last = len(rows) <= cut * 2
            parts = [rows] if last else [rows[i : i + cut + 1] for i in range(0, len(rows), cut + 1)]
            rows = []
            for part in parts:
                final, spines = prefix_trie.trie(part, last)
                done += zip(*(np.asarray(final[c]).tolist() for c in ("name", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), strict=True)
                rows += spines
            if last:
                break
        want = sorted((k[0], k[1], k[3], k[4], k[5], k[6]) for k in plain_trie(convs))
        assert sorted(d[2:3] + d[1:2] + d[3:] for d in done) == want


def test_trie_edges(spark):
    convs = {5: [], 7: [], 100: [("user", "x" * 100_000)], 3: [("user", "x" * 100_000), ("", "")], 9: [("user", f"{k}") for k in range(500)]}
    assert built(spark, convs) == plain_trie(convs)
    empty = spark.createDataFrame([], "conv_id bigint, pos int, role string, text string")
    assert prefix_trie.build(empty)[0].count() == 0
    nulls = spark.createDataFrame([(None, 1, "user", "a"), (1, 1, None, None), (2, 1, "", "")], empty.schema)
    got = {(r["depth"], r["conv_id"]): r["n_convs"] for r in prefix_trie.build(nulls)[0].collect()}
    assert got == {(0, 1): 2, (1, 1): 2}


# Repair

def plain_repair(rows):
    """Cheapest edits of [(role, text)] by a table of whole audits: (blank, duplicate, truncated, illegal, cost, audit, lines)."""
    seen, faults = set(), []
    for role, text in rows:
        tip = text.rstrip(" \t\n\x0b\f\r")[-1:]
        faults.append("b" if not tip else "d" if (role, text) in seen else "t" if tip not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    given = {"": "u", "s": "u", "u": "a", "a": "u"}
    word = {"u": "user", "a": "assistant"}

    def insertions(table):
        for _ in range(3):
            new = dict(table)
            for state, (cost, audit, lines) in table.items():
                way = (cost + 3, audit + "I", (*lines, word[given[state]] + ":"))
                new[given[state]] = min(new.get(given[state], way), way)
            table = new
        return table

    table = {"": (0, "", ())}
    for (role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in insertions(table).items():
            ways = [(state, (cost + 4, audit + "D", lines))]
            if fault not in ("b", "d"):
                more = 3 if fault else 0
                if role[:1] in after[state]:
                    ways.append((role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                ways.append((given[state], (cost + 3 + more, audit + "R", (*lines, f"{word[given[state]]}:{text}"))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        table = new
    table = insertions(table) if rows else table
    cost, audit, lines = min(table[s] for s in ("", "a") if s in table)
    illegal = sum(1 for a, b in itertools.pairwise(r[:1] for r, _ in rows) if a + b not in ("su", "ua", "au"))
    return (faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, lines)


def test_edits_of_all_short_and_random_long_conversations():
    draw = random.Random(5)
    letters = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    cases = [list(c) for n in range(4) for c in itertools.product((0, 1, 4, 5, 6, 8, 9, 12), repeat=n)]
    cases += [[draw.randrange(16) for _ in range(draw.randrange(60))] for _ in range(400)]
    cases += [[draw.choice((4, 8)) for _ in range(40)] for _ in range(200)]
    for kinds in cases:
        rows = []
        for i, k in enumerate(kinds):
            text = " " if k & 2 else f"{i}" + ("" if k & 1 else ".")
            rows.append((letters[k >> 2], text))
        kinds = [k & ~1 if k & 2 else k for k in kinds]
        cost, found, tail = repair.edits(bytes(kinds))
        assert (cost, "".join(found) + tail) == plain_repair(rows)[4:6]


def test_edits_in_linear_space():
    cost, found, tail = repair.edits(bytes([4, 8] * 20_000 + [8]))
    assert (cost, len(found), tail) == (3, 40_001, "") and found[-1] == "IK"
    import tracemalloc

    tracemalloc.start()
    forward = functools.partial(repair.forward, bytes([4, 8]) * 20_000, repair.START)
    forward()
    assert tracemalloc.get_traced_memory()[1] < 200_000
    tracemalloc.stop()


def repaired(df):
    checked = repair.faults(df).cache()
    edited = repair.edit_table(checked)
    whole = {r["conv_id"]: r for r in repair.summary(checked, edited).collect()}
    lines = collections.defaultdict(list)
    last = 1 << 40
    rows = repair.repair(checked, edited).collect()
    for r in sorted(rows, key=lambda r: (last if r["pos"] is None else r["pos"], r["part"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    shas = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repair.repair(checked, edited)).collect()}
    return whole, lines, shas


def test_repair_against_plain_python(spark):
    draw = random.Random(9)
    roles, texts = ["user", "assistant", "system", "", "tool", "usher", None], ["Good.", "Yes!  \n", "cut", "", " \t", "no stop\n", None, "x" * 50_000 + "."]
    rows, by = [], {}
    for c in [*range(60), None]:
        own = [(draw.choice(roles[: draw.choice((2, 3, 7))]), draw.choice(texts[: draw.choice((2, 8))]) ) for _ in range(draw.randrange(1, 12))]
        own = [(r, f"{i} {t}" if t and draw.random() < 0.7 else t) for i, (r, t) in enumerate(own)]
        rows += [(c, i, i + 1, r, t) for i, (r, t) in enumerate(own)]
        by[c] = [(" " if r is None else r, " " if t is None else t) for r, t in own]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, pos int, role string, text string").withColumn("edits", F.lit("clash"))
    whole, lines, shas = repaired(df.repartition(5))
    assert set(whole) == set(by)
    for c, own in by.items():
        want = plain_repair(own)
        r = whole[c]
        assert (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == want[:6]
        assert tuple(lines[c]) == want[6]
        if want[6]:
            assert shas[c] == hashlib.sha256("\n".join(want[6]).encode()).hexdigest()
    whole, lines, shas = repaired(df.limit(0))
    assert not whole and not lines and not shas


def test_damage_and_registered_query(spark, folder):
    """The query over a small table with nulls, ties, repeated rows and a conversation that loses all its turns."""
    gone = next(c for c in range(1000, 5000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Lost."), (1, None, "user", "First."), (1, None, "user", "First."), (1, 5, None, None), (None, 2, "user", "No id."),
            *[(c, t, ("user", "assistant")[t % 2], f"Turn {t} of {c}{'.' if (c + t) % 7 else ''}") for c in range(2, 40) for t in range(6)]]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.QUERIES["op13_conversation_repair"](spark, folder).collect()}
    assert got[gone]["audit"] == "" and got[gone]["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and got[gone]["cost"] == 0
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        m = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if m == 1 else x.translate({ord(p): None for p in ".!?"}) if m == 2 else x
        by[c] += [(t, "user" if m == 4 else r, x)] * (0 if m == 0 else 2 if m == 3 else 1)
    for c, own in by.items():
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        want = plain_repair([(r, x) for _, r, x in own])
        r = got[c]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (gaps, *want[:6])
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(want[6]).encode()).hexdigest()
    assert set(got) == set(by) | {gone, 1, None}
