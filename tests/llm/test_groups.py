"""Sharding, SimHash, repeated strings, BPE, token counts and the pipeline."""

import base64
import collections
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from clausewright.llm import bpe, common, graph, queries, sharding, simhash, suffix_dedup, token_cache

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Sharding

def shards_of(df, text="text", **more):
    rows = sharding.assign(df, text, **more).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return rows, {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_shards_have_near_equal_bytes(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    rows, sizes = shards_of(docs)
    assert len(rows) == docs.count() and len(sizes) == 8
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    # Within a shard of its even part: the tolerance, and the longest text on either side.
    even, longest = sum(sizes.values()) / 8, max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * even + 2 * longest


def test_a_hot_text_is_split(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    _, sizes = shards_of(docs)
    assert max(sizes.values()) <= 1.02 * min(sizes.values()) + 30
    hot = {r["shard"] for r in sharding.assign(docs).where("text = 'the same text'").collect()}
    assert len(hot) >= 3


def test_shard_edges(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "x" * 1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("slot", F.lit("old"))
    out, _ = shards_of(df)
    assert sorted(r["size"] for r in out) == [1, 1, 1, 1001]
    assert sharding.assign(df.limit(0)).count() == 0
    assert sharding.splitters(spark.createDataFrame([], "k1 bigint, k2 bigint, size bigint"), 8) == [(-(1 << 63),) * 2] * 7


def test_splitters_meet_the_tolerance(spark):
    draw = np.random.default_rng(1)
    keys = [(int(a), int(b), int(s)) for a, b, s in zip(
        draw.integers(-50, 50, 4000) << 50, draw.integers(-(1 << 62), 1 << 62, 4000), draw.integers(1, 20, 4000), strict=True)]
    cuts = sharding.splitters(spark.createDataFrame(keys, "k1 bigint, k2 bigint, size bigint"), 8, 0.01)
    total = sum(k[2] for k in keys)
    for i, c in enumerate(cuts, 1):
        below = sum(k[2] for k in keys if k[:2] < c)
        assert abs(below - total * i / 8) <= 0.01 * total / 8 + 20


# SimHash

def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints_and_groups(spark):
    edge = [(900, None), (901, ""), (902, "One two"), (903, "one two three"), (904, "A b C d"), (905, "a B c D"), (None, "a b c d")]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(edge, "doc_id bigint, text string"))
    rows = docs.collect()
    out = simhash.classify(docs).collect()
    want = sorted((str(r["doc_id"]), f"{plain_fingerprint(r['text']):016x}") for r in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in out) == want
    prints = sorted({int(f, 16) for _, f in want})
    near = [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3]
    root = plain_components(near, prints)
    least = {}
    for r in out:
        if r["doc_id"] is not None:
            k = root[int(r["fingerprint"], 16)]
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least[root[int(r["fingerprint"], 16)]] for r in out)


def test_links_are_complete(spark):
    draw = random.Random(4)
    prints = [draw.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for n in (1, 2, 3, 4):
            q = p
            for b in draw.sample(range(64), n):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.links(
        spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert found == want


def test_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]], nodes)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_stays(spark):
    rows = [(5, "a b c d", 1), (3, "A B c d", 2), (3, "A B c d", 2), (9, "other words here now", 3), (None, "alone and unnamed text", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in kept.collect()) == [("3", 2), ("9", 3), ("None", 4)]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


# Repeated strings

def brute_removal(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def authored():
    draw = random.Random(5)

    def text(n):
        return "".join(draw.choice("abcdefgh é") for _ in range(n))

    shared, hot = text(300), text(250)
    out = [shared, text(100) + shared + text(50), "a" * 1000, "ab" * 400 + text(10), None, "", text(199), text(500)]
    out += [text(draw.randint(0, 250)) + hot + text(draw.randint(0, 250)) for _ in range(40)]
    out += ["xyz " * draw.randint(20, 90) for _ in range(8)]
    return [*out, out[3], out[3], shared[:199], shared[:200], "a" * 200, "a" * 199, text(50) + text(7) * 50]


@pytest.mark.parametrize("limit", [suffix_dedup.MAX_SEGMENTS, 5])
def test_repeated_strings_go(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "MAX_SEGMENTS", limit)
    texts = authored()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("kept", F.lit("old"))
    rows = suffix_dedup.remove(docs).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    want = brute_removal(texts)
    assert len(rows) == len(texts) and all(tuple(r[1:]) == want[r["doc_id"]] for r in rows)


def test_cuts_grow_with_a_group_not_with_its_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_SEGMENTS", 20)
    made, halves = [], suffix_dedup._halves

    def counted(rows):
        out = halves(rows)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "_halves", counted)
    draw = random.Random(9)
    base = [f"w{draw.randrange(5000)}" for _ in range(60)]
    for size in (60, 120):
        texts = []
        for _ in range(size):
            words = list(base)
            for i in draw.sample(range(60), 3):
                words[i] = f"n{draw.randrange(10**6)}"
            texts.append(" ".join(words))
        made.append(0)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        rows = suffix_dedup.remove(docs.withColumn("_text", F.lit("own")).withColumn("_K1", F.lit(1))).collect()
        want = brute_removal(texts)
        assert all((r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]] for r in rows)
        assert all((r["_text"], r["_K1"]) == ("own", 1) for r in rows) and len(rows) == size
    assert 0 < made[1] <= 2.5 * made[0] + 60


def test_merge_of_many_shards():
    draw = random.Random(2)
    base = [bytes(draw.choice(b"ab") for _ in range(230)) for _ in range(6)]
    segs = [draw.choice(base)[draw.randrange(0, 20) :][:205] for _ in range(60)] + base
    keys = np.array([draw.randrange(3) for _ in segs], dtype=np.int64)
    weights = np.array([draw.choice([1, 1, 1, 2]) for _ in segs])
    total = collections.Counter()
    for k, s, w in zip(keys, segs, weights, strict=True):
        for i in range(len(s) - 199):
            total[k, s[i : i + 200]] += w
    for size in (1, 500, 1 << 20):
        found = suffix_dedup.repeated_windows(keys, segs, weights, size)
        for k, s, f in zip(keys, segs, found, strict=True):
            assert f.tolist() == [total[k, s[i : i + 200]] >= 2 for i in range(len(s) - 199)]


def test_removal_over_documents(spark):
    docs = documents(spark).select("doc_id", "text")
    rows = docs.collect()
    want = {r["doc_id"]: w for r, w in zip(rows, brute_removal([r["text"] for r in rows]), strict=True)}
    for r in queries.QUERIES["op4_suffix_dedup"](spark, SF).collect():
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    assert suffix_dedup.remove(docs.limit(0)).count() == 0


def test_hidden_names_do_not_clash(spark):
    """Columns that are named as what the operators use inside stay, with their values."""
    names = ["_text", "_k1", "_K2", "_t1", "_t2", "_places", "_block", "_row", "_offset", "_content", "_counted", "_fingerprint", "_kept", "_least"]
    rows = [(i, f"one two three four five {i // 2}", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id int", "text string", *[f"{n} string" for n in names]]))
    store = common.scratch(spark, "names")
    for out in (suffix_dedup.remove(docs), sharding.assign(docs), token_cache.count_tokens(docs, PIECES, store), simhash.one_of_each(docs)):
        found = out.select("doc_id", "text", *names).collect()
        assert found and all(tuple(r) == rows[r["doc_id"]] for r in found)
        assert len(found) == (3 if out.columns == docs.columns else 6)


# BPE

@pytest.fixture(scope="module")
def encoding():
    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_exact(spark, encoding):
    draw = random.Random(1)
    odd = ["", "a" * 700, " " * 3000, "ab" * 400, "<|endoftext|> x", "😀漢字 　x", "x" * 20000,
           *("".join(draw.choice("etaoins é漢\n1") for _ in range(400)) for _ in range(20)),
           *("".join(draw.choice("etaoins") for _ in range(n)) for n in (63, 64, 65, 255, 256, 257, 600))]
    docs = documents(spark).select("doc_id", "text").union(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*odd, None])], "doc_id bigint, text string"))
    docs = docs.withColumn("ids", F.lit("old"))
    for r in bpe.round_trip(docs, BPE, public_tokenizers.PATTERN).collect():
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.round_trip(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0
    two = bpe.decode(bpe.encode(docs.limit(20), BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in two.collect())


# Token counts

def test_counts_and_cache(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(
        [(1, None), (1, ""), (None, "<s> </s> <unk>"), (2, "same"), (2, "same"), (3, "x" * 9000)], "doc_id bigint, text string"))
    store = folder + "/store"
    first = token_cache.count_tokens(docs.withColumn("n_tokens", F.lit("old")), PIECES, store).collect()
    assert len(first) == docs.count() and all(r["n_tokens"] == len(model.encode(r["text"] or "")) for r in first)
    held = token_cache.read_store(spark, store)
    n = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert held.count() == n
    # Known texts are not encoded again; a new one is appended.
    more = docs.union(spark.createDataFrame([(7, "a new text")], "doc_id bigint, text string"))
    again = token_cache.count_tokens(more, PIECES, store)
    assert again.where("doc_id = 7 and text = 'a new text'").first()["n_tokens"] == len(model.encode("a new text"))
    assert spark.read.parquet(store).count() == n + 1
    assert token_cache.count_tokens(docs.limit(0), PIECES, folder + "/none").count() == 0


# Pipeline

def test_pipeline(spark, encoding):
    docs = documents(spark)
    columns = docs.columns
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        counts.append(kept.count())
        if name != "encoding":
            assert kept.columns == columns
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[4] == counts[5] == counts[3]
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == counts[-1] == len({r["doc_id"] for r in out})
    assert all(encoding.encode_ordinary(r["text"]) == r["ids"] for r in out)
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sum(original[r["doc_id"]] == r["text"] for r in out) > 0.8 * len(out)
    assert sorted(queries.QUERIES) == sorted(
        ["op1_pii_surrogates", "op2_toxic_segments", "op3_quality_divergence", "op4_suffix_dedup", "op5_secret_scan",
         "op6_byte_bpe", "op7_histogram_shards", "op8_simhash_groups", "op9_token_counts", "op10_decontamination"])


def test_a_second_run_of_the_query_encodes_nothing(spark):
    store = token_cache.shared_store(spark, PIECES)
    first = sorted(queries.QUERIES["op9_token_counts"](spark, SF).collect())
    held = spark.read.parquet(store).count()
    assert held >= documents(spark).select("text").distinct().count()
    assert sorted(queries.QUERIES["op9_token_counts"](spark, SF).collect()) == first
    assert spark.read.parquet(store).count() == held
