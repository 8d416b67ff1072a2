"""Near-duplicates of the pipeline: recall on planted copies, exact verification, groups, rows without an id."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from clausewright.llm import common, near, quality


def jaccard(a, b):
    a, b = (set(map(int, near.shingles(t.encode()))) for t in (a, b))
    return len(a & b) / len(a | b)


def copy_at(rng, words, share):
    """A copy with words replaced until the similarity is just above `share`."""
    best = words
    for i in rng.sample(range(len(words)), len(words)):
        trial = [*best[:i], f"new{rng.random()}", *best[i + 1 :]]
        if jaccard(" ".join(words), " ".join(trial)) < share:
            break
        best = trial
    return " ".join(best)


def test_planted_copies_meet(spark):
    rng, rows, twins = random.Random(1), [], 0
    for k, share in enumerate([0.8, 0.85, 0.9, 0.95] * 25):
        words = [f"w{rng.randrange(20_000)}" for _ in range(rng.choice([200, 400]))]
        text = copy_at(rng, words, share)
        assert share <= jaccard(" ".join(words), text) < share + 0.05
        rows += [(2 * k, " ".join(words)), (2 * k + 1, text)]
        twins += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, None).collect())
    assert kept == list(range(0, 2 * twins, 2))


def test_bands_have_the_recall():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        draw = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
        a, b = draw[:900], draw[100:]  # similarity 0.8
        met += bool(set(near.bands(np.sort(a))) & set(near.bands(np.sort(b))))
    assert met >= 299


def test_groups_are_those_of_all_pairs(spark):
    rng, texts = random.Random(3), []
    for _ in range(12):  # families that drift away from their first text, in chains
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(8):
            texts.append(" ".join(words))
            for i in rng.sample(range(120), rng.choice([1, 3, 6])):
                words[i] = f"w{rng.randrange(5000)}"
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in near.one_of_each(docs).collect()}
    assert kept == {find(i) for i in range(len(texts))} and 12 < len(kept) < len(texts)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base), (None, base + " x"), (None, base + " y"), (3, None), (4, ""), (5, "a b"), (6, "A  b"), (7, "a c"), (7, "a c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 5, 7]
    named = docs.union(spark.createDataFrame([(9, base + " z")], docs.schema))
    assert sorted((r["doc_id"] or 0) for r in near.one_of_each(named).collect()) == [3, 5, 7, 9]
    assert near.one_of_each(docs.limit(0)).count() == 0


def cloud(rng, size):
    """Copies of one text of 60 words with three words replaced in each: most share much, hardly two are near."""
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    out = []
    for _ in range(size):
        words = list(base)
        for i in rng.sample(range(60), 3):
            words[i] = f"n{rng.random()}"
        out.append(" ".join(words))
    return out


def test_pairs_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    made = []
    pairs = near._prefix_pairs

    def counted(filed):
        out = pairs(filed)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(near, "_prefix_pairs", counted)
    for size in (300, 600):
        made.append(0)
        docs = spark.createDataFrame(list(enumerate(cloud(random.Random(5), size))), "doc_id bigint, text string")
        near.one_of_each(docs).count()
    assert made[1] <= 2.2 * made[0] + 60


def test_prefixes_lose_no_pair(spark):
    rng, texts = random.Random(6), []
    for _ in range(6):  # lengths and changes at and around the limit, inserted words too
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 61, 120, 200]))]
        for _ in range(8):
            texts.append(" ".join(words))
            for _ in range(rng.choice([0, 1, 2])):
                words.insert(rng.randrange(len(words)), f"w{rng.randrange(60)}")
    sets = {near.node(s): s for s in (near.shingles(t.encode()) for t in texts)}
    table = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in sets.items()], "node bigint, set array<bigint>")
    parity = table.select("node", near._parity(F.col("set")).alias("parity"))
    filed = near._prefixes(table).withColumn("root", F.col("node")).join(parity, "node")
    found = {frozenset(r) for r in near._verified(near._prefix_pairs(filed), table).collect()}
    want = {frozenset((a, b)) for (a, x), (b, y) in combinations(sets.items(), 2)
            if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))}
    assert found == want and len(want) > 10


def test_names_of_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "A b c d e f", 8, "y")], "doc_id int, text string, _node int, _KEPT string")
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 7, "x")]


def test_operator_8_brings_the_first_candidates(spark):
    """Pairs of its fingerprints: equal ones with the least node, near ones by their nodes, none of an empty set."""
    rows = [(5, 10, 0b0), (3, 10, 0b0), (7, 10, 0b111), (9, 10, 0b1111 << 40), (11, 30, 0b1), (1, 0, 0b0)]
    nodes = spark.createDataFrame(rows, "node long, n int, fp long")
    found = {tuple(sorted(r)) for r in near._fingerprint_pairs(nodes).collect()}
    # 11 is too long to be similar to any; 9 is four bits away; 1 holds no shingle.
    assert found == {(3, 5), (3, 7)}
    assert near.shingles(b"a b c d e f").size == 2
    from clausewright.llm import simhash
    assert simhash.of_hashes(near.shingles(b"one two three four five")) == simhash.fingerprint(b"one two three four five", 5)


def test_no_plan_of_the_pipeline_runs_python_twice(spark, capsys, monkeypatch):
    # Two passes in one task take two workers, and each worker that is kept later holds a vocabulary.
    passes, stored = [], common.stored

    def seen(df, name):
        capsys.readouterr()
        df.explain()
        passes.append((capsys.readouterr().out.count("ArrowEvalPython"), name))
        return stored(df, name)

    monkeypatch.setattr(common, "stored", seen)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
    assert max(passes)[0] == 1 and sum(n for n, _ in passes) == 7


def test_a_language_of_failed_texts_has_no_reference(spark):
    good = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "few words", "de"), (2, None, "de"), (3, good, "en")], "doc_id bigint, text string, lang string")
    assert list(quality.reference(docs).by_language) == ["en"]
    assert quality.reference(docs.where("lang = 'de'")) == quality.Reference()
