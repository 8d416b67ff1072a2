import hashlib
import os
from datetime import datetime

from pyspark.sql import functions as F

from clausewright.operators import evalkit
from clausewright.sources import stores
from clausewright.streaming import incremental, status


def test_clause_store_replaces_documents(spark, folder):
    path = os.path.join(folder, "clauses")
    schema = "doc_id long, order_idx int, text string"
    stores.write_clauses(spark.createDataFrame([(d, i, "old") for d in range(20) for i in range(3)], schema), path)
    stores.write_clauses(spark.createDataFrame([(5, 0, "new"), (99, 0, "new")], schema), path)
    rows = stores.read_store(spark, path).collect()
    assert len(rows) == 20 * 3 - 3 + 2
    assert [r.text for r in rows if r.doc_id == 5] == ["new"] and sum(r.doc_id == 7 for r in rows) == 3


def test_a_small_batch_touches_no_other_file(spark, folder):
    path = os.path.join(folder, "clauses")
    schema = "doc_id long, order_idx int, text string"

    def files():
        return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}

    stores.write_clauses(spark.createDataFrame([(d, 0, "old") for d in range(1000)], schema), path, "first")
    before = files()
    ten = spark.createDataFrame([(d, 0, "new") for d in range(10)], schema)
    stores.write_clauses(ten, path, "second")
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    stores.write_clauses(ten, path, "second")  # the same batch again, as after a failure
    rows = stores.read_store(spark, path).collect()
    assert len(rows) == 1000 and sum(r.text == "new" for r in rows) == 10
    stores.compact(spark, path, path + "_compact")
    assert sorted(map(tuple, stores.read_store(spark, path + "_compact").collect())) == sorted(map(tuple, rows))


def test_heads_delete_and_order_revisions(spark, folder):
    path, target = os.path.join(folder, "clauses"), os.path.join(folder, "compact")
    rows, docs = "doc_id long, order_idx int, text string", "doc_id long, revision long, arrived timestamp"
    day = [datetime(2024, 1, d) for d in range(1, 9)]

    def write(clauses, documents, batch=None):
        stores.write_clauses(spark.createDataFrame(clauses, rows), path, batch, spark.createDataFrame(documents, docs))

    write([(1, 0, "r1"), (1, 1, "r1"), (2, 0, "r5"), (3, 0, "kept"), (4, 0, "a")], [(1, 1, day[1]), (2, 5, day[1]), (3, None, day[1]), (4, 7, day[1])], "7")
    write([(2, 0, "r3")], [(1, 2, day[2]), (2, 3, day[2])])  # a blank revision of 1, a late old one of 2
    write([(4, 0, "b")], [(4, 7, day[3])])  # equal revisions: the later arrival
    shown = lambda at: {(r.doc_id, r.text) for r in stores.read_store(spark, at).collect()}
    assert shown(path) == {(2, "r5"), (3, "kept"), (4, "b")}
    # Rows whose heads were never written have not happened.
    spark.createDataFrame([(3, 0, "lost", "3:0")], rows + ", clause_key string").withColumn("batch", F.lit("b-dead")).write.mode("append").partitionBy("batch").parquet(f"{path}/rows")
    assert shown(path) == {(2, "r5"), (3, "kept"), (4, "b")}
    stores.compact(spark, path, target)
    stores.write_clauses(spark.createDataFrame([(1, 0, "older")], rows), target, None, spark.createDataFrame([(1, 1, day[7])], docs))
    assert shown(target) == {(2, "r5"), (3, "kept"), (4, "b")}
    heads = {r.doc_id: (r.revision, r.n_rows) for r in stores.read_heads(spark, target).collect()}
    assert heads == {1: (2, 0), 2: (5, 1), 3: (None, 1), 4: (7, 1)}


def test_two_streams_share_a_store(spark, folder):
    store = os.path.join(folder, "store")
    text = "SECTION 1 BENEFITS\n1.1 Stay\nWe pay.\n1.2 Day care\nWe pay less."
    for name, rows in (("a", [(1, text, 1), (2, text, 1)]), ("b", [(2, " ", 2), (3, text, 1)])):
        arrivals = os.path.join(folder, name)
        spark.createDataFrame(rows, "doc_id long, text string, revision long").write.parquet(arrivals)
        for _ in range(2):  # the second time nothing is new
            incremental.stream_clauses(spark, arrivals, store, os.path.join(folder, f"cp-{name}")).awaitTermination(120)
    assert sorted({r.doc_id for r in stores.read_store(spark, store).collect()}) == [1, 3]
    rows = stores.analysis_rows(
        stores.read_store(spark, store), spark.createDataFrame([(1, 0, "x"), (3, 0, "x")], "doc_id long, order_idx int, kind string"),
        spark.createDataFrame([(1, 0, 1.0), (3, 0, 1.0)], "doc_id long, order_idx int, impact double"), "m", "v")
    analyses = os.path.join(folder, "analyses")
    stores.write_analyses(rows, analyses, "one", stores.read_heads(spark, store))
    incremental.clause_batch(spark.createDataFrame([(3, text, 2)], "doc_id long, text string, revision long"), store)
    assert [r.doc_id for r in stores.read_analyses(spark, analyses, store).collect()] == [1]


def test_a_shorter_correction_stands(spark):
    rows = [(1, "the first and longer text", 1), (1, "short", 2), (2, "only", None)]
    got = incremental.newest_revisions(spark.createDataFrame(rows, "doc_id long, text string, revision long"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "short", 2: "only"}


def test_reproducibility_compares_the_two_least_texts(spark):
    rows = [("g", t) for t in ["zzzz", "aaab", "b", "zzyy", "aaaa", "aaaa"]] + [("one", "x")]
    got = {r.k: r for r in evalkit.reproducibility(spark.createDataFrame(rows, "k string, text string"), ["k"], "text").collect()}
    assert (got["g"].outputs, got["g"].distinct_outputs, got["g"].first_difference) == (6, 5, 3)
    assert (got["one"].distinct_outputs, got["one"].first_difference) == (1, None)


def test_analysis_rows_skip_what_is_not_scored(spark, folder):
    keys = "doc_id long, order_idx int"
    clauses = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], keys)
    analyses = spark.createDataFrame([(1, 0, "coverage"), (1, 1, "exclusion")], keys + ", clause_type string")
    scores = spark.createDataFrame([(1, 1, 5.0)], keys + ", impact double")
    rows = stores.analysis_rows(clauses, analyses, scores, "m", "v1")
    assert [(r.order_idx, r.model, r.prompt_version) for r in rows.collect()] == [(1, "m", "v1")]
    stores.write_analyses(rows, os.path.join(folder, "a"))
    assert stores.read_store(spark, os.path.join(folder, "a")).count() == 1


def test_fingerprints(spark, folder):
    for name, body in [("a.bin", b"one"), ("b.bin", b"two")]:
        with open(os.path.join(folder, name), "wb") as f:
            f.write(body)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame(
        [("a.bin", digest(b"one")), ("b.bin", digest(b"2")), ("c.bin", "x")], "name string, sha256 string")
    got = stores.fingerprint_audit(stores.read_binary(spark, folder), manifest)
    assert {r.name: r.status for r in got.collect()} == {"a.bin": "ok", "b.bin": "changed", "c.bin": "missing"}


def test_latest_status_stream_equals_batch(spark, folder):
    rows = [(d % 5, s, datetime(2024, 1, 1, 0, s % 50), ["pending", "ready", "failed"][s % 3], s / 100) for s, d in
            enumerate(range(100))]
    schema = "doc_id long, seq long, ts timestamp, status string, progress double"
    updates = spark.createDataFrame(rows, schema)
    source = os.path.join(folder, "in")
    for part in range(2):
        updates.filter(F.col("seq") % 2 == part).coalesce(1).write.mode("append").parquet(source)
    seen = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = status.stream_latest_status(
        stream, os.path.join(folder, "cp"),
        lambda batch, _id: seen.update({r.doc_id: tuple(r) for r in batch.collect()}))
    q.awaitTermination(120)
    assert sorted(seen.values()) == sorted(map(tuple, status.latest_status(updates).collect()))


def test_finished_documents_leave_the_state(spark, folder):
    schema = "doc_id long, seq long, ts timestamp, status string, progress double"
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    parts = [
        [(1, 1, at(1), "pending", 0.0), (1, 2, at(1, 30), "ready", 1.0), (2, 1, at(1), "pending", None)],
        [(3, 1, at(9), "pending", 0.1)],  # moves the watermark past the time of 1
        [(4, 1, at(10), "failed", 0.0)],  # the state of 1 goes
        [(1, 1, at(1), "pending", 0.0), (2, 2, at(11), "ready", 1.0), (1, 9, at(11), "pending", 0.5)],
    ]
    source, seen, sizes = os.path.join(folder, "in"), [], []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = status.stream_bounded_status(
            spark.readStream.schema(schema).parquet(source), os.path.join(folder, "cp"),
            lambda batch, _id: seen.append({r.doc_id: (r.status, r.progress, r.updates) for r in batch.collect()}))
        q.awaitTermination(120)
        sizes += [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators][-1:]
    told = {}
    for batch in seen:
        told.update(batch)
    assert seen[0] == {1: ("ready", 1.0, 2), 2: ("pending", None, 1)}
    # The straggler of 1 is dropped; its new update starts afresh, that of 2 goes on.
    assert told == {1: ("pending", 0.5, 1), 2: ("ready", 1.0, 2), 3: ("pending", 0.1, 1), 4: ("failed", 0.0, 1)}
    assert max(sizes) <= 4


def test_clause_stream_is_idempotent_per_document(spark, folder):
    arrivals, store = os.path.join(folder, "in"), os.path.join(folder, "store")
    docs = [(d, f"SECTION 1 BENEFITS\n1.1 Stay {d}\nWe pay.\n1.2 Day care\nWe pay less.") for d in range(6)]

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(arrivals)
        incremental.stream_clauses(spark, arrivals, store, os.path.join(folder, "cp")).awaitTermination(120)

    arrive(docs)
    arrive([(2, "1.1 Replaced\nWe pay more."), (9, "1.1 New\nWe pay.")])
    rows = stores.read_store(spark, store).collect()
    assert len(rows) == 5 * 2 + 1 + 1
    assert [r.heading for r in rows if r.doc_id == 2] == ["1.1 Replaced"]


def history(spark, rows):
    return spark.createDataFrame(rows, "case_id string, run long, got string, fresh boolean")


def test_majority_needs_more_than_half(spark):
    rows = [("a", "x", "x"), ("a", "x", "x"), ("a", "y", "x"), ("b", "x", "x"), ("b", "y", "x"), ("b", "z", "x"),
            ("c", "x", "x"), ("c", "y", "x")]
    got = {r.case_id: (r.majority, r.ok, r.unanimous) for r in evalkit.majority(
        spark.createDataFrame(rows, "case_id string, got string, expected string")).collect()}
    assert got == {"a": ("x", True, False), "b": (None, False, False), "c": (None, False, False)}


def test_run_comparison_and_watch_list(spark):
    h = history(spark, [
        ("a", 1, "x", True), ("a", 5000, "y", True), ("a", 9000, "y", False), ("a", 9001, "x", False),
        ("b", 1, "y", True), ("b", 2, "x", True), ("c", 9, "x", True)])
    expected = spark.createDataFrame([(c, "x") for c in "abc"], "case_id string, expected string")
    got = {(r.case_id, r.run): (r.outcome, r.drifted) for r in evalkit.compare_runs(
        h, expected, F.floor(F.col("run") / 1000)).collect()}
    assert got[("a", 1)][0] == "no baseline" and got[("a", 5000)][0] == "broken"
    assert got[("a", 9000)] == ("replayed", False) and got[("a", 9001)] == ("replayed", True)
    assert got[("b", 2)][0] == "fixed" and got[("c", 9)][0] == "no baseline"
    assert {r.case_id for r in evalkit.watch_list(h, expected).collect()} == {"a", "b"}
    assert [r.case_id for r in evalkit.unstable_cases(h).orderBy("case_id").collect()] == ["a", "b"]


def test_metrics_when_nothing_is_citable(spark):
    schema = ("answer_id long, case_id long, verdict string, expected string, required array<string>, forbidden array<string>")
    answers = spark.createDataFrame([(1, 1, "covered", "covered", [], [])], schema)
    cites = spark.createDataFrame([], "answer_id long, clause_id string, effect string, verified boolean, flag boolean")
    row = evalkit.run_metrics(evalkit.answer_rows(answers, cites)).collect()[0]
    assert (row.citation_recall, row.false_citation_rate, row.detection_integrity) == (1.0, 0.0, 1.0)


def test_missing_prediction_is_only_a_miss(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k long, expected string")
    pred = spark.createDataFrame([(1, "a"), (3, "c")], "k long, predicted string")
    got = {r["class"]: (r.support, r.tp, r.fp) for r in evalkit.class_metrics(evalkit.confusion(labels, pred, "k")).collect()}
    assert got == {"a": (2, 1, 0), "b": (1, 0, 0), "c": (0, 0, 1)}


def test_first_difference(spark):
    rows = [("g", "abc"), ("g", "abd"), ("h", "same"), ("h", "same"), ("i", "ab"), ("i", "abc")]
    got = {r.g: (r.distinct_outputs, r.first_difference) for r in evalkit.reproducibility(
        spark.createDataFrame(rows, "g string, t string"), ["g"], "t").collect()}
    assert got == {"g": (2, 2), "h": (1, None), "i": (2, 2)}


def test_every_registered_query_has_a_plan(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 100
    assert entry.entry(spark).limit(1).count() == 1
