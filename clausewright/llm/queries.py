"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.llm import bpe, common, conversation_repair, decontaminate, line_dedup, pii, prefix_trie, quality, secrets, sharding, simhash, suffix_dedup, token_cache, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_toxic_segments")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_passages")


@query("op3_quality_divergence")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.filter_quality(docs).select("doc_id", *quality.FIELDS)


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "cast(coalesce(octet_length(text), 0) AS bigint) AS n_bytes")
    return suffix_dedup.remove(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find(docs, secrets.train(secrets.samples(docs))))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = common.table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') AS text")
    return bpe.digest(bpe.round_trip(docs, path, pattern))


@query("op7_histogram_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The checksum is made before the exchange, so that no text moves.
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.assign(docs, identity=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op8_simhash_groups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classify(common.table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "cast(coalesce(octet_length(text), 0) AS bigint) AS n_bytes")
    pieces = tokenizer("piece_bpe_32k.model")
    counted = token_cache.count_tokens(docs, pieces, token_cache.shared_store(spark, pieces))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 AS over_limit")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontamination", rf"""
WITH b AS (
    SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark
), grams AS (
    SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0
), g AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM grams
), d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), win AS (
    SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n
), hit AS (
    SELECT DISTINCT r, i, win.n, item_id FROM win JOIN g ON g.n = win.n AND g.gram = array_to_string(w[i : i + win.n - 1], ' ')
), cover AS (
    SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, common.table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(scanned)


# Line dedup in SQL: the same keys, documents counted without regard to repeated rows.
@query("op11_line_dedup", r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT r, doc_id, i, lines[i] AS line, trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
    FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), shared AS (
    SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key
    HAVING count(DISTINCT doc_id) + CAST(count(*) > count(doc_id) AS BIGINT) >= 2
), marked AS (
    SELECT r, doc_id, i, line, shared.key IS NOT NULL AND l.doc_id IS DISTINCT FROM shared.first AS goes
    FROM l LEFT JOIN shared ON l.key = shared.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY r
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# Conversations as they are told: turns in order, null first; equal turn numbers by role and text.
def _told(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    filled = rows.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return filled.withColumn("pos", F.row_number().over(order))


def _rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, role, text) after the heads of every hundredth conversation, and all conversations."""
    told = common.stored(_told(rows), "told")
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(6)).cast("int")
    convs = told.select("conv_id").distinct().select(
        "conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    # A head has five turns at most and goes to a hundred conversations at most.
    heads = told.where("pos <= 5 AND conv_id % 100 = 0").select(
        F.col("conv_id").alias("base"), "pos", "role", "text")
    have = heads.groupBy("base").agg(F.max("pos").alias("have"))
    convs = common.stored(convs.join(have, "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")), "told-convs")
    taken = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "role", "text")
    own = told.join(convs, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    return taken.union(own), convs.select("conv_id")


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query("op12_prefix_trie", f"""
WITH told AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM told GROUP BY conv_id
), heads AS (
    SELECT a.conv_id, a.turns, b.turns AS base, CAST({_CRC.format("CAST(a.conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h
    FROM whole a LEFT JOIN whole b ON b.conv_id = a.conv_id - a.conv_id % 100
), rebuilt AS (
    SELECT conv_id, list_concat(coalesce(base, [])[1 : h], turns[h + 1 : len(turns)]) AS t FROM heads
), member AS (
    SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt
), node AS (
    SELECT d, t[1 : d] AS k, min(conv_id) AS conv_id, count(*) AS n,
           string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(t) = d) AS ends
    FROM member GROUP BY d, k
), worth AS (
    SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(k[d].text) END AS own FROM node
), kids AS (
    SELECT d - 1 AS d, k[1 : d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), below AS (
    SELECT u.own, coalesce(n_children, 0) = 0 AS leaf, u.k, unnest(range(0, u.d + 1)) AS d
    FROM worth u LEFT JOIN kids USING (d, k)
), sums AS (
    SELECT d, k[1 : d] AS k, sum(own) AS saved, count(*) FILTER (leaf) AS n_leaves FROM below GROUP BY ALL
)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, coalesce(n_children, 0) AS n_children,
       s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM worth w JOIN sums s USING (d, k) LEFT JOIN kids c USING (d, k)
LEFT JOIN node p ON p.d = w.d - 1 AND p.k = w.k[1 : w.d - 1]
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = _rebuilt(common.table(spark, sf_dir, "conversations"))
    nodes, ends = prefix_trie.build(turns, convs)
    digests = prefix_trie.end_digests(ends).select(
        F.unhex("name").alias("end_name"), F.col("depth").alias("end_depth"), "ends_sha256")
    met = nodes.join(digests, (F.col("name") == F.col("end_name")) & (F.col("depth") == F.col("end_depth")), "left")
    return met.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, role, text) after the damage of the query; equal turn numbers by role and text."""
    space = F.lit(" ")
    told = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    mark = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    copies = told.withColumn("m", mark).where("m <> 0").withColumn(
        "copy", F.explode(F.expr("if(m = 3, array(0, 1), array(0))")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    return copies.withColumn("pos", F.row_number().over(order)).select(
        "conv_id", "turn", "pos", F.expr("if(m = 4, 'user', role)").alias("role"),
        F.expr("CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"))


def _op13_sql() -> str:
    """States as four (cost, audit, told) structs, whose least is the cheapest, then the audit least by ASCII."""
    def plus(v: str, cost: str, op: str, line: str = "") -> str:
        text = f"{v}.told" if not line else f"concat({v}.told, CASE WHEN {v}.told = '' AND NOT {v}.some THEN '' ELSE chr(10) END, {line})"
        some = "TRUE" if line else f"{v}.some"
        return f"{{'cost': {v}.cost + {cost}, 'audit': {v}.audit || '{op}', 'told': {text}, 'some': {some}}}"

    never = "{'cost': 1000000000, 'audit': '~', 'told': '', 'some': false}"
    ins = {"n": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
    follow = {"n": "su", "s": "u", "u": "a", "a": "u"}

    def insertion(src: str, dst: str) -> str:
        """The states after at most one more insertion."""
        out = []
        for state in "nsua":
            ways = [f"{src}.{state}"] + [plus(f"{src}.{o}", "3", "I", f"'{w}:'") for o, (i, w) in ins.items() if i == state]
            out.append(f"'{state}': list_min([{', '.join(ways)}])")
        return f"{{{', '.join(out)}}} AS {dst}"

    def turn(src: str, dst: str) -> str:
        out = []
        for state in "nsua":
            ways = [plus(f"{src}.{state}", "4", "D")]
            for o, nexts in follow.items():
                if state in nexts:
                    ways.append(f"CASE WHEN NOT gone AND initial = '{state}' THEN {plus(f'{src}.{o}', 'short', 'K', 'concat(role, chr(58), text)')} ELSE {never} END")
                if ins[o][0] == state:
                    given = f"concat('{ins[o][1]}:', text)"
                    ways.append(f"CASE WHEN NOT gone THEN {plus(f'{src}.{o}', '3 + short', 'R', given)} ELSE {never} END")
            out.append(f"'{state}': list_min([{', '.join(ways)}])")
        return f"{{{', '.join(out)}}} AS {dst}"

    crc = _CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    zero = "{'cost': 0, 'audit': '', 'told': '', 'some': false}"
    return f"""
WITH RECURSIVE hit AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS m FROM conversations
), copied AS (
    SELECT *, unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE m <> 0
), told AS (
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
           CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
           CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM copied
), seen AS (
    SELECT *, left(role, 1) AS initial, right(rtrim(text, {spaces}), 1) AS tip,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM told
), bad AS (
    SELECT *, CASE WHEN tip = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tip NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM seen
), step AS (
    SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS short FROM bad
), counts AS (
    SELECT conv_id, max(pos) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM step GROUP BY conv_id
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'n': {zero}, 's': {never}, 'u': {never}, 'a': {never}}} AS v FROM counts
    UNION ALL
    SELECT conv_id, pos, v FROM (
        SELECT conv_id, pos, {turn('y', 'v')} FROM (
            SELECT *, {insertion('x', 'y')} FROM (
                SELECT step.conv_id, step.pos, role, text, initial, gone, short, {insertion('walk.v', 'x')}
                FROM walk JOIN step ON step.conv_id IS NOT DISTINCT FROM walk.conv_id AND step.pos = walk.pos + 1)))
), ended AS (
    SELECT conv_id, pos, list_min([y.n, y.a]) AS best FROM (SELECT *, {insertion('x', 'y')} FROM (SELECT *, {insertion('v', 'x')} FROM walk))
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(best.told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.pos = c.n
"""


@query("op13_conversation_repair", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    checked = common.stored(conversation_repair.faults(_damaged(rows)), "repair-turns")
    edited = common.stored(conversation_repair.edit_table(checked), "repair-edits")
    found = conversation_repair.summary(checked, edited).withColumnRenamed("conv_id", "f")
    gaps = checked.groupBy(F.col("conv_id").alias("g")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    digests = conversation_repair.digests(conversation_repair.repair(checked, edited)).withColumnRenamed("conv_id", "d")
    every = rows.select("conv_id").distinct()
    met = (
        every.join(found, F.col("conv_id").eqNullSafe(F.col("f")), "left")
        .join(gaps, F.col("conv_id").eqNullSafe(F.col("g")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d")), "left"))
    zero = F.lit(0).cast("bigint")
    return met.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
