"""Q1-Q4: quotations audited against the text they are said to come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.operators import scale
from clausewright.sources import stores


def pieces(quote) -> Column:
    """Q2: the lines of a quotation in comparable form; null for a single line."""
    return F.when(
        F.contains(tx.col(quote), F.lit("\n")),
        F.filter(
            F.transform(F.split(tx.col(quote), "\n"), lambda p: tx.quotable(p)), lambda p: p != ""
        ),
    )


def elided(parts: Column, haystack: Column) -> Column:
    """Q2: two or more pieces, each long enough, found in order without overlap."""
    long_enough = F.forall(parts, lambda p: F.length(p) >= fixed.MIN_QUOTE_CHARS)

    def step(cursor, p):
        at = F.call_function("locate", p, haystack, cursor)
        return F.when(cursor < 0, cursor).when(at == 0, F.lit(-1)).otherwise(at + F.length(p))

    last = F.aggregate(parts, F.lit(1), step)
    return F.coalesce((F.size(parts) >= 2) & long_enough & (last > 0), F.lit(False))


def with_kept_prefix(df: DataFrame, failed: Column) -> DataFrame:
    """Q3: the longest leading run of tokens the clause holds, if it is most of the quote.

    Every run kept is a leading part of the normalised quote no shorter than
    the two limits, so the shortest such part is looked up first; only quotes
    that pass are scanned for the longest run. Needs quote, _said and _hay.
    """
    least = F.greatest(
        F.lit(fixed.MIN_QUOTE_CHARS), F.ceil(F.length("_said") * fixed.MIN_KEPT_SHARE).cast("int")
    )
    begins = (
        failed & F.col("_hay").isNotNull() & (F.length("_said") >= least)
        & F.contains("_hay", F.substr("_said", F.lit(1), least))
    )
    df = (
        df.withColumn("_begins", F.coalesce(begins, F.lit(False)))
        .withColumn("_plain", F.when(F.col("_begins"), F.split(tx.normal("quote"), " ")))
        .withColumn(
            "_tokens",
            F.when(
                F.col("_begins"),
                F.filter(F.split("quote", f"[\\s{tx.SPACES}]+"), lambda t: t != ""),
            ),
        )
    )
    run = lambda words, k: F.regexp_replace(
        F.array_join(F.slice(words, 1, k), " "), r"[ ,;:]+$", ""
    )
    joined = lambda k: tx.rejoined(run(F.col("_plain"), k))

    # A shorter run is a leading part of a longer one, so the longest that is held is found by halving.
    def halve(at: Column, _: Column) -> Column:
        mid = F.call_function("div", at["lo"] + at["hi"] + 1, F.lit(2)).cast("int")
        return tx.let(mid, lambda m: F.when(F.contains("_hay", joined(m)), F.struct(
            m.alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), (m - 1).alias("hi"))))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_plain"))).cast("int"))
    held = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), (F.size("_plain") - 1).alias("hi")), halve)["lo"]
    fits = lambda length: (
        (length >= fixed.MIN_QUOTE_CHARS) & (length >= fixed.MIN_KEPT_SHARE * F.length("_said")))
    best = tx.let(held, lambda k: F.when(fits(F.length(joined(k))), k))
    df = df.withColumn("_best", F.when(F.col("_begins") & (F.size("_plain") > 1), best))
    return df.withColumn("_kept", run(F.col("_tokens"), F.col("_best"))).drop(
        "_begins", "_plain", "_tokens", "_best"
    )


def audit_quotes(citations: DataFrame, clauses: DataFrame) -> DataFrame:
    """Q1-Q3: each citation verified against its clause, with the reason where it is not.

    Citations of one clause may be a third of all; they are spread. Each clause
    is normalised once, before the join. Elision is looked at only where the
    strict check fails, and the prefix only where both fail.
    """
    source = clauses.select("policy_id", "clause_id", "clause_type", tx.quotable("text").alias("_hay"))
    df = (
        scale.salted_join(
            citations, source, ["policy_id", "clause_id"], "left", spread=F.struct("answer_id", "pos")
        )
        .withColumn("_said", tx.quotable("quote"))
        .withColumn("_needle", F.trim(F.regexp_replace("_said", fixed.RE_TRAILING_REF, "")))
        .withColumn("_pieces", pieces("quote"))
    )
    blank = F.coalesce(F.col("_said"), F.lit("")) == ""
    reason = (
        F.when(F.col("_hay").isNull(), "unknown clause")
        .when(blank, "empty")
        .when(F.length("_needle") < fixed.MIN_QUOTE_CHARS, "too short")
        .when(F.contains("_hay", F.col("_needle")), "")
        .when(elided(F.col("_pieces"), F.col("_hay")), "")
        .otherwise("not found")
    )
    # A quotation that failed for any reason may still have a true opening.
    df = with_kept_prefix(df.withColumn("_reason", reason), F.col("_reason") != "")
    kept = F.col("_kept").isNotNull()
    return (
        df.withColumn("verified", (F.col("_reason") == "") | kept)
        .withColumn("reason", F.when(kept, "").otherwise(F.col("_reason")))
        .withColumn("trimmed", kept)
        .withColumn("quote", F.coalesce("_kept", "quote"))
        .drop("_hay", "_said", "_needle", "_pieces", "_reason", "_kept")
    )


def verified_prefixes(audited: DataFrame) -> DataFrame:
    """Q3: the citations of which a true opening is kept.

    They are picked as an array is taken apart: a filter would move below the audit, with each step written
    into the next, and work every step out again for each place that reads it.
    """
    rest = [c for c in audited.columns if c != "quote"]
    return audited.select(*rest, F.explode(F.when(F.col("trimmed"), F.array("quote"))).alias("quote"))


# --- Q4: which documents hold a passage -------------------------------------

BROADCAST_ROWS = 50_000  # candidate pairs with their passage
SHINGLE = 6
EDGE = 12


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def _shingles(tokens: Column) -> Column:
    n = F.size(tokens) - (SHINGLE - 1)
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.slice(tokens, i + 1, SHINGLE))),
    ).otherwise(F.array().cast("array<bigint>"))


def _grams(token: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(token) - (EDGE - 1)), lambda i: F.xxhash64(F.substr(token, i, F.lit(EDGE)))
    )


def _long_token_grams(tokens: Column) -> Column:
    return F.flatten(F.transform(F.filter(tokens, lambda t: F.length(t) >= EDGE), _grams))


def passage_keys(passages: DataFrame) -> DataFrame:
    """The keys a document must have if it holds the passage.

    The first and last word of a passage may be parts of words in a document;
    the words between are whole. So long passages are keyed by runs of inner
    words, shorter ones by single inner words, and those without an inner word
    by twelve-character runs of their long words (25 characters in at most two
    words leave one of twelve).
    """
    tokens = F.split("needle", " ")
    inner = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    kind = (
        F.when(F.size(tokens) >= SHINGLE + 2, "run").when(F.size(tokens) >= 3, "word").otherwise("gram")
    )
    keys = (
        F.when(F.size(tokens) >= SHINGLE + 2, _shingles(inner))
        .when(F.size(tokens) >= 3, F.transform(inner, lambda t: F.xxhash64(t)))
        .otherwise(_long_token_grams(tokens))
    )
    return passages.select("passage_id", kind.alias("kind"), F.explode(F.array_distinct(keys)).alias("key"))


def find_passages(passages: DataFrame, documents: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Q4: (passage_id, doc_id) of every document that holds a passage.

    passages(passage_id, text), documents(doc_id, text). Documents are reduced
    to the keys some passage has, the rarest of a passage's keys picks its
    candidates, and the text is compared for those only. Passages under 25
    characters prove nothing and are left out, as in Q1.

    The candidate pairs are written once and counted. Up to `broadcast_rows` of
    them are broadcast, so that no text moves; more are joined on the document.
    """
    wanted = passages.select("passage_id", tx.quotable("text").alias("needle")).filter(
        F.length("needle") >= fixed.MIN_QUOTE_CHARS
    )
    keyed = stores.written_once(passage_keys(wanted), "passage-keys")
    kinds = {r["kind"] for r in keyed.select("kind").distinct().collect()}  # three at most
    hay = documents.select("doc_id", tx.quotable("text").alias("hay"))
    tokens = F.col("_t")
    labelled = lambda kind, xs: F.transform(
        F.array_distinct(xs), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    )
    doc_keys = (
        hay.select("doc_id", _tokens(F.col("hay")).alias("_t"))
        .select(
            "doc_id",
            F.explode(F.concat(*[labelled(k, made) for k, made in {
                "run": _shingles(tokens),
                "word": F.transform(tokens, lambda t: F.xxhash64(t)),
                "gram": _long_token_grams(tokens),
            }.items() if k in kinds], F.array().cast("array<struct<kind:string,key:bigint>>"))).alias("k"),
        )
        .select("doc_id", "k.kind", "k.key")
    )
    # Only keys some passage has.
    met = stores.written_once(
        doc_keys.join(keyed.select("kind", "key").distinct(), ["kind", "key"], "left_semi"), "met-keys")
    counts = met.groupBy("kind", "key").agg(F.count("*").alias("n"))
    rarest = (
        keyed.join(counts, ["kind", "key"], "left")
        .groupBy("passage_id")
        .agg(F.min_by(F.struct("kind", "key"), F.struct(F.coalesce("n", F.lit(0)), "key")).alias("k"))
        .select("passage_id", "k.kind", "k.key")
    )
    candidates = met.join(rarest, ["kind", "key"]).select("passage_id", "doc_id")
    needles = stores.written_once(candidates.join(wanted, ["passage_id"]), "passage-candidates")
    few = needles.count() <= broadcast_rows
    return (
        hay.join(F.broadcast(needles) if few else needles, "doc_id")
        .filter(F.contains("hay", F.col("needle")))
        .select("passage_id", "doc_id")
    )
