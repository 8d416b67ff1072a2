"""Tables of model requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions import fixed

_TEXTS = T.ArrayType(T.StringType())
ENTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ["id", "clause_type", "plain_language", "what_it_means"]]
    + [T.StructField(n, _TEXTS) for n in ["triggers", "monetary_limits", "time_windows", "exceptions"]]
    + [
        T.StructField(n, T.IntegerType())
        for n in [
            "waiting_period_value", "copay_percent", "copay_min_age_at_inception", *fixed.DAILY_CAPS,
            "cover_window_value", "likelihood", "severity",
        ]
    ]
    + [T.StructField(n, T.StringType()) for n in ["waiting_period_unit", "cover_window_unit", "cover_window_anchor"]]
)
PAYLOAD = T.StructType([T.StructField("clauses", T.ArrayType(ENTRY))])


def parse_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """M1: one row per entry of each response; texts trimmed, blank list items dropped.

    A response that is not JSON of this shape has no rows here; M2 reports it.
    `copies` counts the entries of the response with the same id.
    """
    read = responses.withColumn("_p", F.from_json(response, PAYLOAD))
    entries = F.transform(
        F.col("_p.clauses"),
        lambda c: F.struct(
            c.alias("entry"),
            F.size(F.filter(F.col("_p.clauses"), lambda o: o["id"] == c["id"])).alias("copies"),
        ),
    )
    keys = [c for c in responses.columns if c != response]
    flat = read.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.copies", "e.entry.*")
    tidy = lambda name: F.filter(
        F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != ""
    )
    for name in ["plain_language", "what_it_means"]:
        flat = flat.withColumn(name, F.trim(name))
    for name in ["triggers", "monetary_limits", "time_windows", "exceptions"]:
        flat = flat.withColumn(name, tidy(name))
    return flat


def _outside(name: str, allowed: list, required: bool = False) -> Column:
    c = F.col(name)
    bad = ~c.isin(allowed)
    return F.coalesce(bad, F.lit(True)) if required else F.coalesce(bad, F.lit(False))


def validate(entries: DataFrame, asked: str = "asked_id") -> DataFrame:
    """M2: every entry with the reasons it is rejected; none means valid."""
    ratings = [1, 2, 3, 4, 5]
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("id").eqNullSafe(F.col(asked)), "id not asked for"),
            F.when(_outside("clause_type", fixed.CLAUSE_TYPES, True), "unknown type"),
            F.when(_outside("likelihood", ratings, True), "likelihood out of range"),
            F.when(_outside("severity", ratings, True), "severity out of range"),
            F.when(_outside("waiting_period_unit", fixed.PERIOD_UNITS), "unknown waiting unit"),
            F.when(_outside("cover_window_unit", fixed.PERIOD_UNITS), "unknown window unit"),
            F.when(_outside("cover_window_anchor", fixed.WINDOW_ANCHORS), "unknown anchor"),
            F.when(F.col("copies") > 1, "repeated id"),
        )
    )
    return entries.withColumn("reasons", reasons)


def unreadable(responses: DataFrame, response: str = "response") -> DataFrame:
    """M2: responses that hold no entry at all."""
    parsed = F.from_json(response, PAYLOAD)
    return responses.filter(F.coalesce(F.size(parsed["clauses"]), F.lit(0)) <= 0)


def missing_rows(clauses: DataFrame, analyses: DataFrame, keys: list[str]) -> DataFrame:
    """M3: clauses with no analysis, to be asked again one by one."""
    return clauses.join(analyses.select(*keys), keys, "left_anti")


def in_field_order(c: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every struct in it in sorted order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[in_field_order(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: in_field_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(
            c, lambda _, v: in_field_order(v, kind.valueType)))))
    return c


def content_key(
    model: Column, messages: Column, schema: Column, options: Column,
    cache_precision: Column | None = None, runtime_version: Column | None = None,
    messages_type: T.DataType | None = None,
) -> Column:
    """M9: sha256 of every input that could change the response, in sorted field order.

    With `messages_type`, the type of the messages, their fields are sorted too.
    `options` is a map or a struct; a map is sorted by key first. The cache
    precision counts only when it is not f16, the runtime version only when
    it is given: a null field is not written.
    """
    fields = {
        "kv_cache_type": None if cache_precision is None
        else F.when(cache_precision != "f16", cache_precision),
        "messages": messages if messages_type is None else in_field_order(messages, messages_type), "model": model, "options": options,
        "runtime_version": runtime_version, "schema": schema,
    }
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items() if c is not None])), 256)


def sorted_map(options: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(options)))


def cache_hits(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests answered from the store."""
    return requests.join(store.select("key", "response"), "key")


def cache_misses(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct requests with no stored response.

    One row per key is kept before the join, so a request asked a million
    times is one row by then.
    """
    once = requests.dropDuplicates(["key"])
    return once.join(store.select("key"), "key", "left_anti")


def upsert(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert or replace; the newest row of a key wins, fresh over stored."""
    columns = store.columns
    both = store.withColumn("_fresh", F.lit(0)).unionByName(fresh.select(*columns).withColumn("_fresh", F.lit(1)))
    rest = [c for c in columns if c != "key"]
    newest = both.groupBy("key").agg(
        F.max_by(F.struct(*rest), F.struct("_fresh", "created_at", "response")).alias("_row")
    )
    return newest.select("key", "_row.*").select(*columns)


def store_statistics(store: DataFrame) -> DataFrame:
    """Entries by model."""
    return store.groupBy("model").agg(F.count("*").alias("entries"))


def request_diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """Per case, the stages whose digest differs; cases only the new version has.

    Both are (set, case, stage, digest), one row per stage.
    """
    known = base.select("set", "case").distinct().withColumn("_known", F.lit(True))
    cases = new.select("set", "case").distinct().join(known, ["set", "case"], "left")
    pairs = new.select("set", "case", "stage", F.col("digest").alias("_new")).join(
        base.select("set", "case", "stage", F.col("digest").alias("_old")), ["set", "case", "stage"], "full_outer"
    )
    changed = (
        pairs.filter(~F.col("_new").eqNullSafe(F.col("_old")))
        .groupBy("set", "case").agg(F.array_sort(F.collect_set("stage")).alias("changed"))
    )
    none = F.array().cast("array<string>")
    return (
        cases.join(changed, ["set", "case"], "left")
        .withColumn("is_new", F.col("_known").isNull())
        .withColumn(
            "changed", F.when(F.col("is_new"), none).otherwise(F.coalesce("changed", none))
        )
        .drop("_known")
    )


def request_diff_totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("set").agg(
        F.count("*").alias("cases"),
        F.count_if(F.size("changed") > 0).alias("changed_cases"),
        F.count_if("is_new").alias("new_cases"),
    )


def prompt_audit(usage: DataFrame) -> DataFrame:
    """Prompts cut by the runtime, or leaving less room than the answer cap.

    usage(model, prompt_tokens, context, answer_cap). A cut prompt reports half
    the window plus two.
    """
    cut = F.col("prompt_tokens") == F.floor(F.col("context") / 2) + 2
    tight = F.col("prompt_tokens") + F.col("answer_cap") > F.col("context")
    state = (
        F.when(F.col("prompt_tokens").isNull(), "unreported").when(cut, "truncated")
        .when(tight, "tight").otherwise("fits")
    )
    return usage.withColumn("state", state)


def prompt_audit_totals(audited: DataFrame) -> DataFrame:
    return audited.groupBy("model", "state").agg(
        F.count("*").alias("prompts"), F.max("prompt_tokens").alias("largest")
    )
