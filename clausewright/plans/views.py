"""The given tables as Spark DataFrames in the library's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.operators import score, segment
from clausewright.plans import shapes
from clausewright.sources import lines as ln
from clausewright.sources import stores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Characters of text whose lines, with all columns of their windows, one task sorts and holds.
TASK_CHARS = 4_000_000


def by_document(docs: DataFrame) -> DataFrame:
    """Exchanged by document into as many tasks as the text asks for.

    Adaptive execution sees compressed text and not the lines it becomes, and would
    rather make a few large tasks.
    """
    chars = F.coalesce("n_chars", F.lit(0)) if "n_chars" in docs.columns else F.length("text")
    total = docs.agg(F.sum(chars)).first()[0] or 0
    tasks = -(-int(total) // TASK_CHARS)
    rows = docs.select("doc_id", "source", "text")
    if tasks <= docs.sparkSession.sparkContext.defaultParallelism:
        return rows.repartition("doc_id")
    return rows.repartition(tasks, "doc_id")


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with section titles, numbers and phrases; one row each."""
    line = shapes.decorate("x", "i", "doc_id", "'\\n'", "char(12)")
    text = (
        "array_join(transform(filter(split(text, '\\n'), x -> trim(x) <> ''), "
        f"(x, i) -> {line}), '\\n')"
    )
    # Exchanged as it is read, before it becomes lines: all windows over a document then need no other exchange.
    docs = by_document(table(spark, sf_dir, "documents"))
    return docs.selectExpr("doc_id", "source", f"{text} as text")


def styled(lines: DataFrame) -> DataFrame:
    return lines.selectExpr("*", *[f"{sql} as {name}" for name, sql in shapes.LINE_STYLE.items()])


def styled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styled(ln.line_table(policy_documents(spark, sf_dir)))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(styled_lines(spark, sf_dir))


def analysed_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses left-joined to their analyses (S6), the analyses being a rule on the keys."""
    return analysed(clauses(spark, sf_dir))


def analysed(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", *[f"{sql} as {name}" for name, sql in shapes.ANALYSIS.items()])


def scored_clauses(spark: SparkSession, sf_dir: str, digits: int | None = 6) -> DataFrame:
    return scored(analysed_clauses(spark, sf_dir), digits)


def scored(rows: DataFrame, digits: int | None = 6) -> DataFrame:
    return score.score_clauses(rows, digits)


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host as one document: styled lines with their place on the page."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    lines = ln.html_lines(pages.withColumn("doc_id", host), keep=["doc_id"])
    height = F.count("*").over(Window.partitionBy("page_id")) * 10.0
    order = Window.partitionBy("page_id").orderBy("block_no")
    row = F.row_number().over(order) - 1
    return lines.select(
        "doc_id", F.col("page_id").alias("page"), row.alias("line_no"), "tag", "text", "size", "bold",
        "words_bold", (row * 10.0).alias("y0"), (row * 10.0 + 8.0).alias("y1"),
        height.alias("page_height"),
    )


def policy_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a policy of fourteen clauses, with their analyses."""
    rows = ", ".join(
        "struct(" + ", ".join(f"{sql} as {name}" for name, sql in c.items()) + ")"
        for c in shapes.POLICY_CLAUSES
    )
    # By policy before the clauses are made, which is how the claims ask for them. The number is given, as
    # adaptive execution sees only the few bytes of a part and not the clauses it becomes.
    part = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return (
        part.select(F.col("p_partkey").alias("policy_id"), F.expr(f"explode(array({rows}))").alias("c"))
        .select("policy_id", "c.*")
        .withColumn("order_idx", F.col("order_idx").cast("int"))
        .withColumn("exceptions", F.array_compact(F.array("exception")))
        .withColumn("time_windows", F.array_compact(F.array("time_window")))
        .drop("exception", "time_window")
        # The estimate sees the few bytes of a part here too: a join must not take the clauses for a small side.
        .hint("merge")
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy clauses as claims see them: citation ids, periods in days, no headings.

    Impact here is the type weight times the mean rating: enough to rank by.
    """
    from clausewright.operators import corrections

    df = policy_clauses(spark, sf_dir).withColumn("doc_id", F.col("policy_id")).withColumn(
        "page_start", F.lit(0)
    )
    df = corrections.with_periods(stores.claim_side_clauses(df))
    rating = (F.col("likelihood") + F.col("severity")) / 2.0
    return df.withColumn("impact", F.round(score.type_weight() * rating * 20.0, 6)).drop("doc_id")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = shapes.claim_columns("datediff(l_shipdate, o_orderdate)")
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    # Both sides grow with the claims.
    return lineitem.join(orders.hint("merge"), lineitem["l_orderkey"] == orders["o_orderkey"]).selectExpr(
        *[f"{sql} as {name}" for name, sql in columns.items()]
    )


# A product with a claim's number may pass 64 bits, which is an error.
_WIDE = {name: sql.replace("claim_id *", "cast(claim_id as decimal(20, 0)) *") for name, sql in shapes.ANSWER.items()}


def answers_to(claimed: DataFrame) -> DataFrame:
    base = claimed.select("claim_id", "policy_id", "scenario")
    return base.selectExpr("*", *[f"{sql} as {name}" for name, sql in _WIDE.items()])


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers_to(claims(spark, sf_dir))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations_of(answers(spark, sf_dir), policies(spark, sf_dir))


def citations_of(answered: DataFrame, pol: DataFrame) -> DataFrame:
    """Citations of each answer; the clause may not exist, the quote may be damaged."""
    cited = (
        answered
        .filter(F.expr(f"{shapes.CITATIONS} > 0"))
        .select("claim_id", "policy_id", "answer_id", F.expr(f"explode(sequence(1, {shapes.CITATIONS}))").alias("j"))
        .withColumn("order_idx", F.expr(shapes.CITED_IDX))
        .withColumn("effect", F.expr(shapes.EFFECT))
    )
    source = pol.select("policy_id", "order_idx", "clause_id", "text", "number")
    joined = cited.join(source, ["policy_id", "order_idx"], "left")
    return joined.select(
        "answer_id", "claim_id", "policy_id", F.col("j").alias("pos"),
        F.coalesce("clause_id", F.lit("9.9")).alias("clause_id"),
        F.coalesce(
            F.expr(shapes.quote("'\\n'")),
            F.lit("A clause that is not in the policy at all, quoted at length."),
        ).alias("quote"),
        "effect",
    )
