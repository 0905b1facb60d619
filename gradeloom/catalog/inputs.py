"""Question, generation and log tables derived from the given tables.

The given tables hold no question/answer data. Each function here builds such a
table from a whole table by row expressions; ``sql.py`` states the same in SQL.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom.functions.conditions import condition_label
from gradeloom.lookups import STRATEGIES
from gradeloom.sources.tables import read_table

PATHS = 5
TASK_ROWS = 50_000  # short rows that a task turns into generations
VECTOR_DIM = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def pick(number: Column, values: list) -> Column:
    """The value at ``number`` modulo the list length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def strategy_of(key: Column) -> Column:
    return pick(key, STRATEGIES)


def condition_of(key: Column) -> Column:
    part = lambda n: F.floor(key / n)
    return condition_label(
        F.concat(F.lit("model-"), (key % 2).cast("string")), None, "default", "revised", part(32) % 2 == 0,
        pick(part(8), [256, 512, 1024, 1500]), 0.0, 1)


def _row_columns(key: Column) -> list[Column]:
    return [
        strategy_of(key).alias("strategy"),
        key.alias("sample_idx"),
        condition_of(key).alias("condition"),
        F.lit(100).cast("long").alias("prompt_tokens"),
        ((key % 50) / 10.0).alias("latency_s"),
    ]


def numeric_runs(orders: DataFrame) -> DataFrame:
    """One numeric generation per order, in eight styles of answering."""
    key, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    style = key % 8
    generation = (
        F.when(style == 0, text("Step 1.\nAnswer: ", v, "\nSeen 99 more."))
        .when(style == 1, text("Work out. #### ", v))
        .when(style == 2, text("The total is ", v, ". It took 4 days."))
        .when(style == 3, text("We get ", v + 1))
        .when(style == 4, text("Answer: ", v, ".36"))
        .when(style == 5, F.lit("No number here."))
        .when(style == 6, text("The total is ", v + 7, " less 7 makes ", v, "."))
        .otherwise(text("Draft answer: 1\nAnswer: ", F.format_number(v, 0))))
    return orders.select(
        F.lit("gsm8k").alias("dataset"),
        *_row_columns(key),
        text("Order ", key, ": what is the total?").alias("question"),
        text("Add the items.\n#### ", v).alias("answer_raw"),
        generation.alias("generation"),
        (40 + key % 400).alias("completion_tokens"),
    )


def boolean_runs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One yes/no generation per document, around its whole text; a document without a label counts as no."""
    key, text = F.col("doc_id"), F.col("text")
    gold = F.coalesce(F.col("quality") == 1, F.lit(False))
    y = F.when(gold != (key % 5 == 0), "yes").otherwise("no")
    style = key % 8
    generation = (
        F.when(style == 0, F.concat(text, F.lit("\nAnswer: "), F.initcap(y)))
        .when(style == 1, F.concat(text, F.lit("\nTherefore, "), y))
        .when(style == 2, F.concat(text, F.lit(" "), y, F.lit(".")))
        .when(style == 3, F.concat(y, F.lit(" is likely. "), text))
        .when(style == 4, text)
        .when(style == 5, F.concat(text, F.lit("\n**Answer:** "), F.initcap(y)))
        .when(style == 6, F.concat(text, F.lit("\nAnswer: "), F.initcap(y), F.lit(", because")))
        .otherwise(F.concat(text, F.lit("\nI cannot tell."))))
    # Labels grow with the documents: a shuffle join, whatever the size here.
    joined = documents.join(labels.select("doc_id", "quality").hint("merge"), "doc_id", "left")
    return joined.select(
        F.lit("strategyqa").alias("dataset"),
        *_row_columns(key),
        F.concat(F.lit("Is document "), key.cast("string"), F.lit(" of high quality?")).alias("question"),
        gold.cast("string").alias("answer_raw"),
        generation.alias("generation"),
        F.floor(F.col("n_chars") / 4).cast("long").alias("completion_tokens"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of generations in one table."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    boolean = boolean_runs(documents, table(spark, sf_dir, "labels"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    # A few bytes an order become texts to be searched: tasks by rows, as those by bytes would be few and long.
    orders = orders.repartition(max(1, -(-orders.count() // TASK_ROWS)))
    return numeric_runs(orders).unionByName(boolean)


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows, or an empty text.

    Turns are numbered without gaps, so the next turn is an equi-join on both
    columns and a very long conversation spreads over tasks.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold_text"))
    reply = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generation"))
    joined = user.join(reply.hint("merge"), ["conv_id", "turn"], "left")
    return joined.withColumn("generation", F.coalesce("generation", F.lit("")))


PATH_CONDITION = {"model": "model-p", "temperature": 0.7, "self_consistency": PATHS}


def path_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several recorded paths per order, one per line, numbered in the order of all columns."""
    lines = table(spark, sf_dir, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[c for c in lines.columns if c != "l_orderkey"]))
    text = F.when(F.col("l_partkey") % 7 == 0, "").otherwise(
        F.concat(F.lit("Answer: "), (F.floor("l_quantity") % 3).cast("string")))
    return lines.withColumn("_no", number).select(
        F.lit("gsm8k").alias("dataset"),
        F.lit("zero_shot_cot").alias("strategy"),
        F.col("l_orderkey").alias("sample_idx"),
        condition_label(PATH_CONDITION["model"], None, "default", "revised", True, 1500,
                        PATH_CONDITION["temperature"], PATHS).alias("condition"),
        (F.col("_no") - 1).alias("path_no"),
        text.alias("text"),
        F.lit(100).cast("long").alias("prompt_tokens"),
        (40 + F.col("l_orderkey") % 400).alias("completion_tokens"),
        ((F.col("l_orderkey") % 50) / 10.0).alias("latency_s"),
    )


def path_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order for the recorded paths."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.lit("gsm8k").alias("dataset"), key.alias("sample_idx"),
        F.concat(F.lit("Order "), key.cast("string"), F.lit(" modulo 3?")).alias("question"),
        F.concat(F.lit("#### "), (key % 3).cast("string")).alias("answer_raw"))


def embedding_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with token vectors: each even vector against the next odd one, each
    cut into tokens of eight values; every fifth row is scored already."""
    vectors = table(spark, sf_dir, "embeddings")
    pair = F.floor(F.col("vec_id") / 2)
    even = vectors.where("vec_id % 2 = 0").select(
        pair.alias("sample_idx"), F.col("embedding").alias("candidate"),
        F.concat(F.lit("run_"), F.col("label").cast("string"), F.lit(".csv")).alias("source_file"))
    odd = vectors.where("vec_id % 2 = 1").select(pair.alias("sample_idx"), F.col("embedding").alias("reference"))
    return even.join(odd, "sample_idx").withColumn(
        "bertscore_f1", F.when(F.col("sample_idx") % 5 == 0, 0.5))
