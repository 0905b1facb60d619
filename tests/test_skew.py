"""A key that holds a third of all rows must not change results or gather in one place."""

import contextlib
import io

from pyspark.sql import functions as F

from gradeloom.catalog import inputs as I
from gradeloom.operators import paths as P, resume as R, summary as SU
from gradeloom.schemas import KEY

ROWS = 60_000


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def skewed(spark):
    """Generations of which a third repeat the paths of key 0, the rest have three paths each."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.floor(F.col("id") / 9))
    return spark.range(ROWS).select(
        F.lit("gsm8k").alias("dataset"), F.lit("zero_shot_cot").alias("strategy"), key.cast("long").alias("sample_idx"),
        F.lit("c").alias("condition"), (F.col("id") % 7).cast("int").alias("path_no"),
        F.concat(F.lit("Answer: "), (F.col("id") % 7 % 2).cast("string")).alias("text"),
        F.lit(1).cast("long").alias("prompt_tokens"), F.lit(2).cast("long").alias("completion_tokens"),
        F.lit(0.5).alias("latency_s"))


def test_hot_key_is_combined_before_the_shuffle(spark):
    table = P.paths_by_key(skewed(spark), 7)
    hot = table.where("sample_idx = 0").collect()
    assert len(hot) == 1 and hot[0]["texts"] == [f"Answer: {i % 2}" for i in range(7)]
    plan = plan_of(table)
    assert plan.count("partial_max") >= 7 and "collect_list" not in plan
    assert plan.index("Exchange") < plan.index("partial_max")  # printed top down: partial maxima lie below the exchange


def test_hot_key_vote(spark):
    answers = skewed(spark).withColumn("answer", F.substring("text", 9, 1))
    voted = P.majority_vote(answers, KEY)
    counts = answers.where("sample_idx = 0").groupBy("answer").count().collect()
    assert voted.where("sample_idx = 0").collect()[0]["predicted_answer"] == max(counts, key=lambda r: r["count"])["answer"]
    assert plan_of(voted).count("partial_count") == 1


def test_hot_key_in_the_log(spark):
    grid = spark.range(100).select(F.lit("gsm8k").alias("dataset"), F.lit("zero_shot_cot").alias("strategy"),
                                   F.col("id").alias("sample_idx"), F.lit("c").alias("condition"))
    open_keys = R.pending(grid, skewed(spark).where("sample_idx % 2 = 0"))
    assert sorted(r["sample_idx"] for r in open_keys.collect()) == list(range(1, 100, 2))
    assert plan_of(R.done_keys(skewed(spark))).count("HashAggregate") == 2


def test_hot_cell_in_the_summary(spark):
    rows = skewed(spark).withColumn("is_correct", (F.col("path_no") == 0).cast("int")).withColumn("parse_failed", F.lit(0)) \
        .withColumn("total_tokens", F.lit(3).cast("long"))
    summary = SU.condition_summary(rows)
    assert summary.collect()[0]["n"] == ROWS
    assert "partial_sum" in plan_of(summary)


def test_paths_not_asked_for_are_left_out_before_the_shuffle(spark):
    plan = plan_of(P.paths_by_key(I.path_generations(spark, "/root/testdata/sf0.001"), 5))
    lines = plan.split("\n")
    below = [i for i, line in enumerate(lines) if "Aggregate" in line][-1]
    assert any("Filter" in line and "path_no" in line or "Filter" in line and "_no" in line for line in lines[below:])
