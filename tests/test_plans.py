"""Plans keep the properties they were written for."""

import pytest
from pyspark.sql import functions as F

from gradeloom.catalog import queries as Q
from gradeloom.operators import scoring as SC
from gradeloom.plans import evaluation as EV
from gradeloom.schemas import GENERATIONS, SAMPLES
from gradeloom.sources import keyindex as KI
from test_skew import plan_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tables(spark):
    """Tables with real columns, so that no key is folded into a constant."""
    rows = spark.range(4).select(F.when(F.col("id") % 2 == 0, "gsm8k").otherwise("strategyqa").alias("dataset"), "id")
    samples = rows.select("dataset", F.col("id").alias("sample_idx"), F.lit("q").alias("question"),
                          F.concat(F.lit("#### "), "id").alias("answer_raw"))
    generations = rows.select("dataset", F.lit("zero_shot_cot").alias("strategy"), F.col("id").alias("sample_idx"),
                              F.concat(F.lit("c"), "id").alias("condition"), F.lit(0).alias("path_no"),
                              F.lit("Answer: 1").alias("text"), F.col("id").alias("prompt_tokens"),
                              F.col("id").alias("completion_tokens"), F.lit(0.5).alias("latency_s"))
    return samples, generations


def test_prefix_reaches_the_scan(spark):
    plan = plan_of(Q.first_n(spark, FOLDER))
    assert "LessThan(o_orderkey,100)" in plan and "LessThan(doc_id,100)" in plan
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_scoring_needs_no_shuffle(spark):
    rows = Q.I.numeric_runs(spark.read.parquet(f"{FOLDER}/orders.parquet"))
    plan = plan_of(SC.score_rows(rows))
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_filters_on_scores_do_not_repeat_the_extraction(spark):
    rows = Q.I.numeric_runs(spark.read.parquet(f"{FOLDER}/orders.parquet"))
    once = plan_of(SC.score_rows(rows)).count("regexp_extract_all")
    filtered = SC.score_rows(rows).where("is_correct = 0 and token_f1 < 0.5 and predicted_answer <> ''")
    assert plan_of(filtered).count("regexp_extract_all") == once


def test_grid_is_shuffled_once_for_resume_and_generations(spark, no_broadcast):
    samples, generations = tables(spark)
    plan = plan_of(EV.evaluate(samples, generations, log=generations, conditions=[{"self_consistency": 2}]))
    assert plan.count("SortMergeJoin") == 2
    # one exchange each for the grid, the keys of the log and the generations
    assert plan.count("Exchange hashpartitioning") == 3


def test_log_pruning_for_resume(spark, no_broadcast, tmp_path):
    samples, generations = tables(spark)
    generations.write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    plan = plan_of(EV.pending_prompts(samples, log, conditions=[{}]))
    read = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "text" not in read.split("ReadSchema")[1]


def test_the_key_index_is_never_moved(spark, tmp_path):
    samples, generations = tables(spark)
    log = generations.where("sample_idx < 2")
    KI.write_key_index(log.where("sample_idx = 0"), "keys_of_a_test", f"{tmp_path}/keys", 8)
    spark.sql("drop table keys_of_a_test")  # as in another session
    index = KI.extend_key_index(log, "keys_of_a_test", f"{tmp_path}/keys")
    assert index.count() == 2
    grid = EV.experiment_grid(samples.select("dataset", "sample_idx"), strategies=["zero_shot_cot"])
    left = KI.pending_by_index(grid.drop("condition").withColumn("condition", F.concat(F.lit("c"), "sample_idx")), index)
    plan = plan_of(left)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    right = plan[plan.index("FileScan parquet spark_catalog.default.keys_of_a_test"):]
    assert "Exchange" not in right and "Exchange" not in plan[:plan.index("FileScan")].rsplit("+- ", 1)[-1]
    assert sorted(r["sample_idx"] for r in left.collect()) == [2, 3]
    spark.sql("drop table keys_of_a_test")


def test_schemas_name_what_the_operators_read():
    assert SAMPLES.names == ["dataset", "sample_idx", "question", "answer_raw"]
    assert {"path_no", "text"} <= set(GENERATIONS.names)
