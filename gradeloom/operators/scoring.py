"""Scoring of generations, and of older logs that lack the metrics."""

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions import metrics as M
from gradeloom.functions.extract import extract_answer, gold_answer, gold_text
from gradeloom.functions.similarity import embedding_f1
from gradeloom.functions.text import py_round, tokens
from gradeloom.operators.once import compute_once
from gradeloom.schemas import LOG_TYPES, RUN_LOG, SCORE_METRICS


def with_answers(rows: DataFrame) -> DataFrame:
    """Add gold and predicted answer; a prediction the rows carry (a vote) is kept."""
    answers = {"gold_answer": gold_answer(F.col("answer_raw"), F.col("dataset"))}
    if "predicted_answer" not in rows.columns:
        answers["predicted_answer"] = extract_answer(F.col("generation"), F.col("dataset"))
    return compute_once(rows, **answers).withColumn(
        "gold_text", gold_text(F.col("answer_raw"), F.col("gold_answer"), F.col("dataset")))


def exact_match_rows(rows: DataFrame) -> DataFrame:
    """Gold, prediction, exact match, parse failure and token total of each row."""
    return (with_answers(rows)
            .withColumn("is_correct", M.exact_match(F.col("predicted_answer"), F.col("gold_answer")))
            .withColumn("parse_failed", M.parse_failed(F.col("predicted_answer")))
            .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))


def with_overlap(rows: DataFrame, reference: str) -> DataFrame:
    """token_f1 and rouge_l of ``generation`` against a reference column."""
    p, r = F.col("_p"), F.col("_r")
    split = compute_once(rows, _p=tokens(F.col("generation")), _r=tokens(F.col(reference)))
    counted = compute_once(split, _common=M.common_tokens(p, r), _easy=M.evident_lcs(p, r), _n=F.size(p), _m=F.size(r))
    counted = compute_once(counted, _lcs=M.lcs_length(p, r, F.col("_easy")))
    return (counted
            .withColumn("token_f1", M.f1(F.col("_common"), F.col("_n"), F.col("_m")))
            .withColumn("rouge_l", M.f1(F.col("_lcs"), F.col("_n"), F.col("_m")))
            .drop("_p", "_r", "_common", "_easy", "_lcs", "_n", "_m"))


def score_rows(rows: DataFrame) -> DataFrame:
    """All row metrics of raw generations, in the layout of the run log.

    The text columns keep their newlines; only a flat-file sink replaces them.
    """
    predicted, gold = F.col("predicted_answer"), F.col("gold_answer")
    close = F.when(F.lower("dataset") == "gsm8k", M.numeric_close(predicted, gold)).otherwise(0)
    scored = (with_overlap(exact_match_rows(rows), "gold_text")
              .withColumn("substring_match",
                          M.substring_match(M.prediction_or_text(predicted, F.col("generation")), gold))
              .withColumn("is_numeric_close", close)
              .withColumn("token_f1", py_round(F.col("token_f1"), 4))
              .withColumn("rouge_l", py_round(F.col("rouge_l"), 4))
              .withColumn("latency_s", py_round(F.col("latency_s"), 2)))
    extra = ["answer_raw"] + (["source_file"] if "source_file" in rows.columns else [])
    return scored.select(*[F.col(f.name).cast(f.dataType) for f in RUN_LOG], *extra)


def add_missing_metrics(log: DataFrame) -> DataFrame:
    """NULL columns for the metrics a log does not have."""
    for name in SCORE_METRICS:
        if name not in log.columns:
            log = log.withColumn(name, F.lit(None).cast(LOG_TYPES[name]))
    return log


def backfill(log: DataFrame, overwrite: bool = False) -> DataFrame:
    """Fill the four metrics of unscored rows from the stored columns.

    A row is unscored when ``substring_match`` is NULL. The reference text is the
    stored scalar gold; the prediction is never extracted again. Rows that are
    already scored send nothing to the overlap metrics.
    """
    full = add_missing_metrics(log)
    todo = F.lit(True) if overwrite else F.col("substring_match").isNull()
    fresh = {name: f"_new_{name}" for name in SCORE_METRICS}
    text = F.coalesce(F.col("_old.generation"), F.lit(""))
    gold = F.coalesce(F.col("_old.gold_answer"), F.lit(""))
    predicted = F.coalesce(F.col("_old.predicted_answer"), F.lit(""))
    rows = (full.select(F.struct(*full.columns).alias("_old"), todo.alias("_todo"))
            .withColumn("generation", F.when(F.col("_todo"), text))
            .withColumn("gold", F.when(F.col("_todo"), gold))
            .withColumn("predicted", F.when(F.col("_todo"), predicted)))
    close = F.when(F.lower("_old.dataset") == "gsm8k", M.numeric_close(F.col("predicted"), F.col("gold"))).otherwise(0)
    scored = (with_overlap(rows, "gold")
              .withColumn(fresh["substring_match"], M.substring_match(
                  M.prediction_or_text(F.col("predicted"), F.col("generation")), F.col("gold")))
              .withColumn(fresh["is_numeric_close"], close)
              .withColumn(fresh["token_f1"], py_round(F.col("token_f1"), 4))
              .withColumn(fresh["rouge_l"], py_round(F.col("rouge_l"), 4)))
    return scored.select(*[
        (F.when(F.col("_todo"), F.col(fresh[c])).otherwise(F.col(f"_old.{c}")) if c in fresh else F.col(f"_old.{c}"))
        .alias(c) for c in full.columns])


def score_embeddings(log: DataFrame, candidate: str, reference: str, dim: int, overwrite: bool = False) -> DataFrame:
    """Fill ``bertscore_f1`` from the token vectors of both texts where it is NULL.

    ``newly_scored`` marks the rows this call has filled.
    """
    old = F.col("bertscore_f1") if "bertscore_f1" in log.columns else F.lit(None).cast("double")
    todo = F.lit(True) if overwrite else old.isNull()
    scored = (log.withColumn("_todo", todo)
              .withColumn("_f1", embedding_f1(
                  F.when(F.col("_todo"), F.col(candidate)), F.when(F.col("_todo"), F.col(reference)), dim)))
    return (scored.withColumn("bertscore_f1", F.when(F.col("_todo"), py_round(F.col("_f1"), 4)).otherwise(old))
            .withColumnRenamed("_todo", "newly_scored")
            .drop("_f1"))
