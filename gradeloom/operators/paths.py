"""Recorded generations: attaching them to prompts and voting over paths."""

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.extract import extract_answer
from gradeloom.functions.votes import join_paths, vote
from gradeloom.operators.once import compute_once
from gradeloom.schemas import KEY


_RECORD = ["text", "prompt_tokens", "completion_tokens", "latency_s"]


def paths_by_key(generations: DataFrame, max_paths: int) -> DataFrame:
    """One row per key: its texts by path number, and the token counts of its first path.

    Paths beyond ``max_paths`` are left out before anything is combined. Each path has
    its own slot, so the state per key is bounded by ``max_paths`` records and is
    combined before the shuffle. Of repeated records of one path the greatest is kept as
    a whole: by text, then tokens and latency, so that values of one call stay together.
    """
    wanted = generations.where((F.col("path_no") >= 0) & (F.col("path_no") < max_paths))
    slots = [F.max(F.when(F.col("path_no") == i, F.struct(*_RECORD))).alias(f"_path{i}") for i in range(max_paths)]
    paths = [F.col(f"_path{i}") for i in range(max_paths)]
    return wanted.groupBy(*KEY).agg(*slots).select(
        *KEY, F.array(*[p["text"] for p in paths]).alias("texts"), F.coalesce(*paths).alias("_call")).select(
        *KEY, "texts", *[F.col(f"_call.{c}").alias(c) for c in _RECORD[1:]])


def attach_generations(prompts: DataFrame, generations: DataFrame, max_paths: int) -> DataFrame:
    """Give each prompt exactly ``self_consistency`` texts (at most ``max_paths``).

    Missing texts become '', a prompt without any record gets zero tokens and
    latency. Prompts without a ``self_consistency`` column get ``max_paths`` texts.
    """
    n = F.greatest(F.lit(1), F.col("self_consistency")) if "self_consistency" in prompts.columns else F.lit(max_paths)
    joined = prompts.join(paths_by_key(generations, max_paths), KEY, "left")
    texts = F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at(F.col("texts"), i), F.lit("")))
    return (joined.withColumn("texts", texts)
            .withColumn("prompt_tokens", F.coalesce("prompt_tokens", F.lit(0).cast("long")))
            .withColumn("completion_tokens", F.coalesce("completion_tokens", F.lit(0).cast("long")))
            .withColumn("latency_s", F.coalesce("latency_s", F.lit(0.0))))


def explode_paths(attached: DataFrame) -> DataFrame:
    """One row per path of an attached table."""
    others = [c for c in attached.columns if c != "texts"]
    return attached.select(*others, F.posexplode_outer("texts").alias("path_no", "text"))


def vote_paths(attached: DataFrame) -> DataFrame:
    """Turn the texts of each row into one generation and one predicted answer."""
    dataset = F.col("dataset")
    extracted = compute_once(attached, answers=F.transform("texts", lambda t: extract_answer(t, dataset)))
    return (compute_once(extracted, predicted_answer=vote(F.col("answers")))
            .withColumn("generation", join_paths(F.col("texts")))
            .drop("answers", "texts"))


def majority_vote(answers: DataFrame, key: list[str]) -> DataFrame:
    """Vote over a long table with columns ``answer`` and ``path_no``.

    Counting per (key, answer) first keeps a key with very many paths spread over
    tasks; the winner per key is then picked from partial winners.
    """
    counted = answers.groupBy(*key, "answer").agg(F.count("*").alias("votes"), F.min("path_no").alias("first"))
    ranked = F.max(F.when(
        F.col("answer") != "",
        F.struct("votes", (-F.col("first")).alias("earlier"), "answer")))
    return counted.groupBy(*key).agg(ranked.alias("_top")).select(
        *key, F.coalesce(F.col("_top.answer"), F.lit("")).alias("predicted_answer"))
