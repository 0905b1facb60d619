import random
from collections import Counter

from pyspark.sql import functions as F

from gradeloom.functions.votes import vote
from gradeloom.operators import paths as P, resume as R
from gradeloom.plans import evaluation as EV
from gradeloom.schemas import GENERATIONS, KEY, SAMPLES
from helpers import values

CELL = [{"model": "m", "self_consistency": 3, "temperature": 0.7}]
LABEL = "model=m,k=def,trig=default,persona=revised,struct=on,mt=1500,T=0.7,sc=3"


def brute_vote(answers):
    kept = [a for a in answers if a]
    if not kept:
        return ""
    counts = Counter(kept)
    return min(kept, key=lambda a: (-counts[a], kept.index(a)))


def test_votes(spark):
    rng = random.Random(1)
    rows = [(["yes", "no", "yes"],), (["", "", "no"],), (["", "", ""],), ([],), (["b", "a"],)]
    rows += [([rng.choice(["", "1", "2", "3"]) for _ in range(rng.randint(0, 9))],) for _ in range(200)]
    want = [brute_vote(r[0]) for r in rows]
    assert want[:5] == ["yes", "no", "", "", "b"]
    assert values(spark, rows, "a array<string>", vote(F.col("a"))) == want
    long = spark.createDataFrame([(i, n, a) for i, r in enumerate(rows) for n, a in enumerate(r[0])],
                                 "k int, path_no int, answer string")
    got = {r["k"]: r["predicted_answer"] for r in P.majority_vote(long, ["k"]).collect()}
    assert got == {i: w for i, w in enumerate(want) if rows[i][0]}


def samples(spark):
    return spark.createDataFrame([("gsm8k", i, f"q{i}", f"#### {i}") for i in range(4)], SAMPLES)


def generations(spark, strategy="zero_shot_cot"):
    def row(i, path, text):
        return ("gsm8k", strategy, i, LABEL, path, text, 10, 20, 1.25)
    rows = [row(0, 0, "Answer: 0"), row(0, 1, "Answer: 9"), row(0, 2, "Answer: 0"), row(0, 3, "Answer: 9"),
            row(0, 4, "Answer: 9"), row(0, 5, "Answer: 9"), row(1, 1, "Answer: 1"), row(2, 7, "Answer: 2"),
            row(0, 0, "Answer: 0")]
    return spark.createDataFrame(rows, GENERATIONS)


def test_each_prompt_gets_exactly_n_texts(spark):
    grid = EV.experiment_grid(samples(spark), CELL, strategies=["zero_shot_cot"])
    rows = {r["sample_idx"]: r for r in P.attach_generations(grid, generations(spark), 3).collect()}
    assert rows[0]["texts"] == ["Answer: 0", "Answer: 9", "Answer: 0"]
    assert rows[1]["texts"] == ["", "Answer: 1", ""]
    assert rows[2]["texts"] == ["", "", ""] and rows[2]["completion_tokens"] == 0  # no path that is asked for
    assert rows[3]["texts"] == ["", "", ""]
    assert (rows[3]["prompt_tokens"], rows[3]["completion_tokens"], rows[3]["latency_s"]) == (0, 0, 0.0)
    long = P.explode_paths(P.attach_generations(grid, generations(spark), 3))
    assert long.count() == 12 and long.where("sample_idx = 1 and path_no = 1").collect()[0]["text"] == "Answer: 1"


def test_evaluation_end_to_end(spark):
    scored = EV.evaluate(samples(spark), generations(spark), conditions=CELL)
    rows = {(r["strategy"], r["sample_idx"]): r for r in scored.collect()}
    assert len(rows) == 12
    first = rows["zero_shot_cot", 0]
    assert (first["predicted_answer"], first["is_correct"], first["total_tokens"]) == ("0", 1, 30)
    assert first["generation"] == "Answer: 0 ||| Answer: 9 ||| Answer: 0"
    assert rows["zero_shot_cot", 1]["is_correct"] == 1
    assert rows["standard_few_shot", 1]["parse_failed"] == 1
    resumed = EV.evaluate(samples(spark), generations(spark), log=scored.where("sample_idx < 3"), conditions=CELL)
    assert {r["sample_idx"] for r in resumed.collect()} == {3}


def test_resume_and_legacy_logs(spark):
    grid = EV.experiment_grid(samples(spark), CELL, strategies=["zero_shot_cot"], max_samples=3).select(*KEY)
    old = spark.createDataFrame([("gsm8k", "zero_shot_cot", 0), ("gsm8k", "zero_shot_cot", 0)],
                                "dataset string, strategy string, sample_idx int")
    assert R.done_keys(old).collect() == [("gsm8k", "zero_shot_cot", 0, "legacy")]
    assert R.pending(grid, old).count() == 3
    new = old.withColumn("condition", F.lit(LABEL))
    assert sorted(r["sample_idx"] for r in R.pending(grid, new).collect()) == [1, 2]
    prompts = EV.pending_prompts(samples(spark), new, conditions=CELL, strategies=["zero_shot_cot"])
    assert sorted((r["sample_idx"], r["prompt"][:5]) for r in prompts.collect()) == [(i, f"Q: q{i}") for i in (1, 2, 3)]


def test_most_paths_covers_every_condition():
    assert EV.most_paths() == 1
    assert EV.most_paths([{"self_consistency": 4}, {}]) == 4
    assert EV.most_paths(base={"self_consistency": 7}, dims=["structured"]) == 7


def test_repeated_records_are_taken_whole(spark):
    rows = [("gsm8k", "s", 1, "c", 0, "Answer: 5", 10, 1, 0.5), ("gsm8k", "s", 1, "c", 0, "zzz", 3, 9, 0.1), ("gsm8k", "s", 1, "c", 1, "b", 7, 7, 7.0)]
    got = P.paths_by_key(spark.createDataFrame(rows, GENERATIONS), 2).collect()[0]
    assert (got["texts"], got["prompt_tokens"], got["completion_tokens"], got["latency_s"]) == (["zzz", "b"], 3, 9, 0.1)
