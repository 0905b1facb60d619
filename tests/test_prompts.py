import pytest
from pyspark.sql import functions as F

from gradeloom.functions import conditions as C
from gradeloom.functions.prompts import build_prompt, get_prompt
from gradeloom.lookups import BASE_CONDITION, FEW_SHOT, PERSONAS, STRUCTURED_TAILS, SWEEP_VALUES, TRIGGERS
from gradeloom.operators import grid as G
from gradeloom.plans import evaluation as EV
from helpers import values


def prompt(spark, *args, **kwargs):
    return values(spark, [(1,)], "x int", build_prompt(*args, **kwargs))[0]


def test_whole_prompt_text(spark):
    shot = "\n\n".join(f"Q: {q}\nA: {a}" for q, a in FEW_SHOT["strategyqa"][:2])
    got = prompt(spark, "StrategyQA", "PERSONA_prompting", "Why?", k_shot=2, cot_trigger="careful", structured=True)
    want = f"{PERSONAS['strategyqa']['revised']}\n\n{shot}\n\nQ: Why?\nA: {TRIGGERS['careful']}"
    assert got == want + STRUCTURED_TAILS["strategyqa"]
    assert prompt(spark, "gsm8k", "zero_shot_cot", "Why?", cot_trigger="none") == "Q: Why?\nA:"
    assert prompt(spark, "gsm8k", "zero_shot_cot", "Why?", cot_trigger="?") == f"Q: Why?\nA: {TRIGGERS['default']}"
    assert prompt(spark, "gsm8k", "standard_few_shot", "Why?", k_shot=-1) == "Q: Why?\nA:"
    assert prompt(spark, "gsm8k", "standard_few_shot", "Why?", k_shot=9).count("Q:") == 6
    assert prompt(spark, "gsm8k", "standard_few_shot", "Why?").count("Q:") == 2
    assert get_prompt is build_prompt


@pytest.mark.parametrize("args", [("other", "zero_shot_cot", "Q"), ("gsm8k", "other", "Q")])
def test_unknown_names_fail(spark, args):
    with pytest.raises(Exception, match="Unknown"):
        prompt(spark, *args)


def test_unknown_persona_fails_only_where_it_is_used(spark):
    assert prompt(spark, "gsm8k", "zero_shot_cot", "Q", persona_variant="odd")
    with pytest.raises(Exception, match="Unknown persona"):
        prompt(spark, "gsm8k", "persona_prompting", "Q", persona_variant="odd")


def test_template_table(spark):
    rows = G.template_table(spark.range(1)).collect()
    assert len(rows) == 6
    assert all(r["template"].count("{question}") == 1 for r in rows)
    personas = {r["dataset"]: r["template"] for r in rows if r["strategy"] == "persona_prompting"}
    assert all(personas[d].startswith(PERSONAS[d]["original"]) for d in PERSONAS)


def test_condition_labels(spark):
    rows = [("m", None, 0.0, True, 1), ("", 3, 0.7, False, 5), (None, 0, 1.0, True, 1)]
    label = C.condition_label(F.col("m"), F.col("k"), "default", "revised", F.col("s"), 1500, F.col("t"), F.col("n"))
    schema = "m string, k int, t double, s boolean, n int"
    got = values(spark, rows, schema, label)
    assert got == [
        "model=m,k=def,trig=default,persona=revised,struct=on,mt=1500,T=0.0,sc=1",
        "model=unknown,k=3,trig=default,persona=revised,struct=off,mt=1500,T=0.7,sc=5",
        "model=unknown,k=0,trig=default,persona=revised,struct=on,mt=1500,T=1.0,sc=1",
    ]
    c = F.col("c")
    parsed = values(spark, [(got[0],), ("k=1",), (None,), ("",)], "c string", C.condition_max_tokens(c),
                    C.condition_max_tokens(c, 700), C.condition_model(c), C.condition_without_model(c))
    assert parsed == [(1500, 1500, "m", got[0].removeprefix("model=m,")), (1500, 700, "unknown", "k=1"),
                      (1500, 700, "unknown", None), (1500, 700, "unknown", "")]


def test_condition_rules(spark):
    rows = [(0, 0.0, 14336), (5, 0.0, 14337), (5, 0.7, 256)]
    n, t, m = F.col("n"), F.col("t"), F.col("m")
    got = values(spark, rows, "n int, t double, m int", C.sampling_paths(n), C.repeats_same_sample(n, t),
                 C.leaves_little_prompt_room(m))
    assert got == [(1, False, False), (5, True, True), (5, False, False)]


def test_sweeps(spark):
    one = spark.range(1)
    default = G.sweep(one)
    assert default.count() == 8 and default.select("condition").distinct().count() == 8
    full = G.sweep(one, SWEEP_VALUES)
    assert full.count() == 288 and full.select("condition").distinct().count() == 288
    row = G.with_conditions(one, [{"k_shot": 3}]).collect()[0].asDict()
    assert {k: row[k] for k in BASE_CONDITION} == {**BASE_CONDITION, "k_shot": 3}


def test_grid_is_built_without_shuffle_or_join(spark):
    grid = G.with_prompt(G.sweep(G.with_strategies(spark.sql(
        "select 'gsm8k' dataset, id sample_idx, 'q' question from range(10)")), SWEEP_VALUES))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert grid.count() == 10 * 3 * 288


def test_conditions_from_a_table(spark):
    cells = spark.createDataFrame([("m1", 100, None), ("m2", None, 3), ("m1", 100, None)], "model string, max_tokens int, k_shot int")
    grid = G.with_conditions(spark.range(4), cells)
    listed = G.with_conditions(spark.range(4), [{"model": "m1", "max_tokens": 100}, {"model": "m2", "k_shot": 3}, {"model": "m1", "max_tokens": 100}])
    assert sorted(map(str, grid.select(*listed.columns).collect())) == sorted(map(str, listed.collect()))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert EV.most_paths(cells) == 1 and EV.most_paths(cells.withColumn("self_consistency", F.lit(4))) == 4
    once = EV.experiment_grid(spark.range(1).select(F.lit("gsm8k").alias("dataset"), F.col("id").alias("sample_idx")), iter([{"k_shot": 1}]), base={"model": "mm", "k_shot": 5})
    assert {(r.model, r.k_shot) for r in once.collect()} == {("mm", 1)}
    with pytest.raises(ValueError):
        G.with_conditions(spark.range(1), [])
