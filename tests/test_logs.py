import bz2
import csv
import gzip
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import failures as FA, scoring as SC, summary as SU
from gradeloom.functions.failures import failure_category, gold_present, looks_truncated
from gradeloom.plans import postscore
from gradeloom.schemas import LOG_COLUMNS, LOG_V1, LOG_V2, LOG_V3
from gradeloom.sources import quarantine, reports, runlog
from helpers import values

CELL = "model={},k=def,trig=default,persona=revised,struct=on,mt=1500,T=0.0,sc=1"


def log_row(i, **changes):
    row = dict(dataset="gsm8k", strategy="zero_shot_cot", sample_idx=i, question=f'Is "{i}" \\ a\nnumber, 🙂?',
               gold_answer=str(i), generation=f"Total is {i}.", predicted_answer=str(i), is_correct=1, parse_failed=0,
               substring_match=1, is_numeric_close=1, token_f1=0.5, rouge_l=0.25, prompt_tokens=10,
               completion_tokens=5, total_tokens=15, latency_s=0.5, condition=CELL.format("m/1"))
    return {**row, **changes}


def write_csv(path, layout, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, fieldnames=layout, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "run logs"
    folder.mkdir()
    failed = dict(generation="", predicted_answer="", is_correct=0, parse_failed=1)
    write_csv(folder / "run_1.csv", LOG_V1, [log_row(0), log_row(1, **failed)])
    write_csv(folder / "run_2.csv", LOG_V2, [log_row(2), log_row(3, **failed)])
    write_csv(folder / "run_3.csv", LOG_V3, [log_row(4), log_row(5, token_f1="", substring_match="")])
    # metrics appended at the end by another tool, whole numbers as floats
    write_csv(folder / "run_4.csv", LOG_V2 + ["substring_match", "is_numeric_close", "token_f1", "rouge_l", "bertscore_f1"],
              [log_row(6, substring_match="1.0", bertscore_f1="0.75")])
    write_csv(folder / "run_5.csv", ["dataset", "strategy", "sample_idx", "note"], [dict(dataset="gsm8k", sample_idx=1)])
    (folder / "run_6.csv").write_text("not a log\n")
    return str(folder)


def read(spark, folder):
    with pytest.warns(UserWarning) as seen:
        log = runlog.read_run_logs(spark, [f"{folder}/run_*.csv", f"{folder}/none_*.csv"], required=["generation", "gold_answer"])
    assert len([w for w in seen if "Skipped" in str(w.message)]) == 2, [str(w.message) for w in seen]
    return log


def test_logs_of_all_layouts_read_as_one(spark, logs):
    rows = {r["sample_idx"]: r for r in read(spark, logs).collect()}
    assert sorted(rows) == list(range(7))
    assert rows[0]["question"] == 'Is "0" \\ a\nnumber, 🙂?'
    assert rows[0]["condition"] is None and rows[0]["prompt_tokens"] is None and rows[0]["source_file"] == "run_1.csv"
    assert rows[1]["generation"] == "" and rows[1]["predicted_answer"] == ""
    assert rows[2]["total_tokens"] == 15 and rows[2]["token_f1"] is None
    assert rows[4]["token_f1"] == 0.5 and rows[5]["substring_match"] is None
    assert rows[6]["substring_match"] == 1 and rows[6]["bertscore_f1"] == 0.75


def test_logs_of_a_given_layout(spark, logs):
    log = runlog.read_run_logs(spark, [f"{logs}/run_2.csv"], layout=LOG_V2)
    assert log.schema == read(spark, logs).schema
    rows = {r["sample_idx"]: r for r in log.collect()}
    assert rows[2]["question"] == 'Is "2" \\ a\nnumber, 🙂?' and rows[3]["predicted_answer"] == ""
    assert rows[2]["latency_s"] == 0.5 and rows[2]["token_f1"] is None


def test_no_log_found(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert runlog.read_run_logs(spark, [f"{tmp_path}/none.csv"]).count() == 0


def test_backfill_scores_only_unscored_rows(spark, logs):
    log = read(spark, logs)
    rows = {r["sample_idx"]: r for r in SC.backfill(log).collect()}
    assert (rows[0]["substring_match"], rows[0]["is_numeric_close"], rows[0]["token_f1"], rows[0]["rouge_l"]) == (1, 1, 0.5, 0.5)
    assert (rows[1]["substring_match"], rows[1]["is_numeric_close"], rows[1]["token_f1"]) == (0, 0, 0.0)
    assert (rows[4]["token_f1"], rows[4]["rouge_l"]) == (0.5, 0.25)
    assert (rows[5]["substring_match"], rows[5]["rouge_l"]) == (1, 0.5)
    again = {r["sample_idx"]: r for r in SC.backfill(log, overwrite=True).collect()}
    assert again[4]["rouge_l"] == 0.5
    assert rows[6]["bertscore_f1"] == 0.75
    bare = SC.backfill(log.drop("substring_match", "is_numeric_close", "token_f1", "rouge_l"))
    assert bare.where("rouge_l is null").count() == 0


def test_backfill_falls_back_to_the_text(spark):
    row = log_row(1, dataset="strategyqa", gold_answer="yes", generation="It says yes.", predicted_answer="",
                  substring_match=float("nan"))
    log = spark.createDataFrame(pd.DataFrame([row])).withColumn("substring_match", F.lit(None).cast("int"))
    out = SC.backfill(log).collect()[0]
    assert (out["substring_match"], out["is_numeric_close"], out["token_f1"]) == (1, 0, 0.5)


def test_backfill_plan_writes_a_new_version(spark, logs, tmp_path):
    with pytest.warns(UserWarning):
        rates = postscore.backfill_logs(spark, [f"{logs}/run_[1-4].csv", f"{logs}/none"], f"{tmp_path}/v2")
    got = {r["source_file"]: r.asDict() for r in rates.collect()}
    assert got["run_1.csv"]["substring_match_rate"] == 50.0 and got["run_1.csv"]["avg_token_f1"] == 0.25
    assert got["run_4.csv"]["n"] == 1


def test_failure_categories(spark):
    long = "word " * 130 + "end"
    rows = [
        ("", "5", "gsm8k", 300),                      # nothing to classify
        (" \n", "5", "gsm8k", 300),
        ("It has 5 parts.", "5", "gsm8k", 300),       # clean ending, gold inside
        ("It has 1,000 parts.", "1000", "gsm8k", 3),
        ("It has 15 parts.", "5", "gsm8k", 3),
        ("and then 5", "5", "gsm8k", 239),            # too short to be cut
        ("and then 5", "6", "gsm8k", 240),
        ("and then 5", "6", "gsm8k", None),
        (long, "6", "gsm8k", None),
        (long, "6", "gsm8k", 100),                    # few tokens fall through to the length
        (long + " Answer: 7", "6", "gsm8k", 2000),
        ("#### 7 and", "6", "gsm8k", 2000),
        ("#### 7 and", "yes", "strategyqa", 2000),
        ("maybe yes or no.", "yes", "strategyqa", 20),
        ("eyes only.", "yes", "strategyqa", 20),
        ("Yes!", "no", "strategyqa", 20),
        ("of the u.s. army.", "u.s.", "strategyqa", 20),
        ("x.", None, "gsm8k", 20),
        ("zero is 0.", "0", "gsm8k", 20),
    ]
    schema = "t string, g string, d string, c long"
    cols = [F.col(c) for c in "tgdc"]
    got = values(spark, rows, schema, failure_category(*cols, 1500))
    assert got == ["reasoning", "reasoning", "extraction", "extraction", "reasoning", "extraction", "truncation",
                   "reasoning", "truncation", "truncation", "reasoning", "reasoning", "truncation", "extraction",
                   "reasoning", "reasoning", "reasoning", "reasoning", "extraction"]
    assert values(spark, [("and then", "", "gsm8k", 60)], schema, looks_truncated(cols[0], cols[2], cols[3], 64)) == [True]
    assert values(spark, [("a yes", "yes", "strategyqa", 1)], schema, gold_present(*cols[:3])) == [True]


def failed_rows(models):
    rows = [log_row(i, is_correct=0, gold_answer="77", condition=CELL.format(m)) for i, m in enumerate(models)]
    return rows + [log_row(90), log_row(91, is_correct=1, parse_failed=1, generation="", predicted_answer="")]


def test_failure_counts_split_models_only_if_there_are_several(spark, tmp_path):
    one = FA.failure_rows(spark.createDataFrame(pd.DataFrame(failed_rows(["m/1"] * 2))))
    counts = FA.failure_counts(one)
    assert counts.columns == ["dataset", "strategy", "extraction", "reasoning", "truncation"]
    assert counts.collect() == [("gsm8k", "zero_shot_cot", 0, 3, 0)]
    two = FA.failure_rows(spark.createDataFrame(pd.DataFrame(failed_rows(["a", "b"]))))
    assert {tuple(r) for r in FA.failure_counts(two).collect()} == {
        ("a", "gsm8k", "zero_shot_cot", 0, 1, 0), ("b", "gsm8k", "zero_shot_cot", 0, 1, 0),
        ("m/1", "gsm8k", "zero_shot_cot", 0, 1, 0)}
    written = reports.write_failures(two, str(tmp_path / "errors"))
    assert {tuple(r) for r in written.collect()} == {tuple(r) for r in FA.failure_counts(two).collect()}


def test_failure_analysis_of_logs(spark, logs, tmp_path):
    with pytest.warns(UserWarning):
        counts = postscore.analyse_failures(spark, [f"{logs}/run_[1-4].csv", f"{logs}/none"], str(tmp_path / "out"))
    assert {tuple(r) for r in counts.collect()} == {
        ("unknown", "gsm8k", "zero_shot_cot", 0, 1, 0), ("m/1", "gsm8k", "zero_shot_cot", 0, 1, 0)}


def test_summary(spark, tmp_path):
    rows = [log_row(0), log_row(1, is_correct=0, latency_s=0.13, token_f1=0.1234), log_row(2, parse_failed=1, is_correct=0)]
    scored = spark.createDataFrame(pd.DataFrame(rows))
    cell = CELL.format("m/1")
    requested = spark.createDataFrame([("gsm8k", "zero_shot_cot", cell, 5), ("gsm8k", "persona_prompting", cell, 0)],
                                      "dataset string, strategy string, condition string, n_requested long")
    got = {r["strategy"]: r.asDict() for r in SU.condition_summary(scored, requested).collect()}
    want = dict(n_requested=5, n=3, em=1 / 3 * 100, parse_failure_rate=1 / 3 * 100, substring_match_rate=100.0,
                numeric_close_rate=100.0, avg_token_f1=round((0.5 + 0.1234 + 0.5) / 3, 4), avg_rouge_l=0.25,
                avg_prompt_tokens=10.0, avg_completion_tokens=5.0, avg_total_tokens=15.0, total_tokens_used=45,
                avg_latency_s=round((0.5 + 0.13 + 0.5) / 3, 2))
    assert {k: got["zero_shot_cot"][k] for k in want} == want
    assert {v for k, v in got["persona_prompting"].items() if k not in SU.CELL} == {0}
    old = SU.condition_summary(scored.drop("substring_match", "is_numeric_close", "token_f1", "rouge_l")).collect()[0]
    assert (old["substring_match_rate"], old["avg_rouge_l"], old["n"]) == (0.0, 0.0, 3)
    model = SU.model_summary(scored.withColumn("source_file", F.lit("run_1.csv"))).collect()[0]
    assert (model["model"], model["max_latency_s"]) == ("m/1", 0.5) and "model=" not in model["condition"]
    pivot = SU.em_pivot(SU.condition_summary(scored)).collect()
    assert pivot == [("zero_shot_cot", 33.333333, None)]
    reports.write_summary(SU.condition_summary(scored), str(tmp_path))
    names = os.listdir(tmp_path / "summary.json")
    part = [n for n in names if n.endswith(".json")]
    assert len(part) == 1
    assert json.loads((tmp_path / "summary.json" / part[0]).read_text())["n"] == 3


def test_partial_summaries_add_up(spark):
    rows = [log_row(i, token_f1=i / 10000, latency_s=i / 100, is_correct=i % 2) for i in range(50)]
    scored = spark.createDataFrame(pd.DataFrame(rows))
    parts = [SU.summary_partials(scored.where(F.col("sample_idx") % 3 == i)) for i in range(3)]
    merged = SU.finish_summary(SU.merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    assert merged.collect() == SU.condition_summary(scored).collect()


def test_log_columns_keep_their_order():
    assert LOG_V1 == LOG_COLUMNS[:9] and len(LOG_V2) == 14 and len(LOG_V3) == 18


def test_dataset_em_takes_texts_and_names_in_any_case(spark):
    rows = spark.createDataFrame(
        [("GSM8K", "#### 5", "Answer: 5"), ("gsm8k", "#### 5", "Answer: 6"), ("Gsm8k", "#### 1,000", "so 1000"), ("StrategyQA", "true", "Answer: yes")],
        "dataset string, answer_raw string, generation string").withColumns({"prompt_tokens": F.lit(1), "completion_tokens": F.lit(1)})
    assert SU.dataset_em(rows).collect() == [("gsm8k", 3, 2 / 3 * 100), ("strategyqa", 1, 100.0)]
    assert SU.dataset_em(rows.limit(0)).collect() == [("gsm8k", 0, 0.0), ("strategyqa", 0, 0.0)]
    with pytest.raises(Exception, match="Unknown dataset"):
        SU.dataset_em(rows.withColumn("dataset", F.lit("other"))).collect()


def test_columns_behind_many_others_are_read(spark, tmp_path):
    wide = [f"x{i}" for i in range(60)] + LOG_V2
    values = {"dataset": "gsm8k", "strategy": "s", "sample_idx": "7", "generation": "a, \"b\"\nc", "gold_answer": "0", "condition": "late"}
    with open(tmp_path / "run_1.csv", "w", newline="") as file:
        writer = csv.DictWriter(file, wide, restval="")
        writer.writeheader()
        writer.writerow(values)
        writer.writeheader()  # a header once more, as appended logs have it
        writer.writerow({**values, "sample_idx": "8"})
    rows = runlog.read_run_logs(spark, [str(tmp_path / "run_1.csv")], required=["generation", "condition"]).orderBy("sample_idx").collect()
    assert [(r.sample_idx, r.generation, r.gold_answer, r.condition) for r in rows] == [(i, 'a, "b"\nc', "0", "late") for i in (7, 8)]


def test_log_keeps_embedding_scores(spark, tmp_path):
    log = spark.createDataFrame([("gsm8k", "s", 1, 0.5, "run_1.csv")], "dataset string, strategy string, sample_idx long, bertscore_f1 double, source_file string")
    runlog.write_back(log, f"{tmp_path}/log")
    row = runlog.read_log(spark, f"{tmp_path}/log").collect()[0]
    assert (row.bertscore_f1, row.source_file, row.generation) == (0.5, "run_1.csv", None)


def test_damaged_files_are_named_and_left_out(spark, logs):
    whole = gzip.compress(("\n".join(["dataset,strategy,sample_idx,gold_answer,generation"] + [f"gsm8k,s,{i},1,x{i}" for i in range(20000)])).encode())
    for name, data in {
            "run_7.csv.gz": whole, "run_8.csv.gz": whole[:len(whole) // 2], "run_9.csv.gz": b"no gzip", "run_10.csv.gz": whole[:-5] + b"\0\1\2\3\4",
            "run_11.csv": b"dataset,strategy,sample_idx,gold_answer,generation\ngsm8k,s,1,2,\xff\xfe\n",
            "run_12.csv": b"\x89PNG\r\n\x1a\n" + bytes(range(256)) * 20, "run_13.csv.bz2": bz2.compress(whole)[:-7], "run_14.csv.gz": whole + whole,
            "run_15.csv.gz": b""}.items():
        with open(f"{logs}/{name}", "wb") as f:
            f.write(data)
    with pytest.warns(UserWarning) as seen:
        log = runlog.read_run_logs(spark, [f"{logs}/run_*"], required=["generation", "gold_answer"])
    said = "\n".join(str(w.message) for w in seen)
    for n in (8, 9, 10, 11, 12, 13, 15, 5, 6):
        assert f"run_{n}.csv" in said, n
    for n in (1, 2, 3, 4, 7, 14):
        assert f"run_{n}.csv" not in said, n
    rows = log.groupBy("source_file").count().collect()
    assert {r["source_file"]: r["count"] for r in rows} == {
        "run_1.csv": 2, "run_2.csv": 2, "run_3.csv": 2, "run_4.csv": 1, "run_7.csv.gz": 20000, "run_14.csv.gz": 40000}


def test_files_that_only_spark_finds_unreadable(spark, logs, monkeypatch):
    whole = gzip.compress(b"dataset,strategy,sample_idx,gold_answer,generation\n" + b"gsm8k,s,1,1,x\n" * 5000)
    for n, data in ((7, whole), (8, whole[:-30]), (9, b"no gzip")):
        with open(f"{logs}/run_{n}.csv.gz", "wb") as f:
            f.write(data)
    monkeypatch.setattr(quarantine, "PROBE_BYTES", -1)
    with pytest.warns(UserWarning) as seen:
        log = runlog.read_run_logs(spark, [f"{logs}/run_*.gz"], required=["generation", "gold_answer"])
    assert len([w for w in seen if "FAILED_READ_FILE" in str(w.message)]) == 2
    assert [r["count"] for r in log.groupBy("source_file").count().collect()] == [5000]
