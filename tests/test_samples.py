import csv
import json

import pytest
from pyspark.sql import functions as F

from gradeloom.catalog import queries
from gradeloom.operators.samples import first_n, with_gold
from gradeloom.sources import scratch
from gradeloom.sources.datasets import read_dataset, read_samples
from gradeloom.sources.scratch import scratch_path, written


def test_positions_follow_the_files(spark, tmp_path):
    spark.range(1000).select(F.lit("q").alias("question"), F.concat(F.lit("#### "), "id").alias("answer")).repartitionByRange(
        4, F.length("answer"), "answer").write.parquet(f"{tmp_path}/numeric")
    spark.range(7).select(F.lit("q").alias("question"), (F.col("id") % 2 == 0).alias("answer")).coalesce(1).write.parquet(
        f"{tmp_path}/boolean")
    samples = read_samples(spark, f"{tmp_path}/numeric", f"{tmp_path}/boolean")
    rows = samples.where("dataset = 'gsm8k'").collect()
    assert sorted(r["sample_idx"] for r in rows) == list(range(1000))
    in_order = [r["answer"] for r in spark.read.parquet(f"{tmp_path}/numeric").collect()]
    assert len(set(in_order)) == 1000
    assert first_n(samples, 5).count() == 10 and first_n(samples, None).count() == 1007
    gold = with_gold(samples.where("dataset = 'strategyqa'")).orderBy("sample_idx").collect()
    assert [r["gold_answer"] for r in gold] == ["yes", "no"] * 3 + ["yes"]


def test_json_datasets_with_and_without_an_index(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "question": "q", "answer": true}\n{"id": 0, "question": "r", "answer": false}\n')
    rows = read_dataset(spark, "strategyqa", f"{tmp_path}/a.json", "json", index="id").orderBy("sample_idx").collect()
    assert [(r["question"], r["answer_raw"]) for r in rows] == [("r", "false"), ("q", "true")]
    rows = read_dataset(spark, "strategyqa", f"{tmp_path}/a.json", "json").orderBy("sample_idx").collect()
    assert [(r["sample_idx"], r["question"], r["answer_raw"]) for r in rows] == [(0, "q", "true"), (1, "r", "false")]


@pytest.fixture
def small_splits(spark):
    for key, value in (("maxPartitionBytes", "300"), ("openCostInBytes", "100")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    yield
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def test_positions_in_split_text_files(spark, tmp_path, small_splits):
    """Many splits a file, blank lines, long and short lines, an empty file; several files in one task."""
    folder, want = tmp_path / "json", []
    folder.mkdir()
    for f, n in (("a", 120), ("b", 0), ("c", 1), ("d", 60)):
        lines = []
        for i in range(n):
            want.append(f"{f}{i} é" + "x" * (i * 37 % 500))
            lines.append(json.dumps({"question": want[-1], "answer": f"#### {i}"}, ensure_ascii=False) + ("\n\n" if i % 7 == 0 else "\n"))
        (folder / f"{f}.json").write_text("".join(lines), encoding="utf-8")
    found = read_dataset(spark, "gsm8k", str(folder), "json")
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
    assert [(r["sample_idx"], r["question"]) for r in found.orderBy("sample_idx").collect()] == list(enumerate(want))
    assert first_n(found, 3).count() == 3


def test_positions_in_csv_files_with_line_ends(spark, tmp_path, small_splits):
    folder, want = tmp_path / "csv", []
    folder.mkdir()
    for f in "ab":
        with open(folder / f"{f}.csv", "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file)
            out.writerow(["question", "answer"])
            for i in range(40):
                want.append((f'{f}{i} "said",\nand\\ left', i % 3 == 0))
                out.writerow([want[-1][0], str(want[-1][1]).lower()])
    found = read_dataset(spark, "strategyqa", str(folder), "csv").orderBy("sample_idx").collect()
    assert [(r["sample_idx"], r["question"], r["answer_raw"]) for r in found] == [(i, q, str(a).lower()) for i, (q, a) in enumerate(want)]


def test_scratch_paths_are_new_and_can_be_cleared(spark, tmp_path, monkeypatch):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    monkeypatch.setattr(scratch, "_root", lambda spark: f"{tmp_path}/shared/app")
    assert written(spark.range(3), "table").count() == 3 and len(list((tmp_path / "shared/app").iterdir())) == 1
    scratch.clear_scratch(spark)
    assert list((tmp_path / "shared").iterdir()) == []
    scratch.clear_scratch(spark)


def test_question_sets_are_written_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, i * 1.5) for i in range(400)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"{i} " * 100, "en") for i in range(300)], "doc_id long, text string, lang string").write.parquet(
        f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "FILE_BYTES", 4000, raising=False)
    numeric, boolean = queries._sample_files(spark, str(tmp_path))
    assert numeric.rdd.getNumPartitions() >= 3 and boolean.rdd.getNumPartitions() > 15
    for read in (queries.read_samples, queries.read_text_samples):
        found = {(r.dataset, r.sample_idx): r.question for r in read(spark, str(tmp_path)).collect()}
        assert len(found) == 700 and found["strategyqa", 299].split() == ["299"] * 100 and found["gsm8k", 399] == "Order 399"


def test_rows_are_not_shuffled_for_their_positions(spark, tmp_path, monkeypatch):
    spark.range(50).select(F.col("id").cast("string").alias("question"), F.lit("a").alias("answer")).repartition(5).write.json(f"{tmp_path}/json")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = read_dataset(spark, "gsm8k", f"{tmp_path}/json", "json")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
