import pandas as pd
import pytest

from gradeloom.operators.summary import condition_summary, finish_summary, merge_partials, summary_partials
from gradeloom.sources.files import Folder
from gradeloom.streaming import totals as TO
from gradeloom.streaming.scoring import read_scores, running_summary, score_stream

SCHEMA = ("dataset string, strategy string, sample_idx long, condition string, question string, answer_raw string, "
          "generation string, prompt_tokens long, completion_tokens long, latency_s double")


def put(folder, name, keys):
    rows = [dict(dataset="gsm8k", strategy="zero_shot_cot", sample_idx=i, condition="c", question="q",
                 answer_raw=f"#### {i}", generation=f"Answer: {i - i % 3}", prompt_tokens=1, completion_tokens=2,
                 latency_s=0.5) for i in keys]
    pd.DataFrame(rows).to_parquet(folder / name)


@pytest.fixture
def stream(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(checkpoint="cp"):
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = score_stream(rows, f"{tmp_path}/log", f"{tmp_path}/{checkpoint}", f"{tmp_path}/totals")
        query.awaitTermination()
        log = read_scores(spark, f"{tmp_path}/log")
        assert running_summary(spark, f"{tmp_path}/totals").collect() == condition_summary(log).collect()
        return sorted(r["sample_idx"] for r in log.select("sample_idx").collect()), query.recentProgress

    return run


def test_restarts_score_each_key_once(spark, tmp_path, stream):
    source = tmp_path / "in"
    put(source, "a.parquet", list(range(30)) + [5, 5])
    put(source, "b.parquet", range(20, 50))
    assert stream()[0] == list(range(50))
    put(source, "c.parquet", range(40, 80))
    assert stream()[0] == list(range(80))
    assert stream()[0] == list(range(80))
    # a lost checkpoint replays the source without doubling a key
    assert stream("cp2")[0] == list(range(80))
    put(source, "d.parquet", range(70, 90))
    assert stream("cp2")[0] == list(range(90))
    assert read_scores(spark, f"{tmp_path}/log").where("is_correct = 1").count() == 30


def test_batches_read_their_own_rows_only(spark, tmp_path, stream):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    for i in range(9):
        put(tmp_path / "in", f"{i}.parquet", range(5 * i, 5 * i + 10))
    keys, progress = stream()
    assert keys == list(range(50))
    batches = [p for p in progress if p.numInputRows]
    assert [p.numInputRows for p in batches] == [10] * 9  # of rows and of known keys together
    assert [p.stateOperators[0].numRowsTotal for p in batches] == [5 * i + 10 for i in range(9)]
    assert spark.conf.get(provider) == before
    # the second query takes the known keys once, with its first batch
    keys, progress = stream("cp2")
    assert keys == list(range(50))
    assert [p.numInputRows for p in progress if p.numInputRows] == [60] + [10] * 8


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path, stream):
    for i in range(3):
        put(tmp_path / "in", f"{i}.parquet", range(10 * i, 10 * i + 12))
    assert stream()[0] == list(range(32))
    Folder(spark, f"{tmp_path}/cp").delete("commits/2")  # as if the query had died before its last commit
    assert stream()[0] == list(range(32))


def log_rows(spark, batch):
    return spark.createDataFrame([("gsm8k", "s", f"c{batch % 2}", 1, 0, 0.25)],
                                 "dataset string, strategy string, condition string, is_correct int, parse_failed int, latency_s double")


def test_totals_are_merged_level_by_level(spark, tmp_path):
    totals, fan, log = f"{tmp_path}/totals", 3, None
    for batch in range(29):
        rows = log_rows(spark, batch)
        log = rows if log is None else log.union(rows)
        for _ in range(2 if batch in (5, 8, 26) else 1):  # some batches are repeated
            TO.add_batch(summary_partials(rows), totals, "q", batch, fan)
        tables = TO.chosen_tables(spark, totals, fan)
        digits, n = 0, batch + 1
        while n:
            digits, n = digits + n % fan, n // fan
        assert len(tables) == digits  # the digits of the number of batches, written to the base of the fan
    assert len(Folder(spark, totals).names("query_id=q/level=0")) <= 2 * fan
    TO.add_batch(summary_partials(log_rows(spark, 0)), totals, "other", 0, fan)
    found = finish_summary(merge_partials(TO.read_totals(spark, totals, fan)))
    want = condition_summary(log.union(log_rows(spark, 0)))
    assert sorted(found.collect()) == sorted(want.collect())


def test_unfinished_merges_are_not_read(spark, tmp_path):
    totals, fan = f"{tmp_path}/totals", 2
    for batch in range(2):
        TO.add_batch(summary_partials(log_rows(spark, batch)), totals, "q", batch, fan)
    assert [t.rsplit("/", 2)[1] for t in TO.chosen_tables(spark, totals, fan)] == ["level=1"]
    Folder(spark, totals).delete("query_id=q/level=1/first=0/_SUCCESS")
    assert [t.rsplit("/", 2)[1] for t in TO.chosen_tables(spark, totals, fan)] == ["level=0"] * 2
    assert TO.read_totals(spark, f"{tmp_path}/none").count() == 0
