"""The five stages of the corpus pipeline, each against a brute-force version on what the one before kept."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import decontaminate, mixing, quality, records, tokens
from gradeloom.llm.shared import string_slices, tidy
from tests.llm import reference as ref
from tests.llm.test_quality_updates import plain_ftrl

EXTRA = ["_size", "_rank", "number", "row", "mark", "kind"]


def corpus(folder, spark, empty=False):
    """Good and bad texts, copies, near copies, leaked items, repeated rows, null ids, empty texts, and columns with clashing names."""
    rng = random.Random(6)
    words = [a + b for a in ("al", "be", "ga", "de", "ep", "ze") for b in ("pha", "ta", "mma", "lta", "silon", "é")]
    good = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY", "NOW!!!", "$$$", "click", "7777", "xxx"]) for _ in range(n))
    items = [(i, good(18)) for i in range(6)] + [(6, None), (7, "")]
    rows, labels = [], []
    for i in range(240):
        kind = rng.random()
        text = bad(rng.randint(20, 120)) if kind < 0.3 else good(rng.randint(20, 200))
        if kind > 0.95:
            text += " " + rng.choice(items[:6])[1].upper() + " " + good(5)
        rows.append((i, text, rng.choice("ab")))
        labels.append((i, int(kind >= 0.3), 0))
    base = rows[-1][1].split()
    for i in range(240, 260):
        near = list(base)
        near[i % len(near)] = "changed" if i % 2 else near[i % len(near)]
        rows.append((i, " ".join(near), rng.choice("abc")))
    rows += [rows[5], rows[5], (None, good(50), "a"), (None, None, None), (300, None, "a"), (301, "", None), (302, " \n", "b"), (303, good(3000), None)]
    rows.append(rows[-6])
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame([] if empty else rows, schema)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit(f"<{n}>").alias(n) for n in EXTRA])
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([] if empty else labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([] if empty else items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def rows_of(df):
    return [(r.doc_id, r.text or "", r.source) for r in df.collect()]


def scores(texts, weights):
    buckets, text = quality.ngram_buckets(*string_slices([t.encode() for t in texts]))
    logits = quality.Model(weights).logits(buckets, text, len(texts))
    return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))


def test_stages_equal_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outputs = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
            out.write.parquet(f"{folder}/stage-{number}")
            docs = spark.read.parquet(f"{folder}/stage-{number}")
            assert all(r[n] == f"<{n}>" for r in docs.select(*EXTRA).collect() for n in EXTRA)
            outputs.append(docs)
        else:
            outputs.append(out)
    start, kept, single, clean, mixed = (rows_of(df) for df in [spark.read.parquet(f"{folder}/documents.parquet"), *outputs[:4]])

    # quality: the classifier fitted by plain updates on the labelled, not held-out rows
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    sample = sorted((d, labels[d], t) for d, t, _ in start if d in labels and zlib.crc32(str(d).encode()) % 5)
    weights = plain_ftrl([(t, y) for _, y, t in sample])
    good = [s >= quality.THRESHOLD for s in scores([t for _, t, _ in start], weights)]
    assert Counter(kept) == Counter(r for r, g in zip(start, good) if g)
    assert all(labels.get(d, 1) == 1 for d, _, _ in kept) and len(kept) < len(start)

    # one of each group of similar documents
    groups = ref.jaccard_components([(i, t) for i, (_, t, _) in enumerate(kept)], 5, 80)
    best = defaultdict(list)
    for i, (d, _, _) in enumerate(kept):
        best[groups[i][1]].append((d is None, d or 0))
    assert Counter(d for d, _, _ in single) == Counter(None if min(g)[0] else min(g)[1] for g in best.values())
    assert len(single) < len(kept)

    # no document within the edit budget of a benchmark item
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    leaked = lambda t: any(ref.edit_distance_inside(i, decontaminate.normalised(t))[0] <= len(i) // 12 for i in items)
    short = [r for r in single if len(r[1]) < 3000]  # brute force takes long on the longest
    assert Counter(r for r in clean if len(r[1]) < 3000) == Counter(r for r in short if not leaked(r[1]))
    assert len(clean) < len(single)

    # the mix: words of each document as often as its blocks are taken, sources near their targets
    sizes = Counter()
    for _, t, s in clean:
        sizes[s] += len(ref.WORD.findall(t))
    target, taken = ref.water_filled(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.REPEATS), Counter()
    own = defaultdict(Counter)
    for d, t, s in clean:
        own[d, s] += Counter(ref.WORD.findall(t))
    for d, t, s in mixed:
        words = ref.WORD.findall(t)
        taken[s] += len(words)
        assert words and not Counter(words) - Counter({w: 2 * n for w, n in own[d, s].items()})
    assert all(abs(taken[s] - target[s]) <= 512 for s in sizes)

    # records: ids of the library, in order of doc_id, each with the end id
    coder = tokens.Encoder(tokens.vocabulary_path(), False)
    want, begin = [], 0
    for d, t, _ in sorted(mixed, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, begin, len(ids), zlib.crc32(ids.tobytes())))
        begin += len(ids)
    assert sorted((tuple(r) for r in outputs[4].collect()), key=lambda r: r[1]) == want
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1]) == want  # a rerun agrees


def test_pipeline_of_empty_tables(spark, tmp_path):
    corpus(str(tmp_path), spark, empty=True)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == 0


def resident() -> int:
    """Bytes of memory this process holds beside mapped files."""
    return 1024 * int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1])


def test_workers_keep_no_memory_from_one_task_to_the_next(spark, tmp_path):
    path, before = tokens.vocabulary_path(), []

    @tidy
    def fill(batches):
        before.append(resident())
        held = [bytes(range(256)) * 4 for _ in range(200_000)] + [object()]
        before.append(resident())
        yield len(held)

    assert list(fill(iter([]))) == [200_001]
    assert before[1] - before[0] > 150e6 and resident() - before[0] < 50e6
    docs = spark.createDataFrame([(i, f"word{i} is number {i}") for i in range(300)], "doc_id long, text string")

    def held(batches):
        for batch in batches:
            coder = tokens.encoder(path, False, tokens.SMALL)
            yield batch.slice(0, 1).set_column(0, "doc_id", pa.array([len(coder.young.place) + len(coder.old.place)]))

    records.write_records(docs.coalesce(1), f"{tmp_path}/records", sizes=tokens.SMALL).collect()
    found = docs.coalesce(1).mapInArrow(held, docs.schema).collect()
    assert found and max(r.doc_id for r in found) < 10
    coder = tokens.encoder(path, False, tokens.SMALL)
    first = coder.encode([r.text for r in docs.limit(9).collect()])
    coder.forget()
    assert coder.encode([r.text for r in docs.limit(9).collect()]) == first
