"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import text_slices, tidy, whole_text
from .words import LOWER, mix, range_hash, word_spans

BITS = 18
SCALE = 20.0
SAMPLE = 8_000  # labelled documents that a fit reads at most, those with the lowest hash of their id
THRESHOLD = 0.3

#: Byte classes of shapes: letters, capitals, digits and bytes of longer characters; any other byte is its own class.
_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(10)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one per hash bucket; the last is the bias

    def logits(self, buckets: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        total = np.maximum(np.bincount(text, minlength=texts), 1)
        return self.weights[-1] + np.bincount(text, self.weights[buckets], texts) * SCALE / total


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every one- and two-word gram of the words and of their shapes.

    A shape is the word's sequence of byte classes without repeats (``Aa``, ``a###`` as ``a#``); two-word grams of shapes
    also tell whether both words are the same.
    """
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = range_hash(LOWER[data], starts, ends)
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(change, out=before[1:])
    shapes = range_hash(kind[change], before[starts], before[ends])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = np.flatnonzero(text[1:] == text[:-1])
    step = np.uint64(0x9E3779B97F4A7C15)
    word_pairs = mix(words[pair] * step + words[pair + 1])
    shape_pairs = mix(shapes[pair] * step + shapes[pair + 1] + (words[pair] == words[pair + 1]))
    hashes = np.concatenate([words, mix(shapes + np.uint64(1)), word_pairs, mix(shape_pairs + np.uint64(2))])
    return (hashes % np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate([text, text, text[pair], text[pair]])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights after passing over (buckets, values, label) examples one by one."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rate = np.zeros(1 << BITS)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(examples)):
            at, values, label = examples[i]
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            squares = gradient * gradient
            rate = (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / alpha
            z[at] += gradient - rate * w
            n[at] += squares
    return weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents whose crc32(doc_id) mod 5 is not 0.

    At most ``sample`` labelled ids are used, those with the lowest hash; a doc_id with several labels has the lowest, labels other
    than 0 and 1 and null ids don't count. Updates are sequential, so the features of the sample (bounded by it)
    meet in one task. Without labels all weights are 0 and every score is 0.5.
    """
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = whole_text(docs, "doc_id").join(F.broadcast(known), "doc_id")

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
            for begin, end, data, offsets in text_slices(batch):
                buckets, text = ngram_buckets(data, offsets)
                key, count = np.unique(text << BITS | buckets, return_counts=True)
                cut = np.searchsorted(key, np.arange(end - begin + 1) << BITS)
                total = np.maximum(np.bincount(text, minlength=end - begin), 1)
                out = [(ids[begin + i], marks[begin + i], (key[cut[i]:cut[i + 1]] & ((1 << BITS) - 1)).astype(np.int32).tobytes(),
                        (count[cut[i]:cut[i + 1]] * (SCALE / total[i])).astype(np.float32).tobytes()) for i in range(end - begin)]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "label", "at", "x"), r)) for r in out], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])
    made = rows.mapInArrow(features, "doc_id long, label int, at binary, x binary")

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "label", "at", "x"])
        bias = (1 << BITS) - 1
        examples = [(np.append(np.frombuffer(r.at, np.int32), bias).astype(np.int64), np.append(np.frombuffer(r.x, np.float32), 1.0), r.label)
                    for r in part.itertuples()]
        return pd.DataFrame({"weights": [ftrl(examples).tobytes()]})

    found = made.withColumn("sample", F.lit(0)).groupBy("sample").applyInPandas(train, "weights binary").collect()
    return Model(np.frombuffer(bytes(found[0][0]), np.float32) if found else np.zeros(1 << BITS, np.float32))


def _batch_scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    scores = np.zeros(batch.num_rows)
    for begin, end, data, offsets in text_slices(batch):
        scores[begin:end] = model.logits(*ngram_buckets(data, offsets), end - begin)
    return 1 / (1 + np.exp(-np.clip(scores, -35, 35)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text alone.

    Null and empty texts have the score of the bias. Repeated rows are scored each; an empty table gives no rows.
    """
    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _batch_scores(model, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = whole_text(docs, "doc_id").withColumn("held_out", held_out(F.col("doc_id")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that the model does not reject.

    A null text is scored as an empty one, repeated rows stay or go together, an empty table gives none.
    """
    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_batch_scores(model, batch) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
