"""The updates of the quality classifier and the votes of SimHash, step by step in plain Python."""

import math
import random

import numpy as np

from gradeloom.llm import quality, simhash, words
from gradeloom.llm.shared import string_slices


def plain_ftrl(rows, rounds=3, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3):
    """Follow-the-regularised-leader over (text, label) rows, one feature after the other; values are as the classifier rounds them."""
    examples = []
    for text, label in rows:
        buckets, _ = quality.ngram_buckets(*string_slices([text.encode()]))
        total = max(len(buckets), 1)
        at, count = np.unique(buckets, return_counts=True)
        examples.append(([*zip(at.tolist(), (count * (quality.SCALE / total)).astype(np.float32).astype(float).tolist()), ((1 << quality.BITS) - 1, 1.0)], label))
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(rounds):
        for e in order.permutation(len(examples)):
            values, label = examples[e]
            w = {i: weight(i) for i, _ in values}
            odds = max(-35.0, min(35.0, sum(w[i] * x for i, x in values)))
            error = 1 / (1 + math.exp(-odds)) - label
            for i, x in values:
                gradient = error * x
                rate = (math.sqrt(n.get(i, 0.0) + gradient ** 2) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + gradient - rate * w[i]
                n[i] = n.get(i, 0.0) + gradient ** 2
    out = np.zeros(1 << quality.BITS, np.float32)
    for i in z:
        out[i] = weight(i)
    return out


def test_fit_equals_plain_updates(spark):
    rng = random.Random(2)
    word = ["alpha", "Beta", "gamma,", "dé", "x1", "BUY", "$$$", "the"]
    texts = [" ".join(rng.choice(word[4:] if i % 3 else word[:5]) for _ in range(rng.randint(0, 60))) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id long, quality int")
    known = [r.doc_id for r in labels.where(~quality.held_out(labels["doc_id"])).orderBy("doc_id").collect()]
    want = plain_ftrl([(texts[i], int(i % 3 == 0)) for i in known])
    found = quality.fit(docs, labels).weights
    assert np.count_nonzero(want) > 50 and np.allclose(found, want, rtol=1e-4, atol=1e-6)


def test_votes_equal_plain_counts():
    rng = random.Random(3)
    texts = ["", " ", "one", "one two", "a b a b a b"] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    found = simhash.fingerprints([t.encode() for t in texts])
    for text, halves in zip(texts, found):
        hashes, _ = words.shingle_hashes(*words.word_hashes(*string_slices([text.encode()])), simhash.SHINGLE)
        for half in range(2):
            mixed = words.mix(hashes + np.uint64(half)).tolist()
            # bits are counted byte by byte from the low one, the highest bit of each first
            votes = [sum(1 if value >> (8 * byte + 7 - bit) & 1 else -1 for value in mixed) for byte in range(8) for bit in range(8)]
            want = sum(1 << (8 * (k // 8) + 7 - k % 8) for k, v in enumerate(votes) if v > 0)
            assert int(halves[half]) == want
