"""Near copies by odd sketches against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from gradeloom.llm import oddsketch
from tests.llm import reference as ref


def check(docs, size, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = oddsketch.near_duplicates(docs, size, percent).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in rows)
    want = ref.jaccard_components([(d, t) for d, t in rows if d is not None], size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None} == {
        d: (n, c, d == c) for d, (n, c) in want.items()}
    assert not any(r.kept for r in found if r.doc_id is None)
    return want


@pytest.mark.parametrize("size,percent", [(5, 85), (4, 90)])
def test_odd_rows(spark, size, percent):
    want = check(ref.odd_documents(spark), size, percent)
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("chunk,size", [(4, 1 << 24), (2048, 3000)])
def test_large_groups_lose_no_link(spark, monkeypatch, chunk, size):
    """A chain of copies, each like the next one but not like the one after some: no member is near all."""
    monkeypatch.setattr(oddsketch, "SKETCH_CHUNK", chunk)
    monkeypatch.setattr(oddsketch, "SET_CHUNK", chunk)
    monkeypatch.setattr(oddsketch, "CHUNK_BYTES", size)
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    texts = []
    for i in range(40):
        words[(7 * i) % 150] = f"new{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randint(0, 300)}" for _ in range(rng.randint(3, 40))) for _ in range(30)]
    texts += texts[:10] + texts[40:45] * 3
    order = list(range(len(texts)))
    rng.shuffle(order)
    want = check(spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string"), 5, 85)
    assert len({want[order[i]][1] for i in range(40)}) == 1


def test_empty_table(spark):
    found = oddsketch.near_duplicates(ref.empty_documents(spark))
    assert found.collect() == [] and found.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def pairs(rng, similarity, count, n=400):
    """Sets of which ``similarity`` is shared, and their samples."""
    shared = round(2 * n * similarity / (1 + similarity))
    for _ in range(count):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[:shared], rng.integers(0, 2**63, n - shared).astype(np.uint64)])
        yield oddsketch.minhash(np.concatenate([x, y]), np.array([0, n]))


def test_sketches_tell_high_similarities_apart():
    rng = np.random.default_rng(4)
    most = oddsketch.odd_bits(85)
    for similarity in (0.85, 0.9, 0.97):
        guesses = []
        for samples in pairs(rng, similarity, 150):
            x, y = oddsketch.odd_sketch(samples)
            guesses.append(float(oddsketch.estimate(x, y)))
            assert np.bitwise_count(x ^ y).sum() <= most
            keys = oddsketch.band_keys(samples)
            assert (keys[0] == keys[1]).any()
        assert abs(np.mean(guesses) - similarity) < 0.01 and np.std(guesses) < 0.04
    far = [np.bitwise_count(np.bitwise_xor(*oddsketch.odd_sketch(s))).sum() > most for s in pairs(rng, 0.4, 150)]
    assert np.mean(far) > 0.99
