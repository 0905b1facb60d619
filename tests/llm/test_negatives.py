"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest

from gradeloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, shelf string, rank int"


def expected(rows, every):
    points = []
    for name, vector, label in rows:
        if name is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        x = [math.floor(256 * float(np.float32(v))) for v in vector]
        if sum(v * v for v in x) < 1 << 62:
            points.append((name, x, (label + 1) % 10 if name % 7 == 0 else label))
    found = []
    for name, x, label in (p for p in points if p[0] % every == 0):
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), other), kind) for other, y, kind in points if other != name)
        others = sorted(((-sum(a * b for a, b in zip(x, y)), other), kind) for other, y, kind in points)
        for (score, positive), _ in [s for s in scored if s[1] == label][:negatives.POSITIVES]:
            fits = [s for s, kind in others if kind != label and -50 * score <= -100 * s[0] <= -95 * score][:negatives.NEGATIVES]
            found += [(name, positive, rank, n, -score, -s) for rank, (s, n) in enumerate(fits, 1)]
    return sorted(found)


def vectors(seed, n=700, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 10))
        rows.append((i, (centres[label] + rng.normal(size=dims) * 0.7).astype(np.float32).tolist(), label))
    rows += [(n + i, rows[3][1], int(rng.integers(0, 3))) for i in range(300)]  # one vector very often: ties
    rows += [rows[50], rows[100], rows[7]]  # repeated rows, anchors among them
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")], 1), (2150, [float("inf")], 2), (2200, [1.0, 2.0], None),
             (None, [1.0], 2), (2250, [], 3), (2300, [], 3), (2350, [0.5, 0.5], 3), (2351, [0.1] * 20, 4), (2400, [1e30], 1),
             (2450, [3e6, -3e6], 1), (2451, [2.9e6, -3e6], 1), (2452, [2.5e6, -3e6], 2), (-50, [0.3] * 5, 2), (-7, [0.2] * 5, 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block,shelf,cell,copies", [(256, 4096, 1 << 24, 1 << 16), (16, 100, 4000, 5)])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, block, shelf, cell, copies):
    for name, value in (("BLOCK", block), ("SHELF_ROWS", shelf), ("CELL_BYTES", cell), ("SLICE", copies)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(block)
    found = sorted(tuple(r) for r in negatives.hard_negatives(frame(spark, rows)).collect())
    want = expected(rows, 50)
    assert found == want and len(want) > 60


def test_hard_negatives_of_an_empty_table(spark):
    found = negatives.hard_negatives(frame(spark, []))
    assert found.collect() == [] and len(found.columns) == 6


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = [k.tobytes() for k in negatives.hilbert_key(grid, bits)]
        assert len(set(keys)) == len(grid)
        path = grid[sorted(range(len(grid)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_bound_all_scores_and_spare_blocks():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (20, 8))
    blocks, zones = [], ([], [], [])
    for centre in centres:
        x = centre + rng.integers(-9, 9, (30, 8))
        for column, value in zip(zones, (8, x.min(axis=0).astype("<i8").tobytes(), x.max(axis=0).astype("<i8").tobytes())):
            column.append(value)
        blocks.append(x)
    anchors = centres[:5] + rng.integers(-9, 9, (5, 8))
    least, most = negatives.Zones(*zones).bounds(anchors)
    spared = 0
    for a, anchor in enumerate(anchors):
        scores = [x @ anchor for x in blocks]
        fifth = np.sort(np.concatenate(scores))[-5]
        for b, found in enumerate(scores):
            assert least[a, b] <= found.min() and found.max() <= most[a, b]
        spared += int((most[a] < fifth).sum())
    assert spared >= 70  # of 100


def test_window_bounds(spark):
    rng = random.Random(1)
    scores = [*range(-250, 250), *(rng.randint(-2**62, 2**62) for _ in range(200)), 2**62, -2**62]
    low, high = negatives.window_bounds("s")
    for r in spark.createDataFrame([(s,) for s in scores], "s long").select("s", low.alias("low"), high.alias("high")).collect():
        if r.s >= 0:
            assert (r.low, r.high) == (-(-r.s // 2), 95 * r.s // 100)
        else:
            assert r.low > r.high
