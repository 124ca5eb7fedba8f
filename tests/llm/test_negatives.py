"""Hard negatives against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pursebook.llm import negatives
from pursebook.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, norm int, size string, centre int, block int, want int"


def vectors(table, rows):
    return table(SCHEMA, [(i, v, label, "x", 1, "y", 2, 3, 4) for i, v, label in rows])


def by_hand(rows, every, positives=5, wanted=3):
    whole = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(256 * x) for x in v])
            if sum(x * x for x in row[1]) < 1 << 62:
                whole[i] = min(whole.get(i, row), row)
    found = []
    for anchor, (label, v) in whole.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, other == label) for i, (other, w) in whole.items() if i != anchor and len(w) == len(v))
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            fits = [(s, i) for s, i, same in scored if not same and 50 * -score <= 100 * -s <= 95 * -score]
            found += [(anchor, positive, rank, i, -score, -s) for rank, (s, i) in enumerate(fits[:wanted], 1)]
    return sorted(found)


def made(count, seed, sizes=(6,)):
    import numpy as np

    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    rows = []
    for i in range(count):
        size = rng.choice(sizes)
        centre = centres[0 if rng.random() < 0.4 else rng.randrange(5)]
        v = [float(np.float32(round(c + rng.gauss(0, 0.4), 2))) for c in centre[:size]]
        rows.append((i, v, 0 if rng.random() < 0.4 else rng.randrange(6)))
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(40)]
    return rows


@pytest.mark.parametrize("cell", [negatives.CELL, 600, 60])
def test_hard_negatives_of_made_rows(table, cell):
    rows = made(400, 3)
    found = hard_negatives(vectors(table, rows), F.col("vec_id") % 10 == 0, cell=cell)
    expected = by_hand(rows, 10)
    assert len(expected) > 300
    assert sorted(map(tuple, found.collect())) == expected


def test_hard_negatives_of_awkward_rows(table):
    nan, inf = float("nan"), float("inf")
    rows = made(60, 4, sizes=(2, 3))
    rows += [(20, [9.0, 9.0], 1), (20, [9.0, 8.0], 1), (None, [1.0, 1.0], 1), (110, None, 1), (120, [nan, 1.0], 1), (130, [inf, 1.0], 1)]
    rows += [(140, [None, 1.0], 1), (150, [1.0, 1.0], None), (160, [0.0, 0.0], 2), (170, [0.0, 0.0], 2), (180, [0.0, 0.0], 3), (190, [], 1), (200, [], 1)]
    rows += [(210, [], 2), (220, [1e30, 1.0], 1), (230, [1.0] * 7, 1), (240, [-1.0, -1.0], 4), (250, [1.0, 1.0], 4), (260, [4e6, 4e6], 2), (270, [4e6, 4e6], 2), (280, [3e6, 3e6], 1)]
    rows += [rows[10], rows[10]]
    found = hard_negatives(vectors(table, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == by_hand(rows, 10)


def test_hard_negatives_without_anchors(table):
    assert hard_negatives(vectors(table, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(vectors(table, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 10 == 0).count() == 0
