"""Near vectors against brute force."""

import random

import numpy as np

from conftest import FOLDER
from corpus import rows_of

from pursebook.llm import queries
from pursebook.llm import neighbours
from pursebook.llm.neighbours import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, cell string, n int"
COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def by_hand(rows, threshold):
    def unit(embedding, label, vec_id):
        if vec_id is None or label is None or not embedding or None in embedding:
            return None
        row = np.array(embedding, np.float32).astype(np.float64)
        return row / np.sqrt(row @ row) if np.isfinite(row).all() and row.any() else None

    units = [unit(e, label, i) for i, e, label in rows]
    linked = {i: set() for i, _, _ in rows if i is not None}
    for (a, _, x), u in zip(rows, units):
        for (b, _, y), v in zip(rows, units):
            if a != b and u is not None and v is not None and x == y and len(u) == len(v) and u @ v >= threshold:
                linked[a].add(b)
    result = []
    for i, _, _ in rows:
        seen, open_ = {i}, [i]
        while open_:
            for j in linked.get(open_.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        smallest = None if i is None else min(seen)
        result.append((i, len(linked.get(i, ())), smallest, smallest is None or smallest == i))
    return sorted(result, key=str)


def test_near_vectors(table):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(150)]
    centre = rng.standard_normal(16)
    rows += [(200 + i, (centre + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(120)]
    rows += [(400 + i, (centre + (0.02 * i) * rng.standard_normal(16)).tolist(), 2) for i in range(40)]
    rows += [(500 + i, centre.tolist(), i % 2) for i in range(30)]
    rows += [(600, (centre * 3).tolist(), 1), (601, (-centre).tolist(), 1), (602, None, 1), (603, [], 1), (604, [0.0] * 16, 1)]
    rows += [(605, [float("nan")] * 16, 1), (606, [float("inf")] * 16, 1), (607, [None] * 16, 1), (608, centre.tolist(), None)]
    rows += [(609, centre[:8].tolist(), 1), (610, [1e-30] * 16, 0), (611, [1e30] * 16, 0), (612, [-0.0, 1.0] * 8, 0), (613, [0.0, 1.0] * 8, 0)]
    rows += [(None, centre.tolist(), 1), (500, centre.tolist(), 0)]
    random.Random(1).shuffle(rows)
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows]
    found = near_vectors(table(SCHEMA, [(*r, 1, "x", 2) for r in rows]), 0.93)
    assert rows_of(found, *COLUMNS) == by_hand(rows, 0.93)


def test_links_are_whole_when_recall_stays_low(table, monkeypatch):
    """Starts that find next to nothing: the audit sees it, and the labels are compared in blocks."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((300, 24))
    rows = [(i, (centres[i % 300] + 0.1 * rng.standard_normal(24)).astype(np.float32).tolist(), i % 2) for i in range(600)]
    for name, value in {"TABLES": 1, "RUN": 4, "LIST": 1, "SAMPLE": 2, "MOST_STARTS": 1, "BLOCK": 50}.items():
        monkeypatch.setattr(neighbours, name, value, raising=False)
    monkeypatch.setattr(neighbours.links, "__defaults__", (1,))
    found = near_vectors(table(SCHEMA, [(*r, 1, "x", 2) for r in rows]), 0.93)
    assert rows_of(found, *COLUMNS) == by_hand(rows, 0.93)


def test_no_vectors(table):
    assert near_vectors(table(SCHEMA, [])).collect() == []


def test_the_table(spark):
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert rows_of(queries.op1_near_vectors(spark, FOLDER), *COLUMNS) == by_hand(given, 0.93)


def test_near_copies_make_a_row_each(table, monkeypatch):
    """A group of near copies that lies in several blocks: whole, but written as rows for its vectors, not for its links."""
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(600)]
    rows += [(600 + i, rng.standard_normal(16).astype(np.float32).tolist(), 1) for i in range(60)]
    written, stored = {}, neighbours.stored

    def counted(frame, name):
        kept = stored(frame, name)
        written[name] = max(written.get(name, 0), kept.count())
        return kept

    monkeypatch.setattr(neighbours, "stored", counted)
    monkeypatch.setattr(neighbours, "BLOCK", 100, raising=False)
    found = near_vectors(table(SCHEMA, [(*r, 1, "x", 2) for r in rows]), 0.93)
    assert rows_of(found, *COLUMNS) == by_hand(rows, 0.93)
    assert max(written.values()) < 20 * len(rows), written
