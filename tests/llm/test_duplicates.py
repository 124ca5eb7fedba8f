"""Exact and near duplicates, and repeated lines, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from conftest import FOLDER
from corpus import AWKWARD, documents, rows_of, words

from pursebook.llm import minhash, queries
from pursebook.llm.components import components
from pursebook.llm.exact import exact_duplicates
from pursebook.llm.lines import without_repeated_lines
from pursebook.llm.minhash import near_duplicates


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    result = queries.QUERIES[name](spark, FOLDER)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert rows_of(result, *columns) == sorted(cursor.fetchall(), key=str)


def exact_by_hand(rows):
    bare = [re.sub("[\x20\x09-\x0d]", "", text or "") for _, text in rows]
    groups = defaultdict(list)
    for (doc_id, text), key in zip(rows, bare):
        groups[key].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    result = []
    for (doc_id, _), key in zip(rows, bare):
        keep = min(groups[key], key=lambda g: g[:3])[3]
        result.append((doc_id, keep, len(groups[key]), doc_id == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(result, key=str)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("block_bytes, hash_bits", [(4096, 64), (16, 64), (16, 3)])
def test_exact_duplicates(table, block_bytes, hash_bits):
    """Small blocks need many levels; short hashes collide and are told apart by the bytes."""
    rows = AWKWARD[:12] + AWKWARD[13:] + [(20, words(5, 200)), (21, words(5, 200) + "!"), (22, "!" + words(5, 200)), (23, words(5, 200) + "\n")]
    if block_bytes < 4096:
        rows = [(i, (t or "")[:1000] and t[:1000]) for i, t in rows]
    assert rows_of(exact_duplicates(documents(table, rows), block_bytes, hash_bits), *EXACT) == exact_by_hand(rows)


def test_exact_duplicates_of_nothing(table):
    assert exact_duplicates(documents(table, [])).collect() == []


def near_by_hand(rows, size, percent):
    sets, parent = [], {}
    for doc_id, text in rows:
        own = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))) if own else frozenset())
        if doc_id is not None:
            parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if a is not None and b is not None and sets[i] and 100 * shared >= percent * union:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    found = []
    for (doc_id, _), own in zip(rows, sets):
        component = None if doc_id is None else root(doc_id)
        found.append((doc_id, len(own), component, component is None or component == doc_id))
    return sorted(found, key=str)


def test_near_duplicates(table):
    base = words(7, 300).split()
    rows = list(AWKWARD)
    for k in range(40):
        changed = list(base)
        for at in range(k):
            changed[at * 7] = f"new{k}"
        rows.append((100 + k, " ".join(changed)))
    chain = words(8, 100).split()
    rows += [(200 + k, " ".join(chain[k * 6 : k * 6 + 60])) for k in range(7)]
    for size in (4, 5):
        found = near_duplicates(documents(table, rows), words=size, percent=80)
        assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == near_by_hand(rows, size, 80)


def hot_group(count, pairs):
    """Texts with one common part, at 100/130 of each other; of `pairs` pairs the second shares three more shingles, at 103/127."""
    common = words(50, 104)
    ends = [words(1000 + i, 15).split() for i in range(count)]
    for i in range(pairs):
        ends[count - 1 - i][:3] = ends[i][:3]
    return [(1000 + i, f"{common} {' '.join(end)}") for i, end in enumerate(ends)]


def test_near_duplicates_in_a_hot_bucket(table):
    """Pairs that share no bucket but those of hundreds of others that they are unlike."""
    rows = hot_group(600, 60) + [(1000, words(51, 200)), (1001, words(52, 200))]
    expected = near_by_hand(rows, 5, 80)
    assert sum(not kept for *_, kept in expected) == 60
    found = near_duplicates(documents(table, rows), words=5, percent=80)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == expected


def test_rounds_that_link_little_are_the_last(table, monkeypatch):
    """Hundreds of unlike members of a bucket aren't paired with ever new centres: a star, one round, and the exact join."""
    tried, confirmed = [], minhash._confirmed

    def counted(sets, pairs, percent):
        tried.append(pairs.count())
        return confirmed(sets, pairs, percent)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    rows = hot_group(600, 60)
    found = near_duplicates(documents(table, rows), words=5, percent=80)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == near_by_hand(rows, 5, 80)
    assert len(tried) == 3


def test_near_duplicates_of_nothing(table):
    assert near_duplicates(documents(table, [])).collect() == []


def test_components(table):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 100), (91, 90), (7, 7), (None, 3)] + [(200, x) for x in range(201, 260)]
    found = {r["id"]: r["component"] for r in components(table("a long, b long", pairs)).collect()}
    assert found == {**dict.fromkeys(range(1, 61), 1), 90: 90, 91: 90, 100: 90, **dict.fromkeys(range(200, 260), 200)}
    assert components(table("a long, b long", [])).collect() == []


def lines_by_hand(rows):
    def key(line):
        own = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in own)

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    result = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if doc_id is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == doc_id]
        result.append((doc_id, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(result, key=str)


@pytest.mark.parametrize("batches", [1, 5])
def test_repeated_lines(table, batches):
    """Whatever the number of batches and the merges of runs they bring."""
    common = "This line is in very many documents"
    rows = AWKWARD + [(30 + i, f"own line {i} of this document\n{common}\n{words(i % 4, 6)}\n{common}") for i in range(30)]
    found = without_repeated_lines(documents(table, rows), batches=batches, with_text=True)
    assert rows_of(found, "doc_id", "n_lines", "n_dropped", "kept_text") == lines_by_hand(rows)
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in found.collect())


def test_repeated_lines_of_nothing(table):
    assert without_repeated_lines(documents(table, [])).collect() == []
