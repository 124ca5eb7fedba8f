"""Collocations and the language model against plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from corpus import AWKWARD, documents, rows_of
from pursebook.llm import katz
from pursebook.llm.collocations import collocations
from pursebook.llm.queries import op13_katz_scores

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def katz_by_hand(rows):
    """(doc_id, text, held_out) -> the scores, from dictionaries of strings."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), "</s>"] for _, text, _ in rows]
    learnt = [t for t, (_, _, held) in zip(tokens, rows) if not held]
    unigram = Counter(w for t in learnt for w in t)
    pairs = Counter(p for t in learnt for p in zip(["<s>", *t], t))
    history, follow = Counter(), defaultdict(dict)
    for (h, w), c in pairs.items():
        history[h] += c
        follow[h][w] = c
    n, v = sum(unigram.values()), len(unigram)
    by_count = Counter(pairs.values())
    d = katz.discounts([by_count[r] for r in range(1, katz.CUT + 2)])

    def base(w):
        return (unigram[w] + 0.5) / (n + 0.5 * (v + 1))

    def kept(c):
        return c * d[c - 1] if c <= katz.CUT else c - 0.5

    weights = {}

    def weight(h):
        if h not in weights:
            left = 1 - sum(kept(c) for c in follow[h].values()) / history[h]
            weights[h] = left / (1 - sum(base(w) for w in follow[h]))
        return weights[h]

    def probability(h, w):
        if h not in history:
            return base(w)
        return kept(follow[h][w]) / history[h] if w in follow[h] else weight(h) * base(w)

    for h in list(follow)[:20]:
        whole = sum(probability(h, w) for w in unigram) + weight(h) * base("a word never seen")
        assert whole == pytest.approx(1)
    return [
        (i, held, len(t), sum(unigram[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t),
         sum(math.log10(probability(h, w)) for h, w in zip(["<s>", *t], t)))
        for t, (i, _, held) in zip(tokens, rows)
    ]


def same_scores(found, expected):
    def ordered(rows):
        return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4)))

    assert len(found) == len(expected)
    for one, other in zip(ordered(found), ordered(expected), strict=True):
        assert one[:5] == other[:5]
        assert one[5:] == pytest.approx(other[5:], abs=1e-6, rel=1e-9)


def test_katz_on_the_table(spark):
    read = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in read]
    found = [tuple(r) for r in op13_katz_scores(spark, FOLDER).collect()]
    same_scores(found, katz_by_hand(rows))
    held = [r for r in found if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


@pytest.mark.parametrize("small", [False, True])
def test_katz_of_awkward_rows(table, small):
    rows = [*AWKWARD, *[(100 + i, "hot hot hot word " * 50 + f"end{i}") for i in range(60)]]
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = katz.katz_scores(documents(table, rows), held, **({"bucket_bytes": 2000, "block_tokens": 500} if small else {}))
    expected = katz_by_hand([(i, t, i is None or zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows])
    same_scores([tuple(r) for r in scored.collect()], expected)


def test_katz_without_rows_to_learn_from(table):
    assert katz.katz_scores(documents(table, []), F.lit(False)).count() == 0
    found = katz.katz_scores(documents(table, [(1, "one two"), (2, None)]), F.lit(True)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]


def test_discounts_are_shares():
    assert all(0 < d < 1 for d in katz.discounts([100, 40, 20, 12, 8, 6]))
    assert katz.discounts([0] * 6) == katz.discounts([5, 0, 0, 0, 0, 0]) == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def collocations_by_hand(rows, least, top, covered_percent=80, scale=2_000_000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang != "" else ""] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    counts["und" if lang is None else lang][tuple(w[i : i + size])] += 1
    found = []
    for lang, f in counts.items():
        often = {g: c for g, c in f.items() if c >= least and len(g) > 1}
        ranked = []
        for g, a in often.items():
            score, k = min((scale * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            longer = [c for x, c in often.items() if len(x) > len(g) and any(x[i : i + len(g)] == g for i in range(len(x)))]
            if not longer or 100 * max(longer) < covered_percent * a:
                ranked.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_collocations_of_awkward_rows(table, small):
    made = [("a b c d. a b, A B c; b C d e\tf!" * 5, "en"), ("a a a a a a a a a", "en"), ("a b c d" * 3, None), ("x\x0by x y", ""), (None, "de"), ("", "de")]
    made += [("tie one, tie two\ntie  one;tie two " + str(i), "fr") for i in range(9)]
    made += [(text, "en") for _, text in AWKWARD]
    rows = table(
        "doc_id long, text string, lang string, code long, w string, f int, a int, word string, n int",
        [(i % 3, text, lang, 1, "x", 2, 3, "z", 4) for i, (text, lang) in enumerate(made * 2)],
    )
    found = collocations(rows, least=3, top=25, **({"range_bytes": 300, "block_tokens": 40} if small else {}))
    expected = collocations_by_hand(made * 2, 3, 25)
    assert len(expected) > 20
    assert rows_of(found, *found.columns) == expected


def test_collocations_without_texts(table):
    assert collocations(documents(table, [])).count() == 0
    assert collocations(documents(table, [(1, None), (2, "a b")])).count() == 0
