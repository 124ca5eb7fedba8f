"""Toxicity, quality and url verdicts: hand-made parts, planted cases and held-out labels."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from corpus import AWKWARD, documents, rows_of, words

from pursebook.llm import queries
from pursebook.llm.quality import label_model, measures, quality, votes
from pursebook.llm.toxicity import Model, Weights, evidence, fit, judged, segments, toxicity, weighted, words_of
from pursebook.llm.urls import Rule, segmented_labels, split_words, url_verdicts

LABELS = "doc_id long, quality int, toxic int"
LARGER = "/root/testdata/sf0.1"


def maximal_by_hand(scores):
    """Segments whose proper subsegments all score less, and which lie in no larger such segment."""
    n = len(scores)

    def total(i, j):
        return sum(scores[i:j])

    def is_maximal_candidate(i, j):
        return total(i, j) > 0 and all(
            total(a, b) < total(i, j) - 1e-12 for a in range(i, j) for b in range(a + 1, j + 1) if (a, b) != (i, j)
        )

    fine = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if is_maximal_candidate(i, j)]
    return sorted((i, j) for i, j in fine if not any((a, b) != (i, j) and a <= i and j <= b for a, b in fine))


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    for _ in range(60):
        weights = {b"w%d" % k: rng.choice([-2.0, -0.5, 0.7, 1.3, 3.1]) for k in range(6)} | {b"plain": 0.0}
        text = [rng.choice(list(weights)) for _ in range(14)]
        found = segments(text, weights, drift=0.21, memory=0)
        scores = [weights[w] - 0.21 for w in text]
        assert [(a, b) for _, a, b in found] == maximal_by_hand(scores)
        assert all(math.isclose(s, sum(scores[a:b]), abs_tol=1e-9) for s, a, b in found)


def test_segments_take_linear_time():
    weights = {b"up": 1.0, b"down": -0.9}
    assert segments([b"up", b"down"] * 200_000, weights, drift=0.01, memory=0)
    assert segments([b"up", b"down"] * 200_000, {b"up": 9.0, b"down": -0.9}, drift=0.01)


def toxic_corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        own = words(1000 + i, rng.randint(20, 300)).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["Vilify,", "scorn", "SNEER."]))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxic_documents_are_found(table):
    rows, labels = toxic_corpus()
    more = [(1000 + i, text) for i, (_, text) in enumerate(AWKWARD)]
    marked = table(LABELS, [*labels, (5, None, None), (None, 1, 1), (9999, 0, 1)])
    found = toxicity(documents(table, rows + more), marked).collect()
    assert len(found) == len(rows) + len(more)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["predicted"] == toxic for i, _, toxic in labels)
    assert all(by_id[1000 + i]["predicted"] == 0 for i in range(len(more)))
    assert all(0 <= r["score"] <= 1 and (r["predicted"] == 1) == (r["score"] >= 0.3) for r in found)
    assert any("vilify" in p for p in by_id[0]["passages"])


def test_held_out_labels_are_not_learnt(table):
    rows, labels = toxic_corpus()
    given = documents(table, rows)
    held = {r["doc_id"] for r in toxicity(given, table(LABELS, labels)).where("held_out").collect()}
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    one, other = fit(given, table(LABELS, labels)), fit(given, table(LABELS, turned))
    assert one.weights == other.weights and len(held) > 50
    assert math.isclose(one.place, other.place, abs_tol=1e-9) and math.isclose(one.scale, other.scale, abs_tol=1e-9)


def test_without_labels_nothing_is_toxic(table):
    for labels in ([], [(1, 1, 0)]):
        found = toxicity(documents(table, AWKWARD), table(LABELS, labels)).collect()
        assert len(found) == len(AWKWARD) and not any(r["predicted"] for r in found)
    assert toxicity(documents(table, []), table(LABELS, [])).collect() == []
    assert judged([], Model(), {})[0] < 0.3
    assert evidence([]) == 0.0
    assert evidence([3.0, 3.0, 3.0]) > evidence([3.0]) > evidence([1.0]) > 0


def faded(words, weights, memory):
    """Weights by the definition: each mention looks back at all earlier ones of its word."""
    found = []
    for i, word in enumerate(words):
        if weights[word]:
            before = [j for j in range(i) if words[j] == word]
            found.append((i, weights[word] / (1 + sum(math.exp((j - i) / memory) for j in before))))
    return found


def test_mentions_fade():
    rng = random.Random(8)
    weights = {b"a": 2.0, b"b": -1.0, b"c": 0.5, b"plain": 0.0}
    for memory in (3, 50):
        text = [rng.choice(list(weights)) for _ in range(200)]
        assert [(i, pytest.approx(w)) for i, w in faded(text, weights, memory)] == weighted(text, weights, memory)


def test_each_passage_enters_the_score():
    model = Model({b"bad%d" % k: 4.0 for k in range(8)}, place=1.0, slope=0.1, scale=0.5)
    weights = Weights(model)
    plain = [b"plain"] * 3000
    passage = [b"bad%d" % k for k in range(8)]
    single = [w for k in range(8) for w in (*plain[:900], b"bad%d" % k)]
    for text in (passage, plain + passage, single + plain + passage, (plain + passage[:4]) * 30):
        score, found = judged(text, model, weights)
        assert found and score > 0.9
    score, found = judged(plain, model, weights)
    assert not found and score < 0.01
    #: what makes the score is the segments that are listed, by the definition
    text = plain + passage[:2] + plain + passage[2:4]
    n = len(text)
    normal = [(s - 1.0 - 0.1 * math.log(n)) / 0.5 for s, _, _ in segments(text, weights)]
    one, both = 1 - math.exp(-math.exp(-max(normal))), sum(normal)
    together = math.exp(-both) * both / (math.factorial(2) * math.factorial(1))
    odds = math.log(0.3 / 0.7) + math.log(1e-3) - math.log(min(one, together))
    assert math.isclose(judged(text, model, weights)[0], 1 / (1 + math.exp(-odds)), rel_tol=1e-9)


def test_weights_and_calibration_by_hand(table):
    rows, labels = toxic_corpus()
    model = fit(documents(table, rows), table(LABELS, labels))
    learnt = [(words_of(text.encode()), t) for (i, text), (_, _, t) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [sum(t == k for _, t in learnt) for k in (0, 1)]
    for word in (b"vilify", b"scorn", b"sneer", learnt[0][0][0]):
        c, t = (sum(word in own for own, mark in learnt if mark == k) for k in (0, 1))
        share = 0.05 * (c + t) / sum(n)
        toxic, clean = t + share * n[1], c + share * n[0]
        odds = math.log(toxic / n[1]) - math.log(clean / n[0])
        right = math.copysign(max(abs(odds) - 2.5 * math.sqrt(1 / toxic + 1 / clean), 0.0), odds)
        assert math.isclose(model.weights.get(word, 0.0), right, abs_tol=1e-9)
    weights = Weights(model)
    clean = [own for own, t in learnt if not t]
    points = np.array([(math.log(len(own)), max((s for s, _, _ in segments(own, weights)), default=0.0)) for own in clean])
    slope = max(np.cov(points.T)[0, 1] / np.var(points[:, 0], ddof=1), 0.0)
    middle, high = np.percentile(points[:, 1] - slope * points[:, 0], [50, 99])
    scale = max((high - middle) / (math.log(math.log(2)) - math.log(-math.log(0.99))), 0.2)
    assert math.isclose(model.slope, slope, abs_tol=1e-9) and math.isclose(model.scale, scale, abs_tol=1e-9)
    assert math.isclose(model.place, middle + scale * math.log(math.log(2)), abs_tol=1e-9)


def test_toxicity_on_held_out_documents(spark):
    marked = spark.read.parquet(f"{LARGER}/labels.parquet")
    found = queries.op5_toxic_segments(spark, LARGER).where("held_out").join(marked, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]


def defective(kind, seed):
    own = words(seed, 120).split()
    if kind == "bars":
        return " | ".join(own)
    if kind == "symbols":
        return " ".join(w + random.Random(seed + i).choice(["###", "$$$", "%%%"]) for i, w in enumerate(own))
    if kind == "capitals":
        return " ".join(w.upper() + "!!" for w in own)
    return " ".join(w for w in own[:12] for _ in range(12))


def sound(seed):
    own = words(seed, 200).split()
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(own))


def test_defects_are_rejected_and_sound_texts_kept(table):
    rows = [(i, sound(i)) for i in range(300)]
    rows += [(1000 + i, defective(("bars", "symbols", "capitals", "repeats")[i % 4], i)) for i in range(60)]
    found = {r["doc_id"]: r for r in quality(documents(table, rows)).collect()}
    assert len(found) == len(rows)
    assert all(r["kept"] == (i < 1000) for i, r in found.items())


def test_quality_of_awkward_rows(table):
    found = quality(documents(table, AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert quality(documents(table, [])).collect() == []


def test_texts_without_words_are_never_kept(table):
    rows = [(i, sound(i)) for i in range(200)] + [(1000, None), (1001, ""), (1002, " \t\n")]
    found = {r["doc_id"]: r["kept"] for r in quality(documents(table, rows), threshold=0.0).collect()}
    assert sorted(i for i, kept in found.items() if not kept) == [1000, 1001, 1002]


def test_label_model_recovers_rates():
    """Votes drawn from known rates: the estimates come near them."""
    rng = random.Random(8)
    rates = [(0.9, 0.1), (0.8, 0.05), (0.7, 0.1), (0.85, 0.2), (0.6, 0.1), (0.75, 0.15), (0.9, 0.2), (0.8, 0.1)]
    counts = {}
    for _ in range(20000):
        bad = rng.random() < 0.2
        pattern = "".join("-" if rng.random() < (b if bad else g) else "+" for b, g in rates)
        counts[pattern] = counts.get(pattern, 0) + 1
    model = label_model(counts)
    assert abs(model.good - 0.8) < 0.02
    for i, (bad, good) in enumerate(rates):
        assert abs(model.rates[0, i, 0] - bad) < 0.04 and abs(model.rates[1, i, 0] - good) < 0.04


def test_votes_see_each_defect_more_than_once():
    for kind, seed in itertools.product(("bars", "symbols", "capitals", "repeats"), range(5)):
        assert votes(measures(defective(kind, seed).encode())).count(-1) >= 2
    assert votes(measures(sound(3).encode())).count(-1) == 0


def test_quality_agrees_with_true_labels(spark):
    """The labels are never learnt from."""
    marked = spark.read.parquet(f"{LARGER}/labels.parquet")
    found = queries.op6_weak_label_quality(spark, LARGER).join(marked, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n[0, False] >= 0.85 * (n[0, False] + n.get((0, True), 0))


def test_words_are_split_by_their_counts():
    counts = {"spam": 50, "farm": 40, "news": 60, "new": 80, "s": 5, "far": 10, "the": 500}
    total = sum(counts.values()) * 10
    assert split_words("spamfarm", counts, total) == ["spam", "farm"]
    assert split_words("newsthefarm", counts, total) == ["news", "the", "farm"]
    assert "".join(split_words("qqqxspam", counts, total)) == "qqqxspam"
    assert split_words("", counts, total) == []


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
URLS = [
    ("http://a.example.net/de/1", "a.example.net", "/de/1", "net/", "block"),
    ("HTTP://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
    ("http://example.net", "example.net", "", None, None),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://example.com/DE/", "example.com", "/DE/", None, None),
    ("x://w.org/fr/a://b", "w.org", "/fr/a://b", "org/fr/", "allow"),
    ("http://w.org#/fr/", "w.org", "", None, None),
    ("http://w.org?a/fr/", "w.org", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("://", "", "", None, None),
    ("http:///path/only", "", "/path/only", None, None),
    ("http://ÄÖ.net/ü", "ÄÖ.net", "/ü", "net/", "block"),
]


def test_rules(table):
    rows = [(i, url, "<p>spam farm</p>", "clash", 3) for i, (url, *_) in enumerate(URLS)] + [(None, None, None, None, None)]
    found = url_verdicts(table("page_id long, url string, html string, host string, score int", rows), RULES).collect()
    assert len(found) == len(rows)
    by_id = {r["page_id"]: r for r in found}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("block", "allow")


def test_words_in_hosts_decide_the_rest(table):
    """Hosts made of words that the rules block elsewhere are blocked, others allowed, whatever the joining."""
    text = "<div class='x'>cheap pills casino garden library poems " * 20
    rows = []
    for i in range(40):
        rows.append((i, f"http://{'cheappills' if i % 2 else 'pillscasino'}{i}.net/p/{i}", text))
        rows.append((100 + i, f"http://{'gardenpoems' if i % 2 else 'library'}{i}.org/fr/{i}", text))
    rows += [(1000, "http://casinocheap.biz/x", text), (1001, "http://poemslibrary.biz/x", text)]
    found = {r["page_id"]: r for r in url_verdicts(table("page_id long, url string, html string", rows), RULES).collect()}
    assert (found[1000]["verdict"], found[1001]["verdict"]) == ("block", "allow")


def test_hosts_beyond_ascii_are_judged_by_their_words(table):
    text = "<p>дешево казино «сад» стихи книги\u00a0bücher हिन्दी</p>" * 20
    rows = []
    for i in range(40):
        rows.append((i, f"http://{'дешево' if i % 2 else 'казино'}{i}.net/p", text))
        rows.append((100 + i, f"http://{'стихи' if i % 2 else 'bücher'}{i}.org/fr/", text))
    rows += [(1000, "http://казинодешево.biz/x", text), (1001, "http://СТИХИbücher.biz/x", text)]
    pages = table("page_id long, url string, html string", rows)
    found = {r["page_id"]: r for r in url_verdicts(pages, RULES).collect()}
    assert (found[1000]["verdict"], found[1001]["verdict"]) == ("block", "allow")
    labels = table("label string", [("садbücher",), ("हिन्दीказино",)])
    assert {r["label"]: r["words"] for r in segmented_labels(labels, pages).collect()} == {"садbücher": ["сад", "bücher"], "हिन्दीказино": ["हिन्दी", "казино"]}


def test_repeated_and_very_long_urls(table):
    """Equal urls get equal verdicts, a row each; long hosts and paths are judged whole; of equal odds it is `allow`."""
    long = "https://" + ".".join(["kleinerladen"] * 300) + "/" + "seite/" * 5000 + "1?q=" + "x" * 5000
    urls = [(1, long), (1, long), (2, long), (3, "https://a.net/x"), (4, "https://a.net/x"), (5, "https://b.org/fr/x"), (6, "no url"), (7, None)]
    pages = table("page_id long, url string, html string, host string, word string", [(i, u, "<p>kleiner laden</p>", "h", "w") for i, u in urls])
    found = url_verdicts(pages, [Rule("net", "/", "block"), Rule("org", "/fr/", "allow")]).collect()
    assert sorted(r["page_id"] for r in found) == [i for i, _ in urls]
    by_id = {r["page_id"]: r for r in found}
    assert len({(r["host"], r["path"], r["verdict"], r["score"]) for r in found if r["page_id"] in (1, 2)}) == 1
    assert by_id[1]["path"] == "/" + "seite/" * 5000 + "1"
    assert [by_id[i]["verdict"] for i in (3, 4, 5)] == ["block", "block", "allow"]
    assert by_id[6]["host"] == by_id[7]["path"] == ""


def test_labels_with_further_columns(table):
    rows, labels = toxic_corpus()
    wide = table("doc_id long, quality int, toxic int, text string, word string, c long, t long", [(*row, "scorn", "w", 1, 2) for row in labels])
    given = documents(table, rows)
    plain = toxicity(given, table(LABELS, labels))
    assert rows_of(toxicity(given, wide), "doc_id", "score") == rows_of(plain, "doc_id", "score")


def test_long_words_stay_whole():
    word = "donaudampfschifffahrtsgesellschaft"
    assert split_words("neue" + word, {word: 9, "neue": 9}, 100) == ["neue", word]


@pytest.mark.parametrize("rules", [RULES, []])
def test_no_pages(table, rules):
    assert url_verdicts(table("page_id long, url string, html string", []), rules).collect() == []
