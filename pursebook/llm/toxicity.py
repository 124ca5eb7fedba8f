"""Toxic passages as maximum-scoring segments.

1. Word weights: log-odds of a word's document frequency in toxic against clean labelled documents,
   smoothed by a Dirichlet prior in proportion to its frequency in both, and taken at the cautious
   end of its confidence interval, so that a word seen too rarely weighs nothing. Beginnings of
   words are weighed alike; a word without a weight of its own takes its longest beginning's.
2. Segments: a text is a sequence of word weights less a small drift; a word said again soon weighs
   less, for it is little further evidence. The linear-time scan of Ruzzo and Tompa finds all maximal
   scoring segments of the whole text.
3. Calibration: the best segment of n clean words follows an extreme-value (Gumbel) distribution
   whose place is linear in ln n. Place and scale come from the clean labelled documents. The sum
   statistics of Karlin and Altschul extend it to the best r segments together, for every r; the
   least probability over r is the document's evidence, and its log moves the odds of being toxic.
   A word counts in the best segment that has it. The passages reported are segments of the same scan.

Labelled documents are a bounded sample (`max_labelled`), which bounds the weights; everything else
is one pass over the documents without a shuffle.
"""

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.llm.tables import in_tasks, stored, texts

MAX_LABELLED = 20_000
#: weight of the prior: so many documents' worth of the word's overall frequency for each document of a class
PRIOR = 0.05
#: standard errors by which a weight is taken nearer to zero
CAUTION = 2.5
DRIFT = 0.05
WORDS_KEPT = 300_000
#: a clean document is predicted toxic about this often
SIGNIFICANT = 1e-3
#: a segment is reported as a passage if the best of a clean document is rarely as good
PASSAGE = 0.05
#: a mention counts against later ones of the same word as exp(-words between / MEMORY)
MEMORY = 100
BEGINNINGS = (6,)
#: least scale of the Gumbel distribution, for samples whose clean documents hardly differ
LEAST_SCALE = 0.2
THRESHOLD = 0.3

_NOT_WORDS = bytes(c if c >= 128 or chr(c).isalnum() or c == 0x27 else 32 for c in range(256))


@dataclass
class Model:
    """Weights by word and beginning, and the Gumbel parameters of clean documents."""

    weights: dict[bytes, float] = field(default_factory=dict)
    place: float = 0.0
    slope: float = 0.0
    scale: float = 1.0


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and apostrophes."""
    return text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(_NOT_WORDS).split()


def weighted(words: list[bytes], weights: dict[bytes, float], memory: float = MEMORY) -> list[tuple[int, float]]:
    """(place, weight) of the words that weigh something; divided by one more than the fading mentions before."""
    found, mentions = [], {}
    for i, weight in enumerate(map(weights.__getitem__, words)):
        if weight:
            if memory:
                word = words[i]
                last, recent = mentions.get(word, (i, 0.0))
                recent = 1.0 + recent * math.exp((last - i) / memory)
                mentions[word] = i, recent
                weight /= recent
            found.append((i, weight))
    return found


def segments(words: list[bytes], weights: dict[bytes, float], drift: float = DRIFT, memory: float = MEMORY) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, end) in linear time.

    Only weighted words are looked at one by one; the drift of those between is added at once.
    """
    return _scan(weighted(words, weights, memory), drift)


def _scan(faded: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    #: per candidate: total before it, total at its end, first word, end, the last one before it with a lower start
    found: list[list] = []
    total, last = 0.0, 0
    for at, weight in faded:
        total -= drift * (at - last)
        last = at + 1
        score = weight - drift
        if score <= 0:
            total += score
            continue
        left, first, end = total, at, at + 1
        total += score
        right = total
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= left:
                k = found[k][4]
            if k < 0 or found[k][1] >= right:
                break
            left, first = found[k][0], found[k][2]
            del found[k:]
        found.append([left, right, first, end, k])
    return [(right - left, first, end) for left, right, first, end, _ in found]


def _beginnings(word: bytes) -> list[bytes]:
    """What stands for a word without a weight of its own: its first letters, marked by a `*`."""
    return [word[:size] + b"*" for size in BEGINNINGS if len(word) > size]


class Weights(dict):
    """The weight of each word asked for, from the words and beginnings that have one."""

    def __init__(self, model: Model):
        self.model = model.weights
        super().__init__()

    def __missing__(self, word: bytes) -> float:
        if len(self) >= WORDS_KEPT:
            self.clear()
        weight = next((self.model[w] for w in (word, *_beginnings(word)) if w in self.model), 0.0)
        self[word] = weight
        return weight


def _normal(model: Model, score: float, n: int) -> float:
    """The segment's score in units of the clean documents' extreme-value distribution."""
    return (score - model.place - model.slope * math.log(n)) / model.scale


def _log_tail(x: float) -> float:
    """Log of how often the best segment of a clean document of that length is at least as good."""
    return -x if x > 30 else math.log(-math.expm1(-math.exp(-x))) if x > -6 else 0.0


def evidence(normal: list[float]) -> float:
    """Minus the log of the least probability, over r, that a clean document's r best segments sum up to as much."""
    best = sorted((x for x in normal if x > 0), reverse=True)
    least, total = _log_tail(best[0]) if best else 0.0, 0.0
    for r, x in enumerate(best, 1):
        total += x
        if r > 1 and total > r:
            least = min(least, -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r))
    return -least


def _new_evidence(words: list[bytes], faded: list[tuple[int, float]], found: list[tuple[float, int, int]]) -> list[float]:
    """The segments' scores, best first, without what words of better segments add to later ones.

    The best passage counts in full wherever it stands; the same words again elsewhere are no further
    evidence, however long the text.
    """
    places = [i for i, _ in faded]
    said: set[bytes] = set()
    scores = []
    for score, first, end in sorted(found, key=lambda s: (-s[0], s[1])):
        inside = faded[bisect_left(places, first) : bisect_left(places, end)]
        scores.append(score - sum(weight for i, weight in inside if weight > 0 and words[i] in said))
        said.update(words[i] for i, _ in inside)
    return scores


def judged(words: list[bytes], model: Model, weights: dict[bytes, float]) -> tuple[float, list[tuple[float, int, int]]]:
    """The document's score from 0 to 1 and its passages.

    Evidence that a clean document shows with probability SIGNIFICANT makes the score THRESHOLD.
    """
    n = max(len(words), 1)
    faded = weighted(words, weights)
    found = _scan(faded, DRIFT)
    normal = [_normal(model, s[0], n) for s in found]
    apart = [_normal(model, s, n) for s in _new_evidence(words, faded, found)]
    odds = math.log(THRESHOLD / (1 - THRESHOLD)) + math.log(SIGNIFICANT) + evidence(apart)
    score = 1.0 / (1.0 + math.exp(-min(max(odds, -30.0), 30.0)))
    return score, [s for s, x in zip(found, normal, strict=True) if _log_tail(x) <= math.log(PASSAGE)]


def held_out() -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[bytes, list[int]] = {}
        for text, toxic in texts(batch, "toxic"):
            own = set(words_of(text))
            for word in own.union(*map(_beginnings, own)):
                counts.setdefault(word, [0, 0])[toxic] += 1
        columns = [pa.array(counts, pa.binary()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "clean", "toxic"])


def _best_segments(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for batch in batches:
            lengths, best = [], []
            for (text,) in texts(batch):
                words = words_of(text)
                if words:
                    lengths.append(math.log(len(words)))
                    best.append(max((s[0] for s in segments(words, weights)), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.float64()), pa.array(best, pa.float64())], names=["x", "y"])

    return run


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Weights and calibration from at most `max_labelled` labelled documents that are not held out.

    The sample is the first rows in the order of a hash of doc_id. Labels that are NULL or neither 0
    nor 1 are passed over; a document labelled twice is toxic if one label says so. Without labels of
    both classes all weights are zero.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    #: at most max_labelled rows of two numbers
    chosen = stored(documents.select("doc_id", "text").join(F.broadcast(stored(sample, "labels")), "doc_id"), "labelled")
    sizes = {row["toxic"]: row["n"] for row in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model()
    counts = in_tasks(chosen.select("text", "toxic"), _count_words, "word binary, clean long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    share = PRIOR * (F.col("c") + F.col("t")) / (clean + toxic)
    in_toxic, in_clean = F.col("t") + share * toxic, F.col("c") + share * clean
    odds = F.ln(in_toxic / toxic) - F.ln(in_clean / clean)
    error = CAUTION * F.sqrt(1 / in_toxic + 1 / in_clean)
    weight = F.signum(odds) * F.greatest(F.abs(odds) - error, F.lit(0.0))
    weighted = counts.select("word", weight.alias("weight")).where("weight <> 0")
    #: at most one row per distinct word of the bounded sample
    model = Model({bytes(row["word"]): row["weight"] for row in weighted.collect()})
    best = in_tasks(chosen.where("toxic = 0").select("text"), _best_segments(model), "x double, y double")
    #: at most max_labelled rows; the slope from all, place and scale from quantiles, which a few mislabelled documents don't move
    best = stored(best, "best-segments")
    slope = best.agg(F.regr_slope("y", "x")).first()[0]
    model.slope = max(slope or 0.0, 0.0)
    middle, high = best.agg(F.percentile(F.col("y") - model.slope * F.col("x"), [0.5, 0.99])).first()[0] or (0.0, 0.0)
    model.scale = max((high - middle) / (math.log(math.log(2)) - math.log(-math.log(0.99))), LEAST_SCALE)
    model.place = middle + model.scale * math.log(math.log(2))
    return model


def _judge(model: Broadcast):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int32()), ("passages", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        weights = Weights(fitted)
        for batch in batches:
            ids, scores, counts, passages = [], [], [], []
            for text, doc_id in texts(batch, "doc_id"):
                words = words_of(text)
                score, found = judged(words, fitted, weights)
                ids.append(doc_id)
                scores.append(score)
                counts.append(len(found))
                passages.append([b" ".join(words[first:end]).decode("utf-8", "replace") for _, first, end in found])
            columns = [pa.array(c, f.type) for c, f in zip((ids, scores, counts, passages), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def toxicity(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, score, predicted, n_passages, passages.

    Only the text is looked at. A NULL or empty text has no passage and a low score; a document of
    any length is read whole. `passages` are the significant segments in lower case. Rows without
    doc_id are scored like others and count as not held out; repeated rows get a row each. An empty
    table gives no rows; without labels no document is predicted toxic. Other columns are not looked at.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_labelled))
    schema = "doc_id long, score double, n_passages int, passages array<string>"
    scored = in_tasks(documents.select("doc_id", "text"), _judge(model), schema)
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted, "n_passages", "passages")
