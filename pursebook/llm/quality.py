"""Text quality from weak labels.

1. Labellers: heuristics that overlap; each votes good, bad or not at all on a document.
2. Label model: expectation-maximisation over the vote patterns estimates, without any true label,
   how often each labeller votes what on good and on bad documents, and with that the posterior of
   each pattern. There are at most 3^LABELLERS patterns, so the counts fit the driver at any size.
3. Scorer: a linear model on hashed features of the text, trained on the posteriors of a bounded
   sample. In each round every task runs through its documents from the common weights, and the
   results are averaged.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.llm.tables import in_tasks, stored, texts

FEATURES = 1 << 14
MAX_TRAINED = 20_000
ROUNDS = 4
EM_ROUNDS = 200
THRESHOLD = 0.5

_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_ALL = bytes(range(256))
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:!?'\"()-")


def _without(text: bytes, kept: bytes) -> int:
    """How many of the text's bytes are in `kept`."""
    return len(text) - len(text.translate(None, kept))


@dataclass
class Measures:
    """What the labellers look at."""

    words: int
    repeats: float
    neighbours: float
    capitals: float
    symbols: float
    digits: float
    bars: float
    sentence: float
    word_length: float
    shouting: float


def measures(text: bytes) -> Measures:
    words = text.split()
    n = max(len(words), 1)
    letters = _without(text, _LOWER + _UPPER) or 1
    ends = text.count(b".") + text.count(b"?") + text.count(b"!")
    same = sum(map(bytes.__eq__, words, words[1:]))
    return Measures(
        words=len(words),
        repeats=1 - len(set(words)) / n,
        neighbours=same / n,
        capitals=_without(text, _UPPER) / letters,
        symbols=_without(text, _SYMBOLS) / max(len(text), 1),
        digits=_without(text, _DIGITS) / max(len(text), 1),
        bars=(text.count(b"|") + text.count(b"\t")) / n,
        sentence=n / max(ends, 1),
        word_length=sum(map(len, words)) / n,
        shouting=text.count(b"!") / n,
    )


def _vote(value: float, good: float, bad: float) -> int:
    """1 (good) up to `good`, -1 (bad) from `bad` on, 0 between."""
    return 1 if value <= good else -1 if value >= bad else 0


def votes(m: Measures) -> tuple[int, ...]:
    """The labellers: each looks at one or two measures, and several see each kind of defect."""
    if not m.words:
        return (-1,) * LABELLERS
    plain = max(m.symbols, m.digits)
    return (
        _vote(m.neighbours, 0.02, 0.10),
        _vote(m.capitals, 0.15, 0.30),
        _vote(m.symbols, 0.01, 0.04),
        _vote(m.bars, 0.02, 0.15),
        _vote(m.shouting, 0.05, 0.20),
        _vote(max(4 * m.neighbours, 3 * m.shouting, 8 * m.symbols, 2 * m.bars, m.capitals), 0.25, 0.6),
        _vote(m.repeats - 0.25 * math.log10(m.words + 1), 0.1, 0.4),
        _vote(max(plain, m.capitals / 4, m.neighbours), 0.05, 0.08),
    )


LABELLERS = 8


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, patterns = [], []
        for text, doc_id in texts(batch, "doc_id"):
            ids.append(doc_id)
            patterns.append("".join("-0+"[v + 1] for v in votes(measures(text))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(patterns, pa.string())], names=["doc_id", "pattern"])


@dataclass
class LabelModel:
    """Share of good documents, and by labeller how often it votes -1, 0, 1 on bad and on good ones."""

    good: float
    rates: np.ndarray

    def posterior(self, pattern: str) -> float:
        """How likely a document with these votes is good."""
        at = ["-0+".index(c) for c in pattern]
        logs = np.log(self.rates[:, range(len(at)), at]).sum(axis=1) + np.log([1 - self.good, self.good])
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))


def label_model(counts: dict[str, int], rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns, from a majority vote.

    Each class keeps the equivalent of one vote of each kind per labeller, so that no rate is zero.
    """
    patterns = sorted(counts)
    if not patterns:
        return LabelModel(0.5, np.full((2, LABELLERS, 3), 1 / 3))
    n = np.array([counts[p] for p in patterns], float)
    seen = np.array([["-0+".index(c) for c in p] for p in patterns])
    one_hot = np.eye(3)[seen]
    good = np.array([0.05 if p.count("-") >= 2 else 0.5 if "-" in p else 0.95 for p in patterns])
    model = LabelModel(0.5, np.empty(0))
    for _ in range(rounds):
        weights = np.stack([(1 - good) * n, good * n])
        rates = np.einsum("cp,plv->clv", weights, one_hot) + 1.0
        model = LabelModel(float((weights[1].sum() + 1) / (n.sum() + 2)), rates / rates.sum(axis=2, keepdims=True))
        after = np.array([model.posterior(p) for p in patterns])
        moved, good = np.abs(after - good).max(), after
        if moved < 1e-9:
            break
    return model


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text: hashed last four characters of its words' shapes, as shares, the labellers' measures, and a constant. No words as such."""
    shapes = text.translate(_SHAPES)
    words = shapes.split()
    n = max(len(words), 1)
    counts = Counter(w[-4:] for w in words)
    found = {0: 1.0}
    for shape, count in counts.items():
        at = zlib.crc32(shape) % (FEATURES - 16) + 16
        found[at] = found.get(at, 0.0) + count / n
    m = measures(text)
    for i, value in enumerate((m.neighbours, m.capitals, m.symbols, m.digits, m.bars, m.shouting, m.repeats), 1):
        found[i] = min(4 * value, 4.0)
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))


#: letters by case, digits, and other characters as they are
_SHAPES = bytes(97 if c in _LOWER or c >= 128 else 65 if c in _UPPER else 48 if c in _DIGITS else c for c in range(256))


def _train(weights: np.ndarray, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = weights.copy(), 0
        for batch in batches:
            for text, target in texts(batch, "target"):
                at, values = features(text)
                p = 1 / (1 + math.exp(-min(max(float(own[at] @ values), -30.0), 30.0)))
                own[at] += rate * (target - p) * values
                n += 1
        if n:
            changed = np.flatnonzero(own != weights)
            columns = [pa.array(changed, pa.int32()), pa.array((own - weights)[changed] * n), pa.array(np.full(len(changed), n))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "moved", "n"])

    return run


def train(sample: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the linear scorer from (text, target) rows: averaged after each round over the tasks."""
    weights = np.zeros(FEATURES)
    total = sample.count()
    for turn in range(rounds if total else 0):
        moved = in_tasks(sample, _train(weights, 1.0 / (1 + turn)), "at int, moved double, n long")
        #: at most FEATURES rows
        for row in moved.groupBy("at").agg(F.sum("moved").alias("moved")).collect():
            weights[row["at"]] += row["moved"] / total
    return weights


def _score(model: Broadcast):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("posterior", pa.float64()), ("wordless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posteriors = model.value
        for batch in batches:
            ids, scores, labels, wordless = [], [], [], []
            for text, doc_id in texts(batch, "doc_id"):
                at, values = features(text)
                ids.append(doc_id)
                scores.append(1 / (1 + math.exp(-min(max(float(weights[at] @ values), -30.0), 30.0))))
                labels.append(posteriors["".join("-0+"[v + 1] for v in votes(measures(text)))])
                wordless.append(not text.split())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, scores, labels, wordless), schema, strict=True)], schema=schema)

    return run


def quality(documents: DataFrame, max_trained: int = MAX_TRAINED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `documents`: doc_id, score (0 to 1, higher: better), posterior, kept.

    `posterior` is the label model's belief that the document is good; `score` the linear scorer's.
    A document is kept if its score reaches the threshold; one without words never is. The label
    model counts the votes on all documents; the scorer learns from the first `max_trained` rows in
    the order of a hash of doc_id. Texts are read whole; other columns are not looked at.
    """
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    labelled = stored(in_tasks(documents, _label, "doc_id long, pattern string"), "votes")
    #: at most 3^LABELLERS rows
    counts = {row["pattern"]: row["n"] for row in labelled.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = label_model(counts)
    posteriors = {pattern: model.posterior(pattern) for pattern in counts}
    chosen = labelled.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "pattern").limit(max_trained)
    target = F.element_at(F.create_map(*[F.lit(x) for item in posteriors.items() for x in item]), F.col("pattern")) if posteriors else F.lit(0.5)
    chosen = stored(chosen.dropDuplicates(["doc_id"]).select("doc_id", target.alias("target")), "targets")
    #: at most max_trained rows of two numbers
    sample = stored(documents.join(F.broadcast(chosen), "doc_id").select("text", "target"), "trained")
    fitted = spark.sparkContext.broadcast((train(sample), posteriors))
    scored = in_tasks(documents, _score(fitted), "doc_id long, score double, posterior double, wordless boolean")
    return scored.select("doc_id", "score", "posterior", (~F.col("wordless") & (F.col("score") >= threshold)).alias("kept"))
