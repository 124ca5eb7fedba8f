"""URL verdicts: rules by host and path, and for the others a naive Bayes on segmented words.

1. Rules: the longest rule whose host is the url's or a parent domain and whose path starts the url's.
2. Segmentation: a host is cut at what is neither letter nor digit in Unicode; each label is split into words by a Viterbi search over
   unigram counts of the pages' own text. Only the labels' substrings are counted, found by a join,
   so no lexicon is broadcast.
3. Classes: a multinomial naive Bayes over host words and path tokens, learnt from the urls that the
   rules decide, gives the verdict of the rest. Token counts stay in tables.

Pages are many and hosts few: segmentation works on distinct host labels, classes on distinct urls.
"""

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.llm.tables import in_tasks, stored, texts

#: as many characters as a host label may have
LONGEST_WORD = 63
SMOOTHING = 0.5

_TAGS = re.compile(rb"<[^>]*>")
#: what is ASCII and no letter ends a word for certain; the rest is looked at once per distinct run
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MARKS = "".join(chr(c) for c in (*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c))[0] == "M")
#: runs of letters with their marks
_WORD = re.compile(rf"(?:[^\W\d_]|[{_MARKS}])+")
#: what stands between the labels of a host: neither letter, mark nor digit
_BETWEEN = r"[^\p{L}\p{M}\p{N}]+"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#`, A-Z lower-cased. Path: from there up to `?` or `#`. Else both empty."""
    column = F.coalesce(F.col(url), F.lit(""))
    start = F.locate("://", column)
    rest = F.when(start > 0, F.substring(column, start + 3, F.length(column))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ruled(rules: list[Rule], value: str) -> Column:
    """`value` of the longest rule that fits; NULL if none does. Of equally long rules the first in order."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        chosen = F.when(fits, getattr(rule, value)).otherwise(chosen)
    return chosen


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the pages' text with counts; the empty word has the number of all."""
    for batch in batches:
        runs: Counter[bytes] = Counter()
        for (html,) in texts(batch):
            text = _TAGS.sub(b" ", html)
            text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
            runs.update(text.translate(_LETTERS).split())
        counts: Counter[str] = Counter()
        for run, n in runs.items():
            for word in (run.decode(),) if run.isascii() else _WORD.findall(run.decode()):
                counts[word] += n
        kept = [("", sum(counts.values())), *((word, n) for word, n in counts.items() if len(word) <= LONGEST_WORD)]
        columns = [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])


def split_words(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words whose concatenation is `label`; an unknown word is ten times less likely with each letter."""
    best, cut = [0.0], [0]
    for end in range(1, len(label) + 1):
        scores = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = label[start:end]
            n = counts.get(word, 0)
            scores.append((best[start] + (math.log(n / total) if n else -math.log(total) - len(word) * math.log(10)), start))
        score, start = max(scores)
        best.append(score)
        cut.append(start)
    words, end = [], len(label)
    while end:
        words.append(label[cut[end] : end])
        end = cut[end]
    return words[::-1]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        words = [
            split_words(label, dict(zip(known, counts, strict=True)), max(total or 1, 1))
            for label, known, counts, total in zip(*(rows[c] for c in ("label", "words", "counts", "total")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(rows["label"], pa.string()), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])


def _substrings(label: str) -> Column:
    starts = F.sequence(F.lit(1), F.length(label))
    return F.flatten(
        F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length(label) - i + 1)), lambda n: F.substring(label, i, n)))
    )


def segmented_labels(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """(label, words) of each distinct label, split by the unigram counts of the pages' text."""
    labels = stored(labels.where("label <> ''").distinct(), "labels")
    parts = stored(labels.select("label", F.explode(F.array_distinct(_substrings("label"))).alias("word")), "label-parts")
    wanted = parts.select("word").union(labels.sparkSession.createDataFrame([("",)], "word string")).distinct()
    counted = in_tasks(pages.select(F.col("html").alias("text")), _count_words, "word string, n long")
    lexicon = stored(counted.join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n")), "lexicon")
    total = lexicon.where("word = ''").agg(F.max("n")).first()[0] or 1
    known = parts.join(lexicon, "word").groupBy("label").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts"))
    known = labels.join(known, "label", "left").select(
        "label",
        F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        F.coalesce("counts", F.array().cast("array<long>")).alias("counts"),
        F.lit(total).alias("total"),
    )
    return stored(in_tasks(known, _split, "label string, words array<string>"), "segmented")


def _tokens(urls: DataFrame, segmented: DataFrame) -> DataFrame:
    """(host, path, token): host words, and the path's words; numbers stand by their length."""
    path = F.regexp_extract_all(F.lower("path"), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))
    path = F.transform(path, lambda t: F.concat(F.lit("p:"), F.when(t.rlike(r"^\p{N}"), F.concat(F.lit("#"), F.length(t))).otherwise(t)))
    of_path = urls.select("host", "path", F.explode(path).alias("token"))
    labels = urls.select("host").distinct().select("host", F.explode(F.split(F.lower("host"), _BETWEEN)).alias("label"))
    words = labels.join(segmented, "label").select("host", F.explode("words").alias("word"))
    of_host = urls.join(words, "host").select("host", "path", F.concat(F.lit("h:"), "word").alias("token"))
    return of_path.union(of_host)


def _judged(ruled: DataFrame, urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, path, score) of the urls without a rule: the log-odds of `block` by naive Bayes."""
    labels = urls.select(F.explode(F.split(F.lower("host"), _BETWEEN)).alias("label"))
    tokens = stored(_tokens(urls, segmented_labels(labels, pages)), "url-tokens")
    verdicts = ruled.where("rule IS NOT NULL").groupBy("host", "path", "verdict").agg(F.count(F.lit(1)).alias("pages"))
    taught = tokens.join(verdicts, ["host", "path"]).groupBy("token").agg(
        *(F.sum(F.when(F.col("verdict") == v, F.col("pages")).otherwise(0)).alias(v) for v in ("block", "allow"))
    )
    taught = stored(taught, "url-token-counts")
    classes = verdicts.agg(*(F.sum(F.when(F.col("verdict") == v, F.col("pages")).otherwise(0)) for v in ("block", "allow"))).first()
    n, block, allow = taught.agg(F.count(F.lit(1)), F.sum("block"), F.sum("allow")).first()
    prior = math.log((classes[0] or 0) + 1) - math.log((classes[1] or 0) + 1)
    likely = [F.ln((F.col(v) + SMOOTHING) / ((total or 0) + SMOOTHING * (n + 1))) for v, total in (("block", block), ("allow", allow))]
    weights = taught.select("token", (likely[0] - likely[1]).alias("weight"))
    unseen = math.log((allow or 0) + SMOOTHING * (n + 1)) - math.log((block or 0) + SMOOTHING * (n + 1))
    asked = urls.join(ruled.where("rule IS NULL").select("host", "path").distinct(), ["host", "path"], "left_semi")
    scored = tokens.join(weights, "token", "left").groupBy("host", "path").agg(F.sum(F.coalesce("weight", F.lit(unseen))).alias("odds"))
    return asked.join(scored, ["host", "path"], "left").select(
        "host", "path", F.round(F.lit(prior) + F.coalesce("odds", F.lit(0.0)), 9).alias("score")
    )


def url_verdicts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, score.

    A rule decides where one fits. Else the verdict is `block` if the naive Bayes log-odds `score` is
    above zero, and `allow` if not; without tokens (no host, no path) the classes' shares decide.
    A NULL url, or one without `://`, has an empty host and path. Page ids are passed through, NULL
    and repeated ones too; an empty table gives no rows; other columns are not looked at. Rules are few: each is an expression.
    """
    host, path = host_and_path("url")
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.select("*", _ruled(rules, "name").alias("rule"), _ruled(rules, "verdict").alias("verdict"))
    urls = stored(split.select("host", "path").distinct(), "urls")
    scores = stored(_judged(ruled, urls, pages), "url-scores")
    found = ruled.join(scores, ["host", "path"], "left")
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
