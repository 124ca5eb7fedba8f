"""Bigram language model with Katz backoff, as tables of 64-bit word codes partitioned by code.

A text is its words and one end; each is predicted from the token before it, the first one from a start. A seen pair
has the probability d(c) * c / c(h): c <= CUT is discounted by Good-Turing's counts of counts, a larger c, for which
these are too few, by half an occurrence. What that leaves of a history's mass goes to the words never seen after it, in proportion to
their add-half unigram probability, by a weight that makes the history's distribution sum to 1 exactly. A history
never seen leaves everything to the unigrams.

Rows that go through a shuffle hold packed arrays of a (bucket, block) pair: a block is some millions of tokens of
one task, a bucket a range of codes. The pairs of all texts are shuffled once, by their word. The logarithm of a
discount enters a text's score as often as the text has pairs of that count, so a bucket can sum up its texts before
the counts of counts are known; only backoff weights, which depend on them, take a second step, by history.

Words that occur once in each 24 bytes of a bucket's share of the text are heavy; as an occurrence takes two bytes, there are
at most twelve for each bucket. They are counted first, and their counts go along with the code: pairs of a heavy word are spread over all buckets by their
history, and a heavy history's backoff weight is worked out from its sums of all buckets.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.llm import words
from pursebook.llm.tables import in_tasks, stored

CUT = 5
BLOCK_TOKENS = 1 << 20
BUCKET_BYTES = 1 << 23
START, END = np.uint64(1), np.uint64(2)
PACKED = "kind string, bucket long, block long, data binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(documents: DataFrame, held_out: Column, bucket_bytes: int = BUCKET_BYTES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learnt from rows not `held_out`.

    A NULL or empty text is one end; a NULL `held_out` counts as true. Repeated rows are scored, and learnt from, each by
    itself; other columns are passed over. Without rows to learn from, every token is the only unknown word, of
    probability 1, and scores are 0; an empty table gives no rows. Scores are log10. A task holds a block, or one text
    if that is longer, and about `bucket_bytes` of text as pairs; the pairs of one word are combined in their block first.
    """
    buckets = max(4, math.ceil(words.text_bytes(documents) / bucket_bytes))
    rows = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    heavy = _heavy(rows, bucket_bytes // 24, block_tokens)
    pairs = in_tasks(rows, lambda batches: _blocks(batches, buckets, block_tokens, heavy), PACKED)
    summed = stored(pairs.groupBy("bucket").applyInPandas(lambda frame: _released(_bucket(frame, buckets, heavy)), PACKED), "katz")
    stats = _stats(summed, heavy)
    fixes = (
        summed.where("kind IN ('follow', 'unseen')")
        .groupBy("bucket")
        .applyInPandas(lambda frame: _backoffs(frame, stats), PACKED)
    )
    of_blocks = summed.where("kind IN ('texts', 'sums')").unionByName(fixes)
    return of_blocks.groupBy("block").applyInPandas(lambda frame: _scores(frame, stats), SCORES)


def _bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of codes, so that sorted codes have sorted buckets."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Heavy(NamedTuple):
    """Codes in order, the end among them, and how often each occurs in the texts to learn from."""

    codes: np.ndarray
    learnt: np.ndarray

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code is heavy, and where it is."""
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.codes[place] == codes, place


def _heavy(rows: DataFrame, least: int, block_tokens: int) -> Heavy:
    """The words with at least `least` occurrences: at most a dozen for each bucket, 16 bytes each on the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def block(parts: list) -> pa.RecordBatch:
            code, learnt = words.joined(parts)
            code, group = np.unique(code, return_inverse=True)
            columns = [code.view(np.int64), np.bincount(group), np.bincount(group, weights=learnt).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", "times", "learnt"])

        for word, _, text, part in _tokens(batches):
            parts.append([word, ~part["held_out"].to_numpy()[text]])
            size += len(word)
            if size >= block_tokens:
                yield block(parts)
                parts, size = [], 0
        if parts:
            yield block(parts)
        del parts
        words.release()

    counts = in_tasks(rows, counted, "code long, times long, learnt long").groupBy("code")
    counts = counts.agg(F.sum("times").alias("times"), F.sum("learnt").alias("learnt"))
    found = counts.where((F.col("times") >= least) | (F.col("code") == int(END))).toPandas()
    codes = found["code"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(codes)
    if not len(codes):
        return Heavy(np.array([END]), np.array([0]))
    return Heavy(codes[order], found["learnt"].to_numpy().astype(np.int64)[order])


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, block_tokens: int, heavy: Heavy) -> Iterator[pa.RecordBatch]:
    """Of each block: its texts, and for each bucket the pairs whose word is in it, with how often each text has them."""
    task, block, parts, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
    for word, before, text, part in _tokens(batches):
        first = sum(len(t[0]) for t in texts)
        held, ids = part["held_out"].to_numpy(), part["doc_id"]
        texts.append([ids.fillna(0).to_numpy(np.int64), ids.notna().to_numpy(np.uint8), held.astype(np.uint8), np.bincount(text, minlength=len(part))])
        parts.append([word, before, ((text + first).astype(np.uint32) << np.uint32(1)) | ~held[text]])
        size += len(word)
        if size >= block_tokens:
            yield _block(parts, texts, (task << 24) + block, buckets, heavy)
            block, parts, texts, size = block + 1, [], [], 0
            words.release()
    if texts:
        yield _block(parts, texts, (task << 24) + block, buckets, heavy)
    del parts, texts
    words.release()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]]:
    """Slice by slice: each token, the one before it, the text it is in, and the texts' rows; each text ends with an end."""
    blank = words.byte_set(words.BLANKS)
    for batch in batches:
        for part in words.slices(batch):
            found = words.Words(part.column("text"), blank, 0x20)
            count = np.bincount(found.text, minlength=part.num_rows)
            text = np.repeat(np.arange(part.num_rows), count + 1)
            word = np.full(len(text), END)
            word[np.arange(len(found.code)) + found.text] = np.where(found.code <= END, found.code + np.uint64(2), found.code)
            before = np.concatenate([[START], word[:-1]]).astype(np.uint64)
            before[before == END] = START
            rows = part.select(["doc_id", "held_out"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            yield word, before, text, rows


def _block(parts: list, texts: list, block: int, buckets: int, heavy: Heavy) -> pa.RecordBatch:
    word, before, text = words.joined(parts)
    bucket = _bucket_of(np.where(heavy.find(word)[0], words.mixed(word ^ words.mixed(before)), word), buckets).astype(np.int32)
    order = np.lexsort((text, before, word, bucket))
    word, before, text = word[order], before[order], text[order]
    at = words.run_starts(bucket[order], word, before, text)
    times = np.diff(at, append=len(word)).astype(np.uint32)
    bucket, word, before, text = bucket[order][at], word[at], before[at], text[at]
    # The texts are a group of their own, of a bucket that no code falls in.
    rows = [("texts", -1 - block, block, words.packed(*words.joined(texts)))]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for to in range(buckets):
        part = slice(edges[to], edges[to + 1])
        if part.start < part.stop:
            runs = words.run_starts(word[part])
            lengths = np.diff(runs, append=part.stop - part.start).astype(np.uint32)
            rows.append(("pairs", to, block, words.packed(word[part][runs], lengths, before[part], text[part], times[part])))
    return pa.RecordBatch.from_pandas(_packed_rows(rows), preserve_index=False)


def _packed_rows(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "block", "data"]).astype({"bucket": "int64", "block": "int64"})


def _released(frame: pd.DataFrame) -> pd.DataFrame:
    words.release()
    return frame


def _sums(groups: np.ndarray, count: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=count)


def _bucket(frame: pd.DataFrame, buckets: int, heavy: Heavy) -> pd.DataFrame:
    """Of all pairs whose word is in the bucket: what they add to each text and to each history, and the counts of counts."""
    if frame["kind"].iloc[0] == "texts":
        return frame[["kind", "bucket", "block", "data"]]
    blocks, parts = frame["block"].to_numpy(), []
    for place, value in enumerate(frame["data"]):
        word, lengths, before, text, times = words.unpacked(value)
        parts.append([np.repeat(word, lengths), before, text, times, np.full(len(before), place, dtype=np.int32)])
    word, before, text, times, place = words.joined(parts)
    del parts
    order = np.lexsort((before, word))
    word, before, text, times, place = word[order], before[order], text[order], times[order], place[order]
    learnt = (text & np.uint32(1)).astype(np.int64)
    at = words.run_starts(word, before)
    pair_count = np.add.reduceat(times * learnt, at)
    pair_word, pair_before = word[at], before[at]
    word_at = words.run_starts(pair_word)
    is_heavy, place_of = heavy.find(pair_word[word_at])
    learnt_here = np.add.reduceat(pair_count, word_at)
    word_count = np.where(is_heavy, heavy.learnt[place_of], learnt_here)
    count_of_pairs_word = np.repeat(word_count, np.diff(word_at, append=len(at)))
    lengths = np.diff(at, append=len(word))
    counts_of_counts = np.bincount(np.minimum(pair_count, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
    stats = np.array([learnt_here.sum(), ((word_count > 0) & ~is_heavy).sum(), *counts_of_counts], dtype=np.int64)
    rows = [("stats", 0, 0, words.packed(stats))]
    rows += _text_sums(blocks, place, text, times, np.repeat(pair_count, lengths), np.repeat(count_of_pairs_word, lengths), word)
    rows += _histories(pair_before, pair_count, count_of_pairs_word, buckets, heavy)
    unseen = np.flatnonzero(np.repeat(pair_count, lengths) == 0)
    history, block = before[unseen], blocks[place[unseen]]
    columns = [history, block, text[unseen] >> np.uint32(1), times[unseen]]
    light = ~(heavy.find(history)[0] | (history == START))
    rows += _dealt("unseen", np.where(light, history, words.mixed(block.astype(np.uint64))), columns, buckets)
    return _packed_rows(rows)


def _text_sums(blocks, place, text, times, pair_count, word_count, word) -> list:
    """Per text of each block: score without discounts and backoff weights, base score, unseen pairs, known words, pairs of each small count."""
    text = text >> np.uint32(1)
    keys, group = np.unique(place.astype(np.uint64) << np.uint64(32) | text, return_inverse=True)
    unigram = times * np.log10(2.0 * word_count + 1)
    seen = pair_count > 0
    history = np.where((word != END) & (word_count > 0), times * np.log10(np.maximum(word_count, 1)), 0.0)
    # Half an occurrence is off a large count; what is off a small one comes later.
    kept = np.where(pair_count > CUT, pair_count - 0.5, np.maximum(pair_count, 1))
    score = np.where(seen, times * np.log10(kept), unigram) - history
    columns = [_sums(group, len(keys), score), _sums(group, len(keys), unigram)]
    whole = [~seen, word_count > 0, *(pair_count == r for r in range(1, CUT + 1))]
    columns += [_sums(group, len(keys), times * mask).astype(np.uint32) for mask in whole]
    found, edges = [], np.searchsorted(keys >> np.uint64(32), np.arange(len(blocks) + 1))
    for i, block in enumerate(blocks.tolist()):
        part = slice(edges[i], edges[i + 1])
        found.append(("sums", 0, block, words.packed((keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32), *(c[part] for c in columns))))
    return found


def _histories(before: np.ndarray, count: np.ndarray, word_count: np.ndarray, buckets: int, heavy: Heavy) -> list:
    """Per history: how many words follow, how often these occur at all, and how many follow once, twice, ..."""
    seen = np.flatnonzero(count > 0)
    seen = seen[np.argsort(before[seen], kind="stable")]
    before, count, word_count = before[seen], count[seen], word_count[seen]
    if not len(before):
        return []
    at = words.run_starts(before)
    columns = [np.ones_like(count), word_count, *((count == r).astype(np.int64) for r in range(1, CUT + 1))]
    columns = [before[at], *(np.add.reduceat(c, at) for c in columns)]
    apart = heavy.find(before[at])[0] | (before[at] == START)
    found = _dealt("follow", before[at][~apart], [c[~apart] for c in columns], buckets)
    return [*found, ("heavy", 0, 0, words.packed(*(c[apart] for c in columns)))]


def _dealt(kind: str, codes: np.ndarray, columns: list, buckets: int) -> list:
    """The rows of codes to the buckets of these."""
    if not len(codes):
        return []
    of = _bucket_of(codes, buckets)
    order = np.argsort(of, kind="stable")
    of, columns = of[order], [c[order] for c in columns]
    at = words.run_starts(of)
    ends = np.append(at[1:], len(of))
    return [(kind, int(of[a]), 0, words.packed(*(c[a:b] for c in columns))) for a, b in zip(at, ends, strict=True)]


def _stats(summed: DataFrame, heavy: Heavy) -> dict:
    """Tokens, words, texts learnt from, the discount of each small count, and the sums of the heavy histories."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, value in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                arrays = words.unpacked(value) if kind == "heavy" else [np.zeros(1, np.uint64), *words.unpacked(value)[0][:, None]]
                columns = [arrays[0].view(np.int64), *arrays[1:]]
                columns += [np.zeros(len(columns[0]), np.int64)] * (1 + len(names) - len(columns))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", *names])

    names = [f"s{i}" for i in range(CUT + 3)]
    parts = in_tasks(summed.where("kind IN ('stats', 'heavy')").select("kind", "data"), spread, "code long, " + ", ".join(f"{n} long" for n in names))
    # A row for each heavy history, and one, of no code, for the counts of the whole.
    found = {row[0]: row[1:] for row in parts.groupBy("code").agg(*[F.sum(name) for name in names]).collect()}
    tokens, vocabulary, *n = found.pop(0, [0] * len(names))
    vocabulary += int((heavy.learnt > 0).sum())
    stats = {"tokens": tokens, "texts": int(heavy.learnt[heavy.codes == END][0]), "unit": 2 * tokens + vocabulary + 1, "discounts": discounts(n)}
    codes = np.array(sorted(found), dtype=np.int64)
    follow, word_count, *by_count = np.array([found[c][: 2 + CUT] for c in codes.tolist()], dtype=np.int64).reshape(-1, 2 + CUT).T
    return stats | {"heavy": (codes.view(np.uint64), _weights(follow, word_count, by_count, stats))}


def discounts(counts_of_counts: list[int]) -> list[float]:
    """d(1) to d(CUT) by Katz from n(1) to n(CUT + 1); where these are too irregular for a value in (0, 1), half an occurrence."""
    n, found = [0, *counts_of_counts], []
    for r in range(1, CUT + 1):
        fallback = (r - 0.5) / r
        if not n[1] or not n[r]:
            found.append(fallback)
            continue
        common = (CUT + 1) * n[CUT + 1] / n[1]
        turing = (r + 1) * n[r + 1] / (r * n[r])
        value = (turing - common) / (1 - common) if common != 1 else fallback
        found.append(value if 0 < value < 1 else fallback)
    return found


def _backoffs(frame: pd.DataFrame, stats: dict) -> pd.DataFrame:
    """For each text and pair never seen whose history is in the bucket: the history's backoff weight times its count."""
    kinds = {kind: [words.unpacked(v) for v in part["data"]] for kind, part in frame.groupby("kind")}
    if "unseen" not in kinds:
        return _packed_rows([])
    before, block, text, times = words.joined(kinds["unseen"])
    value = _found(before, *stats["heavy"])
    if "follow" in kinds:
        history, *columns = words.joined(kinds["follow"])
        order = np.argsort(history, kind="stable")
        history = history[order]
        at = words.run_starts(history)
        follow, word_count, *by_count = [np.add.reduceat(c[order], at) for c in columns]
        value += _found(before, history[at], _weights(follow, word_count, by_count, stats))
    keys, group = np.unique(np.stack([block, text.astype(np.int64)]), axis=1, return_inverse=True)
    fixed = _sums(group.ravel(), keys.shape[1], times * value)
    at = words.run_starts(keys[0])
    ends = np.append(at[1:], keys.shape[1])
    return _packed_rows(
        [("fix", 0, int(keys[0][a]), words.packed(keys[1][a:b].astype(np.uint32), fixed[a:b])) for a, b in zip(at, ends, strict=True)]
    )


def _found(codes: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each code, 0 of one that isn't known."""
    if not len(known):
        return np.zeros(len(codes))
    order = np.argsort(known)
    place = order[np.minimum(np.searchsorted(known, codes, sorter=order), len(known) - 1)]
    return np.where(known[place] == codes, values[place], 0.0)


def _weights(follow: np.ndarray, word_count: np.ndarray, by_count: list[np.ndarray], stats: dict) -> np.ndarray:
    """log10 of a history's backoff weight times its count.

    The discounts take that many occurrences off the words that follow it; they are shared out over the unigram
    probability of all others, which is a whole number over `unit`.
    """
    small = sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(by_count, stats["discounts"], strict=True), 1))
    left = small + 0.5 * (follow - sum(by_count))
    return np.log10(left / ((stats["unit"] - (2 * word_count + follow)) / stats["unit"]))


def _scores(frame: pd.DataFrame, stats: dict) -> pd.DataFrame:
    """The rows of one block."""
    kinds = {kind: [words.unpacked(v) for v in part["data"]] for kind, part in frame.groupby("kind")}
    ids, known_id, held, n_tokens = words.joined(kinds["texts"])
    totals = np.zeros((4 + CUT, len(ids)))
    for text, *columns in kinds["sums"]:
        for total, column in zip(totals, columns, strict=True):
            total[text] += column
    score, base, unseen, known, *by_count = totals
    for text, value in kinds.get("fix", []):
        score[text] += value
    unit = math.log10(stats["unit"])
    score = score - unseen * unit + sum(n * math.log10(d) for n, d in zip(by_count, stats["discounts"], strict=True))
    # The first token's history is the start, seen once for each text; if there were none, nothing was subtracted either.
    started = math.log10(stats["texts"]) if stats["texts"] else 0.0
    return pd.DataFrame(
        {
            "doc_id": pd.arrays.IntegerArray(ids.copy(), known_id == 0),
            "held_out": held.astype(bool),
            "n_tokens": n_tokens.astype(np.int64),
            "n_known": known.astype(np.int64),
            "train_tokens": np.full(len(ids), stats["tokens"]),
            "base_score": base - n_tokens * unit,
            "score": score - started,
        }
    )
