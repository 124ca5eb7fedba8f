"""Phrases of up to LONGEST words that occur together more than their parts do, from sorted streams of counts.

Every word of a text opens a window of the next words of its piece. Windows are sorted by their words from the left
and cut into ranges of that order, so a range is a stretch of the stream of counts in prefix order: the windows that
begin with a phrase stand together, and one pass over the runs counts the phrases of every length at once. A run that goes
on in the next range is counted in both and added up. The counts that reach the minimum are then kept twice, in prefix and in
suffix order; a phrase's left parts are met in the first and its right parts in the second by merge joins, and so are
the phrases that it extends.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pursebook.llm import words
from pursebook.llm.tables import in_tasks, stored

LONGEST = 4
BLOCK_TOKENS = 1 << 19
RANGE_BYTES = 1 << 22
VOCABULARY = 1 << 18
NONE = np.uint64(0)
_BREAKS = words.byte_set(b".,;:!?" + bytes(range(0x0A, 0x0E)))
_BLANKS = words.byte_set(b"\x20\x09") | _BREAKS


def collocations(
    documents: DataFrame,
    least: int = 30,
    top: int = 2000,
    covered_percent: int = 80,
    scale: int = 2_000_000,
    range_bytes: int = RANGE_BYTES,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to LONGEST words with a >= `least`.

    a is how often a phrase occurs, l and r how often the two parts do that give it its lowest score (equal ones: the
    shorter left part), n the words of the language. A phrase inside a longer one that occurs at least `covered_percent` of
    a times is left out. Of equal scores the larger a, then the lesser phrase in UTF-8 goes first. A NULL lang is `und`;
    NULL and empty texts have no words; repeated rows count each, doc_id and other columns are passed over. Without
    candidates there are no rows. Words are told apart by 64-bit codes within their language. A task holds some millions of windows,
    or those of one text if that is longer; equal windows are one in each block, so a hot phrase is no load.
    """
    rows = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    found = stored(in_tasks(rows, _vocabulary, "lang string, code long, word string, times long"), "words")
    known = found.groupBy("lang", "code").agg(F.min("word").alias("word"), F.sum("times").alias("f"))
    totals = found.groupBy("lang").agg(F.sum("times").alias("n"))
    frequent = stored(known.where(F.col("f") >= least), "frequent")
    prefix = stored(_counts(rows, frequent, least, range_bytes, block_tokens), "prefix-order")
    return _ranked(_scored(prefix, scale, covered_percent), frequent, totals, top)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[words.Words, np.ndarray, np.ndarray]]:
    """Of each slice: its words, their codes within their language, and where the language of each text stands."""
    for batch in batches:
        for part in words.slices(batch):
            found = words.Words(part.column("text"), _BLANKS, 0x0A)
            langs = part.column("lang").to_pandas()
            seeds = {lang: words.Words(pa.array([lang.encode().hex()]), _BLANKS, 0x0A).code for lang in langs.unique()}
            seed = np.array([seeds[lang][0] if len(seeds[lang]) else 1 for lang in langs], dtype=np.uint64)
            codes = words.mixed(found.code ^ seed[found.text])
            codes[codes == NONE] = 1
            yield found, codes, langs.to_numpy()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each block with their counts."""
    words_of: dict[int, tuple[str, str]] = {}
    codes, counts, size = [], [], 0

    def block(codes: list, counts: list) -> pa.RecordBatch:
        code, group = np.unique(np.concatenate(codes), return_inverse=True)
        times = np.bincount(group, weights=np.concatenate(counts)).astype(np.int64)
        names = [words_of[c] for c in code.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([n[0] for n in names], pa.string()), pa.array(code.view(np.int64)), pa.array([n[1] for n in names], pa.string()), pa.array(times)],
            ["lang", "code", "word", "times"],
        )

    for found, code, langs in _found(batches):
        unique, first, times = np.unique(code, return_index=True, return_counts=True)
        for c, place in zip(unique.tolist(), first.tolist(), strict=True):
            if c not in words_of:
                words_of[c] = langs[found.text[place]], found.word(place)
        codes.append(unique)
        counts.append(times)
        size += len(unique)
        if size >= VOCABULARY:
            yield block(codes, counts)
            words_of.clear()
            codes, counts, size = [], [], 0
            words.release()
    if size:
        yield block(codes, counts)
        words_of.clear()
    del codes, counts
    words.release()


def _windows(found: words.Words, codes: np.ndarray) -> list[np.ndarray]:
    """Of each word that another one of its piece follows: the codes of the next LONGEST words, NONE beyond the piece."""
    piece = np.searchsorted(np.flatnonzero(_BREAKS[found.data]), found.start)
    columns = [codes]
    for step in range(1, LONGEST):
        later = np.zeros_like(codes)
        later[:-step] = np.where(piece[step:] == piece[:-step], codes[step:], NONE)
        columns.append(later)
    kept = columns[1] != NONE
    return [column[kept] for column in columns]


def _sorted_windows(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Windows (w1, w2, ..., times) in prefix order, equal ones as one."""
    *columns, times = words.joined(parts)
    order = np.lexsort(columns[::-1])
    columns = [column[order] for column in columns]
    at = words.run_starts(*columns)
    return [*(column[at] for column in columns), np.add.reduceat(times[order], at) if len(at) else times]


def _window_blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[list[np.ndarray]]:
    parts, size = [], 0
    for found, codes, _ in _found(batches):
        columns = _windows(found, codes)
        parts.append([*columns, np.ones(len(columns[0]), dtype=np.int64)])
        size += len(columns[0])
        if size >= block_tokens:
            yield _sorted_windows(parts)
            parts, size = [], 0
            words.release()
    if size:
        yield _sorted_windows(parts)
    del parts
    words.release()


def _counts(rows: DataFrame, frequent: DataFrame, least: int, range_bytes: int, block_tokens: int) -> DataFrame:
    """(w, f): the codes of each phrase with at least `least` occurrences, of one word and more."""
    ranges = max(4, math.ceil(words.text_bytes(rows) / range_bytes))
    borders = _borders(rows, ranges, max(1, range_bytes >> 8))
    dealt = in_tasks(rows, lambda batches: _to_ranges(batches, borders, block_tokens), "range long, data binary")
    runs = dealt.groupBy("range").applyInPandas(lambda frame: _runs(frame, least), "w array<long>, f long")
    longer = runs.groupBy("w").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return frequent.select(F.array("code").alias("w"), "f").unionByName(longer)


def _borders(rows: DataFrame, ranges: int, step: int) -> np.ndarray:
    """Windows that cut the prefix order into ranges, at equal places of a sample: one of `step` windows of a slice of texts.

    Only the borders depend on it, no count does. The driver gets 32 bytes for each hundred kilobytes of text.
    """

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, codes, _ in _found(batches):
            drawn = [pa.array(c[step // 2 :: step].view(np.int64)) for c in _windows(found, codes)]
            yield pa.RecordBatch.from_arrays(drawn, [f"w{i}" for i in range(LONGEST)])

    schema = ", ".join(f"w{i} long" for i in range(LONGEST))
    found = in_tasks(rows, sampled, schema).toPandas()
    columns = [found[f"w{i}"].to_numpy().astype(np.int64).view(np.uint64) for i in range(LONGEST)]
    places = np.unique(len(found) * np.arange(1, ranges) // ranges) if len(found) else np.zeros(0, dtype=np.int64)
    order = np.lexsort(columns[::-1])
    return np.stack([column[order][places] for column in columns])


def _to_ranges(batches: Iterator[pa.RecordBatch], borders: np.ndarray, block_tokens: int) -> Iterator[pa.RecordBatch]:
    for columns in _window_blocks(batches, block_tokens):
        # Where each border stands among the sorted windows: narrowed column by column.
        cuts = [_place(columns[:LONGEST], border) for border in borders.T]
        edges = [0, *cuts, len(columns[0])]
        rows = [(i, slice(a, b)) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        data = [words.packed(*(c[part] for c in columns)) for _, part in rows]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(data, pa.binary())], ["range", "data"])


def _place(columns: list[np.ndarray], window: np.ndarray) -> int:
    low, high = 0, len(columns[0])
    for column, value in zip(columns, window, strict=True):
        low, high = (low + np.searchsorted(column[low:high], value, side) for side in ("left", "right"))
    return int(low)


def _runs(frame: pd.DataFrame, least: int) -> pd.DataFrame:
    """The phrases of 2 words and more of one range, whose runs are long enough or touch its ends."""
    *columns, times = _sorted_windows([words.unpacked(value) for value in frame["data"]])
    phrases, counts = [], []
    for length in range(2, LONGEST + 1):
        at = words.run_starts(*columns[:length])
        f = np.add.reduceat(times, at)
        wanted = f >= least
        wanted[[0, -1]] = True
        wanted &= columns[length - 1][at] != NONE
        phrases += np.stack([c[at[wanted]].view(np.int64) for c in columns[:length]], axis=1).tolist()
        counts.append(f[wanted])
    del columns, times
    words.release()
    return pd.DataFrame({"w": pd.Series(phrases, dtype=object), "f": np.concatenate(counts)})


def _scored(prefix: DataFrame, scale: int, covered_percent: int) -> DataFrame:
    """(w, a, l, r, score) of the phrases that no longer one covers: merge joins of the count stream in its two orders."""
    size = F.size("w")
    phrases = prefix.where(size > 1).withColumnRenamed("f", "a")
    cuts = phrases.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = cuts.select(
        "w", "a", "k",
        F.slice("w", 1, F.col("k")).alias("_left"),
        F.reverse(F.slice("w", F.col("k") + 1, size - F.col("k"))).alias("_right"),
    )
    lefts = prefix.select(F.col("w").alias("_left"), F.col("f").alias("l"))
    suffix = prefix.select(F.reverse("w").alias("_right"), F.col("f").alias("r"))
    both = parts.join(lefts.hint("merge"), "_left").join(suffix.hint("merge"), "_right")
    score = F.expr(f"CAST((CAST(a AS DECIMAL(30,0)) * {scale}) DIV (l + r) AS BIGINT)")
    lowest = both.withColumn("score", score).groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    starts = F.sequence(F.lit(1), size - F.col("_length") + 1)
    covered = (
        phrases.where(size > 2)
        .select("w", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("_length"))
        .select(F.explode(F.transform(starts, lambda at: F.slice("w", at, F.col("_length")))).alias("w"), F.col("a").alias("_longer"))
        .groupBy("w")
        .agg(F.max("_longer").alias("_longer"))
    )
    within = F.col("_longer").cast("decimal(30,0)") * 100 >= F.col("a").cast("decimal(30,0)") * covered_percent
    kept = lowest.join(covered.hint("merge"), "w", "left").where(~F.coalesce(within, F.lit(False)))
    return kept.select("w", "a", "cut.l", "cut.r", "cut.score")


def _ranked(scored: DataFrame, frequent: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language, with their words."""
    spelled = (
        scored.select("*", F.posexplode("w").alias("_at", "code"))
        .join(frequent.select("code", "lang", "word"), "code")
        .groupBy("w", "a", "l", "r", "score", "lang")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_words"))
        .withColumn("phrase", F.array_join(F.col("_words.word"), " "))
    )
    first = _first_of_each(spelled.select("lang", "phrase", "a", "l", "r", "score"), top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first_of_each(phrases: DataFrame, top: int) -> DataFrame:
    """Ranked in two steps, so that no task sorts a whole language: a slice's first ones, then theirs."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    part = Window.partitionBy("lang", "_share").orderBy(*order)
    few = phrases.withColumn("_share", share).withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return few.withColumn("rank", rank).where(F.col("rank") <= top)
