"""Token counts of a byte-level byte-pair vocabulary, without producing tokens.

Every pre-token starts as one symbol per byte. A heap holds the adjacent pairs that the vocabulary
merges, by rank and place; a linked list holds the symbols that are left. Popping the least pair and
merging it until none is left, the count is the symbols at first less the merges.

A text is cut at single blanks between visible characters, where pre-tokens always begin, and the
counts of the parts are remembered. Special strings count as one token each.
"""

import heapq
import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.llm.tables import in_tasks, texts

PARTS_KEPT = 700_000
LIMIT = 512

#: a blank between two characters that are certainly no white space
_CUT = re.compile("(?<=[!-~¡-ᙿ]) (?=[!-~¡-ᙿ])")


def _symbols() -> list[str]:
    """The vocabulary's character for each byte: visible Latin-1 as it is, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols undergo: always the pair of least rank, the leftmost of equals."""
    n = len(symbols)
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i))
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    done = 0
    while heap:
        rank, i = heapq.heappop(heap)
        left, j = symbols[i], after[i]
        if left is None or j >= n or ranks.get((left, symbols[j])) != rank:
            continue
        whole = symbols[i] = left + symbols[j]
        symbols[j] = None
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((whole, symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i))
        k = before[i]
        if k >= 0:
            rank = ranks.get((symbols[k], whole))
            if rank is not None:
                heapq.heappush(heap, (rank, k))
    return done


class Counter:
    """Counts tokens of texts with the vocabulary of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in parts["model"]["merges"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(pairs)}
        special = [token["content"] for token in parts["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pre_tokens = regex.compile(public_tokenizers.PATTERN)
        self.symbols = _symbols()
        self.of_words: dict[str, int] = {}
        self.of_parts: tuple[dict[str, int], dict[str, int]] = ({}, {})

    def _word(self, word: str) -> int:
        found = self.of_words.get(word)
        if found is None:
            if len(self.of_words) >= PARTS_KEPT:
                self.of_words.clear()
            raw = word.encode()
            found = len(raw) - merges([self.symbols[b] for b in raw], self.ranks)
            if len(word) <= 40:
                self.of_words[word] = found
        return found

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        parts = _CUT.split(text)
        total = 0
        for blank, some in (("", parts[:1]), (" ", parts[1:])):
            known = self.of_parts[bool(blank)]
            try:
                total += sum(map(known.__getitem__, some))
                continue
            except KeyError:
                pass
            if len(known) >= PARTS_KEPT:
                known.clear()
            for part in some:
                count = known.get(part)
                if count is None:
                    count = sum(map(self._word, self.pre_tokens.findall(blank + part)))
                    if len(part) <= 60:
                        known[part] = count
                total += count
        return total

    def count(self, text: str) -> int:
        if self.special is None or not (found := self.special.findall(text)):
            return self._plain(text)
        return len(found) + sum(map(self._plain, self.special.split(text)))


_counters: dict[str, Counter] = {}


def _count(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            rows = [(doc_id, len(text), counter.count(text.decode())) for text, doc_id in texts(batch, "doc_id")]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def token_counts(documents: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of `documents`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library without special tokens added; special strings inside
    a text are one token each. A NULL or empty text has no bytes and no tokens. Texts are read whole.
    Rows without doc_id and repeated rows are counted like others; other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    counted = in_tasks(documents.select("doc_id", "text"), _count(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
