"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's characters are symbols; an agenda holds the adjacent pairs that are pieces of the
vocabulary, by score and place, and the best is merged until none is left. Characters that are no
piece fall back to their bytes.

No piece of a merge-type vocabulary goes on with a word mark after other characters, so a merge
never crosses the start of a word, and the agenda runs word by word; ids of words are remembered.
Every word that is new to a task's worker is also encoded by the sentencepiece library, a batch at a
time; where the two differ the library's ids hold, and `n_differing` counts it.
"""

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from pursebook.llm.tables import SLICE, in_tasks

WORDS_KEPT = 500_000
PLACE_BITS = 32
LAST_PLACE = (1 << PLACE_BITS) - 1
NO_PIECE = math.inf
#: words up to this length have a flat agenda, where the least of a few numbers costs less than a heap; ids are the same
FLAT = 32
MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Encoder:
    """Encodes texts with the vocabulary of a sentencepiece model whose type is BPE."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        reserved = {i for i in range(n) if self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i)}
        kept = [i for i in range(n) if i not in reserved]
        self.ids = {self.library.id_to_piece(i): i for i in kept}
        #: a better score is a smaller number, so that the agenda's least entry is the best pair; room for a place below it
        scores = {i: self.library.get_score(i) for i in kept}
        ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.costs = {self.library.id_to_piece(i): ranks[scores[i]] << PLACE_BITS for i in kept}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("this vocabulary has pieces across words")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin = np.uint32([self.library.bos_id()]).tobytes()
        self.end = np.uint32([self.library.eos_id()]).tobytes()
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word, marks included."""
        symbols = self._merged_flat(word) if len(word) <= FLAT else self._merged(word)
        ids = list(map(self.ids.get, symbols))
        if None in ids:
            known = zip(symbols, ids, strict=True)
            ids = [part for symbol, found in known for part in ([self.bytes[b] for b in symbol.encode()] if found is None else [found])]
        return ids

    def _merged_flat(self, word: str) -> list[str]:
        """The symbols of a short word: the agenda is a list of the adjacent pairs' costs, in the order of places."""
        cost, symbols = self.costs.get, list(word)
        agenda = [cost(word[i : i + 2], NO_PIECE) for i in range(len(word) - 1)]
        while agenda and (best := min(agenda)) < NO_PIECE:
            i = agenda.index(best)
            pair = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = cost(pair + symbols[i + 1], NO_PIECE)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + pair, NO_PIECE)
        return symbols

    def _merged(self, word: str) -> list[str]:
        """The symbols of a word of any length: the agenda is a heap, the symbols a linked list."""
        cost, symbols = self.costs.get, list(word)
        n = len(symbols)
        #: an entry is a pair's cost and the place of its left symbol, in one integer
        agenda = [found + i for i in range(n - 1) if (found := cost(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & LAST_PLACE
            left, j = symbols[i], after[i]
            if left is None or j == n:
                continue
            pair = left + symbols[j]
            if cost(pair) != entry - i:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = cost(pair + symbols[k])
                if found is not None:
                    heapq.heappush(agenda, found + i)
            k = before[i]
            if k >= 0:
                found = cost(symbols[k] + pair)
                if found is not None:
                    heapq.heappush(agenda, found + k)
        return [symbol for symbol in symbols if symbol is not None]

    def encode(self, some: list[str]) -> tuple[list[bytes], int]:
        """The ids of each text as little-endian unsigned 32-bit integers, and how many new words differed from the library."""
        split = [_WORDS.findall(MARK + text.replace(" ", MARK)) if text else [] for text in some]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = set().union(*split)
        differing = 0
        words = list(new)
        #: the library puts a mark before the text by itself
        checked = self.library.encode([word[1:].replace(MARK, " ") for word in words], num_threads=1)
        for word, right in zip(words, checked, strict=True):
            own = self.word(word)
            #: a word that is a mark alone is what the library makes of no text
            if own != right and word != MARK:
                differing += 1
                own = right
            self.known[word] = pack(f"<{len(own)}I", *own)
        return [self.begin + b"".join(map(self.known.__getitem__, words)) + self.end for words in split], differing


_encoders: dict[str, Encoder] = {}


def _encode(path: str, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_differing", pa.int64())]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                some = [text or "" for text in part.column("text").to_pylist()]
                encoded, differing = encoder.encode(some)
                ids = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in encoded]
                decoded = [encoder.library.decode(one.tolist()) for one in ids]
                columns = [
                    part.column("doc_id"),
                    [len(one) for one in ids],
                    [hashlib.sha256(raw).hexdigest() for raw in encoded],
                    [hashlib.sha256(text.encode()).hexdigest() for text in decoded],
                    [differing, *[0] * (len(ids) - 1)],
                    *([ids, decoded] if with_ids else []),
                ]
                arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def encoded_pieces(documents: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of `documents`: doc_id, n_tokens, ids_sha256, decoded_sha256, n_differing; on demand ids and decoded.

    Ids carry the begin and end id; a NULL or empty text has these two alone and decodes to the empty
    text. `n_differing` is put on the first row of each few hundred. Texts are read whole. Rows
    without doc_id and repeated rows are encoded like others; an empty table gives no rows; other
    columns are not looked at.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differing long"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    return in_tasks(documents.select("doc_id", "text"), _encode(path, with_ids), schema)
