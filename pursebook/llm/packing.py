"""Packing documents into token sequences by lexical retrieval over the corpus.

Texts become token ids once. A document longer than the window fills windows by itself; what remains
of each is retrieved for. How many remainders hold a term, and their mean length, are counted over
the whole corpus. The remainders are then range-sorted by the rarest of their shared terms, so that
likes from anywhere come to lie side by side, and cut into shards of bounded size: the layout of the
input decides nothing. A shard is a BM25 inverted index over its documents' tokens. Each remainder in
turn is a seed: the index ranks the unused ones by their likeness to it, and they fill the seed's
window from the best on, the last one cut where the window is full. What a shard can't fill goes on
to the next shard; what is left at the end of a partition is cut at powers of two, which need no
padding.
"""

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from pursebook.llm.tables import SLICE, in_tasks, stored

WINDOW = 2048
SHARD_TOKENS = 1 << 22
#: partitions of one shuffle at most; beyond, a partition is several shards, one after the other
MOST_PARTITIONS = 1 << 14
#: how many of a document's rarest shared terms it is sorted by
KEYS = 4
END_ID = 1
WORDS_KEPT = 200_000
K1, B = 1.2, 0.75

_LATIN = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+"
#: words of ASCII and Latin letters (U+00C0 to U+024F), and what lies between them and white space
_RUNS = re.compile(_LATIN + rb"|(?:(?!" + _LATIN + rb")[^\x20\x09-\x0d])+")
_RUNS_OF_ASCII = re.compile(rb"[a-z]+|[^a-z\x20\x09-\x0d]+")
_WORD = re.compile(_LATIN)
#: what may join such words to something else: other letters and marks, and U+0130, whose lower case ends in a mark
_JOINING = re.compile("[^\0-\xa9\xab-\xb4\xb6-\xb9\xbb-\u012f\u0131-\u024f]")
#: words that the library gets in one call
TOGETHER = 2000


class ChunkIds:
    """Token ids of text, by the tokenizers library, remembered by word.

    The vocabulary's pre-tokenizer drops white space and no token spans it, so a text's ids are those
    of its chunks one after the other. Only bytes that are white space to every engine separate chunks.
    In most texts nothing can join a run of Latin letters to what stands beside it, so there runs are
    looked up. Such words, lower-cased, are what normalizer and pre-tokenizer would make of them: the
    library's model gets many at once, separated by blanks, and the end of each shows in its last token.
    Anything else goes through the whole library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merging = Tokenizer.from_file(path)
        self.merging.normalizer = None
        by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merging.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_byte])
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        #: the words remembered before; those in use move on, the others go when `known` is full again
        self.before: dict[bytes, bytes] = {}

    def of(self, some: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without special tokens added."""
        parts = [self._parts(text) for text in some]
        ids = self._ids_of(set().union(*parts))
        return [np.frombuffer(b"".join(map(ids.__getitem__, part)), np.uint32) for part in parts]

    def _parts(self, text: bytes) -> list[bytes]:
        if b"'" in text or b"<|" in text:
            return text.split()
        if text.isascii():
            return _RUNS_OF_ASCII.findall(text.lower())
        letters = text.decode()
        return text.split() if _JOINING.search(letters) else _RUNS.findall(letters.lower().encode())

    def _ids_of(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        ids = {}
        words, others = [], []
        known, before = self.known, self.before
        for part in parts:
            found = known.get(part)
            if found is None:
                found = before.get(part)
                if found is None:
                    lower = part.isascii() or part.decode().islower()
                    (words if lower and _WORD.fullmatch(part) else others).append(part)
                    continue
                known[part] = found
            ids[part] = found
        new = dict(zip(words, self._by_model(words), strict=True)) | dict(zip(others, self._by_library(others), strict=True))
        known.update(new)
        if len(known) > WORDS_KEPT:
            self.known, self.before = {}, known
        return ids | new

    def _by_library(self, chunks: list[bytes]) -> Iterator[bytes]:
        for one in self.tokenizer.encode_batch_fast([chunk.decode() for chunk in chunks], add_special_tokens=False):
            yield np.array(one.ids, np.uint32).tobytes()

    def _by_model(self, words: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(words), TOGETHER):
            ids = np.array(self.merging.encode(b" ".join(words[at : at + TOGETHER]).decode(), add_special_tokens=False).ids, np.uint32)
            raw, start = ids.tobytes(), 0
            for end in ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist():
                yield raw[start:end]
                start = end


_chunk_ids: dict[str, ChunkIds] = {}


@dataclass
class Document:
    """A document's tokens and how many of them lie in sequences already."""

    doc_id: int | None
    ids: np.ndarray
    used: int = 0

    @property
    def left(self) -> int:
        return len(self.ids) - self.used

    def take(self, length: int) -> tuple["Document", int, int]:
        """A piece (document, start, length) of the tokens that come next."""
        start = self.used
        self.used += length
        return self, start, length


Piece = tuple[Document, int, int]


@dataclass
class Corpus:
    """What retrieval knows of all documents: how many there are, in how many each term is, and their mean length."""

    n: int
    holders: np.ndarray
    mean: float

    @property
    def idf(self) -> np.ndarray:
        """The weight of each term. One in more than half of the documents tells nothing and weighs nothing."""
        return np.maximum(np.log((self.n - self.holders + 0.5) / (self.holders + 0.5)), 0.0).astype(np.float32)


class Index:
    """BM25 over token ids: for each term the documents with it and their weights, in one array each.

    Weights follow the numbers of `corpus`; without it, those of the documents themselves.
    """

    def __init__(self, documents: list[Document], corpus: Corpus | None = None):
        self.terms = []
        counts = []
        for document in documents:
            terms, count = np.unique(document.ids[document.used :], return_counts=True)
            self.terms.append(terms)
            counts.append(count)
        n = len(documents)
        term = np.concatenate(self.terms)
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in self.terms])
        frequency = np.concatenate(counts).astype(np.float32)
        order = np.argsort(term, kind="stable")
        term, self.owner, frequency = term[order], owner[order], frequency[order]
        size = len(corpus.holders) if corpus else int(term[-1]) + 1 if len(term) else 0
        self.starts = np.searchsorted(term, np.arange(size + 1))
        holders = np.diff(self.starts)
        lengths = np.array([d.left for d in documents], np.float32)
        corpus = corpus or Corpus(n, holders, float(lengths.mean()))
        idf = corpus.idf
        norm = K1 * (1 - B + B * lengths / max(corpus.mean, 1.0))
        self.weights = idf[term] * frequency * (K1 + 1) / (frequency + norm[self.owner])
        self.useful = (idf > 0) & (holders > 1)
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """The score of each document for the seed's terms."""
        terms = self.terms[seed]
        terms = terms[self.useful[terms]]
        first, last = self.starts[terms], self.starts[terms + 1]
        sizes = last - first
        total = int(sizes.sum())
        if not total:
            return np.zeros(self.n)
        at = np.arange(total) + np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        return np.bincount(self.owner[at], self.weights[at], self.n)


def pack_shard(documents: list[Document], window: int, corpus: Corpus | None = None) -> Iterator[list[Piece]]:
    """Full windows, as lists of pieces; what can't fill one stays unused in the documents."""
    for document in documents:
        while document.left >= window:
            yield [document.take(window)]
    rest = [d for d in documents if d.left]
    unused = sum(d.left for d in rest)
    if unused < window:
        return
    index = Index(rest, corpus)
    open_ = np.ones(len(rest), bool)
    for seed, document in enumerate(rest):
        if not document.left:
            continue
        if unused < window:
            return
        room = window - document.left
        pieces = [document.take(document.left)]
        open_[seed] = False
        for other in _ranked(index.scores(seed), open_):
            if not room:
                break
            taken = min(room, rest[other].left)
            pieces.append(rest[other].take(taken))
            room -= taken
            open_[other] = rest[other].left > 0
        unused -= window
        yield pieces


def _ranked(scores: np.ndarray, open_: np.ndarray) -> Iterator[int]:
    """The unused documents, best first; equal scores in the shard's order."""
    candidates = np.flatnonzero(open_)
    score = scores[candidates]
    step = 32
    while len(candidates):
        if len(candidates) > step:
            top = np.argpartition(-score, step)[:step]
            kept = np.ones(len(candidates), bool)
            kept[top] = False
        else:
            top, kept = np.arange(len(candidates)), np.zeros(len(candidates), bool)
        top = top[np.lexsort((candidates[top], -score[top]))]
        yield from candidates[top]
        candidates, score, step = candidates[kept], score[kept], step * 4


def pack_rest(documents: list[Document], window: int) -> Iterator[list[Piece]]:
    """The last tokens, fewer than a window, in sequences whose lengths are powers of two."""
    total = sum(d.left for d in documents)
    waiting = iter([d for d in documents if d.left])
    current = next(waiting, None)
    size = window
    while total:
        while size > total:
            size //= 2
        room, pieces = size, []
        while room:
            taken = min(room, current.left)
            pieces.append(current.take(taken))
            room -= taken
            if not current.left:
                current = next(waiting, None)
        total -= size
        yield pieces


_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _rows(sequence_id: int, pieces: list[Piece]) -> Iterator[tuple]:
    offset = 0
    for document, start, length in pieces:
        ids = document.ids[start : start + length]
        yield document.doc_id, start, length, zlib.crc32(ids.tobytes()), len(document.ids), sequence_id, offset
        offset += length


def _chunk_ids_of(path: str) -> ChunkIds:
    return _chunk_ids.get(path) or _chunk_ids.setdefault(path, ChunkIds(path))


def _tokens(path: str, width: str, window: int, terms: int):
    """(doc_id, ids, n, holders): each document's ids with the end's, in numbers of the type `width`.

    A task's last row holds no document but, for each term, in how many of the task's remainders it is.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("holders", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids = _chunk_ids_of(path)
        holders = np.zeros(terms, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                some = [text or b"" for text in part.column("text").cast(pa.binary()).to_pylist()]
                made = [np.append(ids, np.uint32(END_ID)).astype(width) for ids in chunk_ids.of(some)]
                for ids in made:
                    holders[np.unique(ids[len(ids) // window * window :])] += 1
                columns = [part.column("doc_id"), pa.array([m.tobytes() for m in made], pa.binary()), pa.array(map(len, made), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(made), schema.field(3).type)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([None], [None], [None], [holders]), schema, strict=True)], schema=schema)

    return run


def _keyed(width: str, window: int, corpus: Corpus):
    """(doc_id, ids, k0, k1, ...): the rarest of a remainder's terms that it shares with another one, the rarest first."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())] + [(f"k{i}", pa.int64()) for i in range(KEYS)])
    #: terms by how many hold them; those that one document holds come last, as they lead to no other
    place = np.empty(len(corpus.holders), np.int64)
    place[np.lexsort((np.arange(len(place)), corpus.holders, corpus.holders < 2))] = np.arange(len(place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.full((batch.num_rows, KEYS), len(place), np.int64)
            for i, raw in enumerate(batch.column("ids")):
                ids = np.frombuffer(raw.as_py(), width)
                places = np.unique(place[ids[len(ids) // window * window :]])[:KEYS]
                keys[i, : len(places)] = places
            columns = [batch.column("doc_id"), batch.column("ids"), *(pa.array(keys[:, k]) for k in range(KEYS))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _pack(width: str, window: int, shard_tokens: int, corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        shard: list[Document] = []
        size = 0

        def packed(sequences: Iterator[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in sequences:
                rows.extend(_rows(sequence, pieces))
                sequence += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                shard.append(Document(doc_id, np.frombuffer(raw.as_py(), width).astype(np.uint32)))
                size += shard[-1].left
                if size >= shard_tokens:
                    yield packed(pack_shard(shard, window, corpus))
                    shard = [d for d in shard if d.left]
                    size = sum(d.left for d in shard)
        yield packed(pack_shard(shard, window, corpus))
        yield packed(pack_rest(shard, window))

    return run


def packed_sequences(
    documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and id 1 at the end; a NULL or empty text has the end
    alone. Each token lies in exactly one piece. `start` counts the document's ids before the piece,
    `offset` the sequence's. Every sequence has exactly `window` ids (a power of two), but for the
    last of each partition, whose lengths are smaller powers of two: nothing is padded. Rows that
    repeat a doc_id, or have none, are documents of their own. A task holds one shard of about
    `shard_tokens` ids, and at least one document. Shards follow the order of the documents' rarest
    shared terms, then doc_id, whatever the partitions of the input; equal scores go by the shard's
    order. An empty table gives no rows. Other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    terms = max(Tokenizer.from_file(path).get_vocab().values(), default=0) + END_ID + 1
    width = "<u2" if terms <= 1 << 16 else "<u4"
    schema = "doc_id long, ids binary, n long, holders array<long>"
    made = stored(in_tasks(documents.select(F.col("doc_id").cast("long"), "text"), _tokens(path, width, window, terms), schema), "tokens")
    tokens = made.where("n IS NOT NULL")
    left = F.col("n") % window
    total, n, mean = tokens.agg(F.sum("n"), F.count(F.when(left > 0, 1)), F.avg(F.when(left > 0, left))).first()
    #: one row per term of the vocabulary at most
    counted = made.select(F.posexplode("holders").alias("term", "count")).where("count > 0").groupBy("term").agg(F.sum("count"))
    holders = np.zeros(terms, np.int64)
    for term, count in counted.collect():
        holders[term] = count
    corpus = Corpus(n, holders, mean or 1.0)
    keys = [f"k{i}" for i in range(KEYS)]
    keyed = in_tasks(tokens.select("doc_id", "ids"), _keyed(width, window, corpus), "doc_id long, ids binary, " + ", ".join(f"{k} long" for k in keys))
    order = [*keys, "doc_id", F.xxhash64("ids")]
    partitions = min(-(-(total or 0) // shard_tokens), MOST_PARTITIONS)
    shards = keyed.repartitionByRange(max(partitions, 1), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    schema = ", ".join(f"{name} long" for name in _SCHEMA.names)
    return in_tasks(shards, _pack(width, window, shard_tokens, corpus), schema)
