"""Words of whole texts as 64-bit codes, a slice of texts at a time, and arrays packed for a shuffle.

A code is a polynomial of a word's bytes over random 64-bit values, mixed by a bijection. Two different words of a
vocabulary of V share one with a probability of about V * V / 2^65: 3e-6 for ten million words.
"""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SLICE_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)

BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def byte_set(members: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(members)] = True
    return found


def mixed(codes: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every other."""
    codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def _powers_to(count: int) -> np.ndarray:
    global _powers
    if len(_powers) < count:
        steps = np.full(max(count, 1 << 12), _MULTIPLIER)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Words:
    """The words of a slice of texts: `text` (place in the slice), `code`, `start` and `end` in `data`, in order."""

    def __init__(self, texts: pa.Array, blank: np.ndarray, between: int):
        """`blank` bytes separate words; `between`, one of them, is put after each text. A NULL text is empty."""
        plain = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
        raw = plain.buffers()[2]
        body = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = _LOWER[np.insert(body, offsets[1:] - offsets[0], between)]
        self.text_ends = offsets[1:] - offsets[0] + np.arange(1, len(plain) + 1)
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = ~blank[self.data]
        edges = np.flatnonzero(np.diff(inside))
        self.start, self.end = edges[::2], edges[1::2]
        self.text = np.searchsorted(self.text_ends, self.start, side="right")
        self.code = self._codes(blank)

    def _codes(self, blank: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        first = self.start[0]
        place = np.arange(first, len(self.data)) - np.repeat(self.start, np.diff(self.start, append=len(self.data)))
        values = np.where(blank, np.uint64(0), _VALUES)[self.data[first:]] * _powers_to(int(place.max()) + 1)[place]
        return mixed(np.add.reduceat(values, self.start - first))

    def word(self, place: int) -> str:
        return self.data[self.start[place] : self.end[place]].tobytes().decode("utf-8", "replace")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of the batch with about SLICE_BYTES of text each, a longer text by itself."""
    sizes = np.asarray(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, size = 0, 0
    for row, length in enumerate(sizes.tolist()):
        if size and size + length > SLICE_BYTES:
            yield batch.slice(first, row - first)
            first, size = row, 0
        size += length + 1
    if first < batch.num_rows:
        yield batch.slice(first)


def release() -> None:
    """Give memory that freed arrays leave behind back to the system: a Python worker lives on beside the next one's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. Of four-byte numbers, mostly small ones, all first bytes come first, then all second ones."""
    head = np.array([len(arrays), *(value for a in arrays for value in (ord(a.dtype.char), len(a)))], dtype=np.int64)
    plain = [np.ascontiguousarray(a) for a in arrays]
    plain = [a.view(np.uint8).reshape(-1, 4).T if a.itemsize == 4 else a for a in plain]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(a.tobytes() for a in plain)]))


def unpacked(value: bytes) -> list[np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress(value)
    count = int(np.frombuffer(plain, np.int64, 1)[0])
    head, at, found = np.frombuffer(plain, np.int64, 2 * count, 8).reshape(-1, 2), 8 + 16 * count, []
    for code, length in head.tolist():
        kind = np.dtype(chr(code))
        if kind.itemsize == 4:
            array = np.ascontiguousarray(np.frombuffer(plain, np.uint8, 4 * length, at).reshape(4, -1).T).view(kind).ravel()
        else:
            array = np.frombuffer(plain, kind, length, at)
        found.append(array)
        at += kind.itemsize * length
    return found


def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Array by array, the parts one after the other."""
    return [np.concatenate(column) for column in zip(*parts, strict=True)]


def run_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns sorted together; the first row always does."""
    if not len(sorted_columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(sorted_columns[0]), dtype=bool)
    new[0] = True
    for column in sorted_columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def text_bytes(documents) -> int:
    """Bytes of all texts: what the number of buckets follows."""
    from pyspark.sql import functions as F

    return documents.select(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
