"""Array work on batches of texts: words and rolling hashes, computed over many documents at a time."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A value for each byte; any fixed random numbers do.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Texts are handled in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 18


Batches = Iterator[pa.RecordBatch]


def handed_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run (for mapInArrow) that gives memory back at a task's end: Spark keeps its workers, and they what was freed in them."""

    @wraps(run)
    def tidy(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)(0)

    return tidy


def _power(base: int, n: int) -> np.ndarray:
    """base**0, base**1 ... modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.ones(size, np.uint64)
            have[1:] = np.uint64(base)
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence of values, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * _power(_BASE, n), out=self.sums[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k values from each position that has as many."""
        n = len(self.sums) - k
        with np.errstate(over="ignore"):
            return mixed((self.sums[k : k + n] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets) of consecutive rows' UTF-8 bytes; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + run_bytes, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Numbers(dict):
    """Numbers of words, from 0 in the order of first use; ``held`` is about how many bytes this takes."""

    def __init__(self) -> None:
        super().__init__()
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 150
        self[word] = n = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


#: Words of up to so many bytes are hashed eight bytes at a time, for all words at once; longer ones by BLAKE2b.
LONG = 64
_SEEDS = np.array([0x2545F4914F6CDD1D, 0xD1342543DE82EF95], np.uint64)


def word_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """A row of two independent 64-bit hashes for each word.

    Each step is a bijection of eight bytes, so words of up to eight bytes and one length never clash; there is no sum
    over places, which made words of some patterns equal.
    """
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    with np.errstate(over="ignore"):
        h = mixed(_SEEDS[None, :] + size.astype(np.uint64)[:, None] * np.uint64(_BASE))
        for at in range(0, LONG, 8):
            some = np.flatnonzero(size > at)
            if not len(some):
                break
            inside = at + np.arange(8) < size[some][:, None]
            piece = np.where(inside, data[np.minimum(start[some][:, None] + at + np.arange(8), len(data) - 1)], 0).astype(np.uint8)
            lane = np.ascontiguousarray(piece).view("<u8").ravel()
            h[some, 0] = mixed(h[some, 0] ^ lane)
            h[some, 1] = mixed((h[some, 1] + lane) * _SEEDS[1])
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = np.frombuffer(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=16).digest(), "<u8")
    return h


class Words:
    """Words of a run of texts: two hashes of each, and ``offsets`` of each text's words.

    Splitting and telling words apart are Arrow's; only a run's different words are hashed.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)  # A to Z only; at blanks, and tab to carriage return
        found = parts.flatten().dictionary_encode()
        different = found.dictionary.cast(pa.large_binary())
        which = found.indices.to_numpy(zero_copy_only=False)
        edges = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        nothing = pc.index(different, pa.scalar(b"", pa.large_binary())).as_py()
        if nothing >= 0:  # what stands before a leading blank, or after a last one
            there = which != nothing
            edges = np.r_[0, np.cumsum(there)][edges]
            which = which[there]
        both = word_hashes(different)[which]
        self.offsets = edges.astype(np.int64)
        self.hash, self.other = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def shingles(words: Words, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of each text, ``offsets`` of each text's shingles) over one of the words' hashes.

    Fewer words than ``width`` make one shingle of them all, none make none.
    """
    rolling = Rolling(values)
    count = np.diff(words.offsets)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.r_[0, np.cumsum(n)]
    start = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - words.offsets[:-1], n)
    return rolling.of(start, np.minimum(start + width, np.repeat(words.offsets[1:], n))), offsets


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    grams, offsets = shingles(words, words.hash, width)
    return [np.unique(grams[at:to]) for at, to in zip(offsets[:-1], offsets[1:])]


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


#: Anchors only bring together what may be equal, so fewer bits of them do.
ANCHOR_BITS = 48
COUNT_BITS = 16


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of two 64-bit halves of a BLAKE2b digest for each stretch of data."""
    view, blake2b = memoryview(data), hashlib.blake2b
    return np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]), "<u8").reshape(-1, 2)


def segments(values: np.ndarray, offsets: np.ndarray, window: int, gram: int, data: bytes, size: int) -> dict[str, np.ndarray]:
    """Windows of ``window`` values grouped by the gram of least hash in them.

    A segment is a stretch of consecutive windows of one text with the same least gram, its anchor.  Equal windows
    have their anchor at the same place, wherever they are; so windows are equal only in segments of equal anchors.
    A segment's content is known by 96 bits of a BLAKE2b digest of it, from ``data`` (``size`` bytes a value).

    Returns arrays: text (index), start (of the first window), anchor, whole (64 bits of the digest), tail (32 more,
    and in the low COUNT_BITS the number of windows).
    """
    n = len(values)
    if n < window:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "anchor", "whole", "tail")}
    grams = Rolling(values).grams(gram)
    low = np.uint64((1 << max(22, n.bit_length())) - 1)
    least = minima((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    lengths = np.diff(offsets)
    room = np.maximum(0, lengths - window + 1)
    text = np.repeat(np.arange(len(lengths)), room)
    start = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(offsets[:-1], room)
    anchor_at = (least[start] & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, at = start[first], anchor_at[first]
    known = digests(data, begin * size, (begin + count + window - 1) * size)
    tail = (known[:, 1] >> np.uint64(32) << np.uint64(COUNT_BITS)).view(np.int64) | count
    return {"text": text[first], "start": begin - offsets[text[first]], "anchor": (grams[at] >> np.uint64(64 - ANCHOR_BITS)).view(np.int64), "whole": known[:, 0].view(np.int64), "tail": tail}
