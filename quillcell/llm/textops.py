"""Words and word hashes of Arrow text columns, whole batches at a time.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; only ``A-Z`` is lower-cased.
In UTF-8 no byte of a longer character is one of these, so bytes and characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 19
_powers: dict[str, np.ndarray] = {}

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, _SEGMENT + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows, which bounds what is laid out for them at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def by_bytes(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``size`` bytes of ``text``; a longer text is a run of its own."""
    _, offsets = buffers(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    offsets = offsets.astype(np.int64)
    start, end = (offsets[0], offsets[-1]) if len(offsets) else (0, 0)
    return data[start:end], offsets - start


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about half a megabyte that end at white space or between rows."""
    start, end = 0, len(data)
    while start < end:
        stop = min(end, start + _SEGMENT)
        while stop < end:
            row = offsets[np.searchsorted(offsets, stop, side="right") - 1]
            white = np.flatnonzero(_WHITE[data[start:stop]])
            best = max(int(row), start + int(white[-1]) + 1 if len(white) else start)
            if best > start:
                stop = best
                break
            stop = min(end, start + 2 * (stop - start))
        yield start, stop
        start = stop


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each span: its lower-cased bytes, word starts and ends in it, and the row of each word."""
    for start, stop in _cuts(data, offsets):
        low = _LOWER[data[start:stop]]
        solid = ~_WHITE[low]
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        inner = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, side="right")]
        edge[inner - start] = True
        first, last = edge[:-1].copy(), edge[1:].copy()
        first[1:] |= ~solid[:-1]
        last[:-1] |= ~solid[1:]
        starts = np.flatnonzero(solid & first)
        ends = np.flatnonzero(solid & last) + 1
        yield low, starts, ends, np.searchsorted(offsets, starts + start, side="right") - 1


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums of one polynomial."""
    up, down = _power(len(low) + 1)
    sums = np.zeros(len(low) + 1, dtype=U64)
    np.cumsum((low.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and the number of words of each row."""
    data, offsets = buffers(column)
    hashes, counts = [np.zeros(0, dtype=U64)], np.zeros(max(0, len(offsets) - 1), dtype=np.int64)
    for low, starts, ends, rows in words(data, offsets):
        hashes.append(hash_spans(low, starts, ends))
        counts += np.bincount(rows, minlength=len(counts))
    return np.concatenate(hashes), counts


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each row's distinct k-word shingles as sorted hashes; a shorter text is one shingle."""
    factor = [U64((2 * i + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF) for i in range(k)]
    n = len(hashes)
    with np.errstate(over="ignore"):
        if n >= k:
            rolled = np.zeros(n - k + 1, dtype=U64)
            for i in range(k):
                rolled += mix(hashes[i : n - k + 1 + i] * factor[i] + U64(i))
            rolled = mix(rolled + U64(k))
        at = 0
        for c in counts:
            c = int(c)
            if c >= k:
                yield np.unique(rolled[at : at + c - k + 1])
            elif c:
                whole = sum((mix(hashes[at + i : at + i + 1] * factor[i] + U64(i)) for i in range(c)), np.zeros(1, dtype=U64))
                yield mix(whole + U64(c))
            else:
                yield np.zeros(0, dtype=U64)
            at += c
