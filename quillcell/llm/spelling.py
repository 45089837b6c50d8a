r"""Words one edit apart, and the frequent word that a rare one is a spelling of.

Runs of ``[A-Za-zÀ-ÿ]`` are lower-cased (``A-Z`` only). One in ``odds`` of them, by the
crc32 of document and run, loses one code point: made mistakes to find again. Words are the
results of at least ``length`` code points that occur at least ``times`` times.

Two words are near if they differ by one inserted, deleted or replaced code point. One edit
leaves the first half of the longer word or the rest of it as it is, so words meet only where
they share such a half (and the longer length); for each word that is two halves for its own
length and two for the length above. What meets is compared densely: the words lie in padded matrices of
code points, aligned left and right, and for two blocks of rows the lengths of the common
prefix and of the common suffix of all pairs are counted column by column. They are near
exactly if both together reach the longer length minus one. A pair that shares both halves
counts in the first. Small groups of one length are compared in one tile; halves with more
than a block of words are cut into pairs of blocks by hash, so no task holds more than two
blocks of a group, and no pair is left out.

A word's ``form`` is its near word of largest count (ties: smallest), if that is at least
``times_form`` times its own. Counts grow by that factor along forms, so the number of
steps to a root is bounded by the logarithm of the largest count; roots are found by doubling.

Rows: a null text has no words. Without a ``doc_id`` no run is changed. Repeated rows count
again. Other columns are not read. No rows, no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcell.llm.textops import buffers, by_bytes
from quillcell.session import cut_lineage

BLOCK = 2048
_TILE = 512
_SMALL = 128
_SLICE = 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True


def runs(column: pa.Array, length: int) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased runs of at least ``length`` code points, in order, and the row of each."""
    data, offsets = buffers(column)
    low = _LOWER[data]
    # U+00C0 to U+00FF are the byte C3 and one more
    lead = low == 0xC3
    solid = _LETTER[low] | lead
    solid[1:] |= lead[:-1]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    ends = np.append(starts, len(low))
    letters = low[solid]
    sums = np.concatenate([[0], np.cumsum(solid)])[ends]
    points = np.concatenate([[0], np.cumsum(solid & ~np.concatenate([[False], lead[:-1]]) if len(low) else solid)])[ends]
    every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sums.astype(np.int64)), pa.py_buffer(letters))
    long = np.diff(points) >= length
    return every.filter(pa.array(long)), np.searchsorted(offsets, starts[long], side="right") - 1


def word_counts(docs: DataFrame, length: int = 7, odds: int = 31) -> DataFrame:
    """``word, n``: all words of at least ``length`` code points of ``id, text``, some of them with a code point less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, _SLICE):
                found, row = runs(part.column("text"), length)
                coded = found.dictionary_encode()
                words = coded.dictionary.to_pylist()
                raw = [w.encode() for w in words]
                pair, count = np.unique(row * max(1, len(words)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                begin = [None if i is None else crc32(f"{i}:".encode()) for i in part.column("id").to_pylist()]
                row, which = np.divmod(pair, max(1, len(words)))
                # an odd number that is no multiple of ``odds`` stands for a missing id
                h = np.array([1 if (b := begin[r]) is None else crc32(raw[w], b) for r, w in zip(row.tolist(), which.tolist())], dtype=np.int64)
                hit = (h % odds == 0) & np.array([b is not None for b in begin], dtype=bool)[row]
                same = np.bincount(which[~hit], weights=count[~hit], minlength=len(words)).astype(np.int64)
                out, n = [w for w, s in zip(words, same.tolist()) if s], same[same > 0].tolist()
                for w, x, c in zip(which[hit].tolist(), h[hit].tolist(), count[hit].tolist()):
                    word = words[w]
                    if len(word) > length:
                        at = x % len(word)
                        out.append(word[:at] + word[at + 1 :])
                        n.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halves(words: DataFrame) -> DataFrame:
    """``longest, tail, half, word, n``: where a word meets others, four rows a word."""
    size = F.length("word")
    at = lambda c: F.floor(c / 2).cast("int")
    rows = [F.struct((size + more).cast("int").alias("longest"), F.lit(tail).alias("tail"),
                     (F.expr(f"right(word, {c} - int({c} div 2))") if tail else F.substring(F.col("word"), F.lit(1), at(size + more))).alias("half"))
            for more, c in ((0, "length(word)"), (1, "(length(word) + 1)")) for tail in (False, True)]
    return words.select("word", "n", F.explode(F.array(*rows)).alias("e")).select("e.longest", "e.tail", "e.half", "word", "n")


def met(words: DataFrame) -> DataFrame:
    """``longest, tail, tile, part, word, n``, a tile's rows together: part 1 meets part 2, any other meets itself.

    Part 0 is a whole group, which can share a tile with others; part 3 is one block of a larger group.

    Groups without a word of the longer length are left out: their words are all too short for it.
    """
    each = halves(words)
    key = ["longest", "tail", "half"]
    sizes = each.groupBy(*key).agg(F.count("*").alias("size"), F.max(F.length("word") == F.col("longest")).alias("whole"))
    sizes = sizes.filter((F.col("size") > 1) & F.col("whole")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    each = each.join(sizes.select(*key, "blocks"), key)
    each = each.withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    part = F.when(F.col("blocks") == 1, 0).when(lo == hi, 3).when(F.col("mine") == lo, 1).otherwise(2)
    each = each.select("longest", "tail", F.xxhash64("longest", "tail", "half", lo, hi).alias("tile"), part.cast("int").alias("part"), "word", "n")
    return each.repartition("tile").sortWithinPartitions("longest", "tail", "tile", "part", "word")


def matrices(words: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and right, padded with 0, one row of the matrix per column of a word; and the lengths."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    left = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in raw), dtype=np.uint8).reshape(len(raw), longest).T.copy()
    right = np.frombuffer(b"".join(w.rjust(longest, b"\0") for w in raw), dtype=np.uint8).reshape(len(raw), longest).T[::-1].copy()
    return left, right, np.array([len(w) for w in raw], dtype=np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of columns, how many of their first entries agree."""
    alive = a[0][:, None] == b[0][None, :]
    length = alive.astype(np.uint8)
    for x, y in zip(a[1:], b[1:]):
        alive &= x[:, None] == y[None, :]
        length += alive
    return length


def near(a: tuple, b: tuple, longest: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two blocks that are one edit apart and that share the half that is asked for."""
    prefix, suffix = _common(a[0], b[0]), _common(a[1], b[1])
    half = longest // 2
    found = prefix + suffix >= longest - 1
    found &= (prefix < half) & (suffix >= longest - half) if tail else prefix >= half
    found &= ((a[2] == longest)[:, None] | (b[2] == longest)[None, :])
    return np.nonzero(found)


class _Tally:
    """Near words of each word of a tile: their number and the best one."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        order = pc.sort_indices(pa.table({"n": pa.array(n), "w": words}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()
        self.place = np.empty(len(n), dtype=np.int64)
        self.place[order] = np.arange(len(n))
        self.order, self.words, self.n = order, words, n
        self.count, self.best = np.zeros(len(n), dtype=np.int64), np.full(len(n), len(n), dtype=np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, 1)
        np.minimum.at(self.best, i, self.place[j])

    def batch(self) -> pa.RecordBatch:
        has = np.flatnonzero(self.count)
        best = self.order[self.best[has]]
        return pa.RecordBatch.from_arrays(
            [self.words.take(pa.array(has)), pa.array(self.count[has]), pa.array(self.n[best]), self.words.take(pa.array(best))],
            ["word", "n_near", "best_n", "best"])


def _tile(rows: pa.Table, longest: int, tail: bool) -> pa.RecordBatch:
    """All near pairs of one tile, in squares of bounded size."""
    words, n, part = rows.column("word").combine_chunks(), rows.column("n").to_numpy(), rows.column("part").to_numpy()
    tally = _Tally(words, n)
    left, right, size = matrices(words, longest)
    cut = lambda at: (left[:, at], right[:, at], size[at])
    inner = part[0] in (0, 3)
    mine, other = (np.arange(len(n)),) * 2 if inner else (np.flatnonzero(part == 1), np.flatnonzero(part == 2))
    for s in range(0, len(mine), _TILE):
        for t in range(s if inner else 0, len(other), _TILE):
            i, j = near(cut(mine[s : s + _TILE]), cut(other[t : t + _TILE]), longest, tail)
            i, j = mine[s + i], other[t + j]
            if inner and s == t:
                i, j = i[i < j], j[i < j]
            tally.add(i, j)
            tally.add(j, i)
    return tally.batch()


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of all words of ``word, n`` that have a near word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key = [rows.column(c).to_numpy() for c in ("longest", "tail", "tile")]
            new = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])]))
            ends = np.append(new[1:], len(key[0]))
            split = rows.column("part").to_numpy()
            k = 0
            while k < len(new):
                end = k + 1
                same = lambda e: key[0][new[e]] == key[0][new[k]] and key[1][new[e]] == key[1][new[k]] and not split[new[e]]
                while not split[new[k]] and end < len(new) and same(end) and ends[end] - new[k] <= _SMALL:
                    end += 1
                yield _tile(rows.slice(new[k], ends[end - 1] - new[k]), int(key[0][new[k]]), bool(key[1][new[k]]))
                k = end

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = held.column("tile").to_numpy()
            at = len(last) - 1 - int(np.argmax(last[::-1] != last[-1])) if (last != last[-1]).any() else -1
            if at >= 0:
                yield from tiles(held.slice(0, at + 1))
                held = held.slice(at + 1)
        if held is not None and held.num_rows:
            yield from tiles(held)

    found = met(words).mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root`` of all words of ``word, form``, whose chains have at most so many links."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        now = cut_lineage(now)
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return now


def variants(docs: DataFrame, length: int = 7, times: int = 2, odds: int = 31, times_form: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``doc_id, text``."""
    named = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    words = cut_lineage(word_counts(named, length, odds).filter(F.col("n") >= times))
    nears = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= times_form * F.col("n")
    nears = cut_lineage(nears.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    most = nears.agg(F.max("form_n")).first()[0] or 1
    steps = math.ceil(math.log(max(most, 2)) / math.log(times_form)) + 1
    ends = roots(nears.filter("form is not null"), steps)
    return nears.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
