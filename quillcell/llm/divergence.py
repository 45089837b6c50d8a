r"""How far the sources of a language are apart in their words: a k2-tree over the counts.

Terms are runs of letters and non-ASCII characters with ``A-Z`` lower-cased. A language keeps
the terms of at least ``least`` of its documents. A group (language and source) gives a kept
term the share ``p = 1 + floor(10^9 * (count + 5) / (N + 5 * V))``, which is never zero and is
an integer, so all sums are exact.

The matrix of groups (rows) and kept terms (columns) is mostly zero. It is cut into squares of
64 x 64; a square without a count is not there, and each other one is a k2-tree with k = 2: a
level holds four bits for each quadrant that is not all zero, and the rank of a bit is the
place of its quadrant on the next level (Brisaboa, Ladra and Navarro 2009). Two rows walk
down their trees together, all pairs of a square at once. Where both quadrants are zero they
stop: each of its columns is worth the same, the difference of the shares of two zero counts,
so all such columns of a pair are priced as their number times that. Only columns in which
one of the two counts is not zero are read.

Columns are placed by how many documents a term has, so that frequent terms share squares and
rare ones leave empty quadrants. A place need not have a term: it is then zero everywhere and
never read, and ``V`` counts terms and not places. Terms are placed in parts of some 1024 by
hash, so no task sorts a language's terms.

A hot source or language is summed before each shuffle, a row of the tree table holds at most
4096 counts, and each source pair of a language is a row of the result, by definition.

Rows: null text, lang and source are ''. Repeated rows and rows that share a ``doc_id`` or have
none count one by one. A language without kept terms gives pairs of value 0. Ties go to the
smaller item. Other columns are not read. No rows, no result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcell.llm.textops import U64, buffers, by_bytes, hash_spans
from quillcell.session import cut_lineage

LEVELS = 6
SIDE = 1 << LEVELS
_PART = 1024
_SLICE = 1 << 20
_HELD = 1 << 18
_FILTER_BITS = 1 << 23
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, dtype=bool)
_SOLID[97:123] = _SOLID[128:] = True


def _summed(counts: Iterator[pa.RecordBatch], keys: list[str], value: str) -> Iterator[pa.RecordBatch]:
    """The rows of several batches with one row for each key, some ``_HELD`` rows at a time."""
    parts: list[pa.RecordBatch] = []
    for part in itertools.chain(counts, [None]):
        if part is not None:
            parts.append(part)
        if parts and (part is None or sum(p.num_rows for p in parts) >= _HELD):
            table = pa.TableGroupBy(pa.Table.from_batches(parts), keys, use_threads=False).aggregate([(value, "sum")])
            yield from table.rename_columns({f"{value}_sum": value}).select([*keys, value]).to_batches()
            parts = []


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a column in order, and the row of each."""
    data, offsets = buffers(column)
    low = _LOWER[data]
    solid = _SOLID[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    letters = low[solid]
    ends = np.concatenate([[0], np.cumsum(solid)])[np.append(starts, len(low))]
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters))
    return found, np.searchsorted(offsets, starts, side="right") - 1


def _hashes(dictionary: pa.Array) -> np.ndarray:
    data, offsets = buffers(dictionary)
    return (hash_spans(data, offsets[:-1], offsets[1:]) & U64(_FILTER_BITS - 1)).astype(np.int64)


def _encoded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def document_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, docs`` over all rows of ``lang, source, text``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, _SLICE):
                found, row = terms(part.column("text"))
                which, words = _encoded(found)
                lang, langs = _encoded(part.column("lang"))
                n = max(1, len(words))
                once = np.unique(row * n + which)
                key, docs = np.unique(lang[once // n] * n + once % n, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(key // n)), words.take(pa.array(key % n)).cast(pa.string()), pa.array(docs)], ["lang", "term", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(counted(batches), ["lang", "term"], "docs")

    return docs.mapInArrow(run, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def placed(kept: DataFrame) -> DataFrame:
    """``kept`` with ``tile, col``: its square and column; terms of like frequency are neighbours."""
    graded = kept.withColumn("grade", F.floor(F.log2("docs")))
    graded = cut_lineage(graded)  # so that Spark knows the size of both sides of the join
    sizes = graded.groupBy("lang", "grade").agg(F.ceil(F.count("*") / _PART).alias("parts"))
    sizes = cut_lineage(sizes)
    dealt = graded.join(sizes, ["lang", "grade"]).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    place = F.row_number().over(Window.partitionBy("lang", "grade", "part").orderBy(F.desc("docs"), "term")) - 1
    tile = F.shiftleft("grade", 56).bitwiseOR(F.shiftleft("part", 24)).bitwiseOR(F.floor(F.col("place") / SIDE))
    return dealt.withColumn("place", place).select("lang", "term", "docs", tile.alias("tile"), (F.col("place") % SIDE).alias("col"))


def _filter(kept: DataFrame) -> np.ndarray:
    """A bitmap of one fixed size of the hashes of all kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(batch.column("term"))))], ["h"])

    marks = kept.select("term").mapInArrow(run, "h long").groupBy(F.floor(F.col("h") / 64).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(_FILTER_BITS // 64, dtype=np.int64)
    bitmap[marks.column("at").to_numpy()] = marks.column("bits").to_numpy()
    return bitmap.view(U64)


def group_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, term, n`` and the columns of ``kept``, for the terms that ``kept`` holds."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(kept))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, _SLICE):
                found, row = terms(part.column("text"))
                which, words = _encoded(found)
                h = _hashes(words)
                wanted = ((shared.value[h // 64] >> (h % 64).astype(U64)) & U64(1) == 1)[which]
                lang, langs = _encoded(part.column("lang"))
                source, sources = _encoded(part.column("source"))
                n, m = max(1, len(words)), max(1, len(sources))
                group = (lang * m + source)[row[wanted]]
                key, count = np.unique(group * n + which[wanted], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(key // n // m)), sources.take(pa.array(key // n % m)), words.take(pa.array(key % n)).cast(pa.string()),
                     pa.array(count)], ["lang", "source", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(counted(batches), ["lang", "source", "term"], "n")

    found = docs.mapInArrow(run, "lang string, source string, term string, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"])


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 * (count + 5) / total)`` in whole numbers; null for a total of 0."""
    whole = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return F.call_function("div", whole, F.nullif(total, F.lit(0)).cast("decimal(20,0)")).cast("long") + 1


class Tree:
    """The k2-tree of one square: ``bits[l]`` has four bits a quadrant of level ``l``, ``ranks[l]`` their places below."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray):
        code = np.zeros(len(row), dtype=np.int64)
        for b in range(LEVELS):
            code |= (((row >> b) & 1) << (2 * b + 1)) | (((col >> b) & 1) << (2 * b))
        order = np.argsort(code)
        code, self.leaves = code[order], value[order]
        self.bits, self.ranks = [], []
        for level in range(LEVELS):
            below = np.unique(code >> (2 * (LEVELS - 1 - level)))
            above, place = np.unique(below >> 2, return_inverse=True)
            bits = np.zeros(4 * len(above), dtype=bool)
            bits[4 * place + (below & 3)] = True
            self.bits.append(bits)
            self.ranks.append(np.cumsum(bits) - 1)

    def root(self, n: int) -> np.ndarray:
        return np.zeros(n, dtype=np.int64) if len(self.leaves) else np.full(n, -1)

    def child(self, level: int, node: np.ndarray, row: np.ndarray, half: int) -> np.ndarray:
        """For each quadrant and row the half of its columns one level down, or -1 where that is all zero."""
        if not len(self.leaves):
            return node
        at = 4 * node + 2 * ((row >> (LEVELS - 1 - level)) & 1) + half
        return np.where((node >= 0) & self.bits[level][at], self.ranks[level][at], -1)


def walk(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, zero_a: np.ndarray, zero_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows ``i`` of ``a`` and ``j`` of ``b``: the summed difference of its columns that are
    not zero in both, and their number. ``zero_a`` and ``zero_b`` are the shares of a zero count by row."""
    pair, x, y = np.arange(len(i)), a.root(len(i)), b.root(len(j))
    for level in range(LEVELS):
        halves = []
        for half in (0, 1):
            down = a.child(level, x, i[pair], half), b.child(level, y, j[pair], half)
            live = (down[0] >= 0) | (down[1] >= 0)
            halves.append((pair[live], down[0][live], down[1][live]))
        pair, x, y = (np.concatenate(p) for p in zip(*halves))
    mine = np.where(x >= 0, a.leaves[x] if len(a.leaves) else 0, zero_a[i[pair]])
    other = np.where(y >= 0, b.leaves[y] if len(b.leaves) else 0, zero_b[j[pair]])
    # at most 64 columns of some 10^9 each: exact in double precision
    total = np.bincount(pair, weights=np.abs(mine - other), minlength=len(i))
    return total.astype(np.int64), np.bincount(pair, minlength=len(i))


def _tree(batch: pa.RecordBatch, side: str, at: int) -> Tree:
    """The tree of one square; a missing one is all zero."""
    place, share = (batch.column(f"{side}_{c}")[at] for c in ("at", "p"))
    none = np.zeros(0, dtype=np.int64)
    places, p = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else none for x in (place, share))
    return Tree(places // SIDE, places % SIDE, p)


def leaf_sums(squares: DataFrame) -> DataFrame:
    """``lang, i, j, leaves, width`` from rows ``lang, lo, hi, zero_lo, zero_hi, a_at, a_p, b_at, b_p``, one per pair of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            lang, lo, hi = (batch.column(c).to_pylist() for c in ("lang", "lo", "hi"))
            for at in range(batch.num_rows):
                key = lang[at], lo[at], hi[at]
                zero_a, zero_b = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("zero_lo", "zero_hi"))
                if key not in sums:
                    i, j = np.triu_indices(len(zero_a), 1) if lo[at] == hi[at] else (x.ravel() for x in np.indices((len(zero_a), len(zero_b))))
                    sums[key] = [i, j, np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)]
                i, j, total, width = sums[key]
                a = _tree(batch, "a", at)
                b = a if lo[at] == hi[at] else _tree(batch, "b", at)
                t, w = walk(a, b, i, j, zero_a, zero_b)
                total += t
                width += w
            for (lang_, lo_, hi_), (i, j, total, width) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_] * len(i), pa.string()), pa.array(i + lo_ * SIDE), pa.array(j + hi_ * SIDE), pa.array(total), pa.array(width)],
                    ["lang", "i", "j", "leaves", "width"])

    walked = squares.mapInArrow(run, "lang string, i long, j long, leaves long, width long")
    return walked.groupBy("lang", "i", "j").agg(F.sum("leaves").alias("leaves"), F.sum("width").alias("width"))


def _squares(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each square and each pair of blocks of rows that it has a part in."""
    rows = groups.select("lang", "source", F.floor(F.col("i") / SIDE).alias("block"), (F.col("i") % SIDE).alias("row"), "total", "zero")
    # a share is at most 1 + 10^9
    entry = F.struct((F.col("row") * SIDE + F.col("col")).cast("short").alias("at"), share(F.col("n"), F.col("total")).cast("int").alias("p"))
    tiles = cells.join(rows, ["lang", "source"]).groupBy("lang", "block", "tile").agg(F.collect_list(entry).alias("cells"))
    tiles = tiles.select("lang", "block", "tile", F.struct(F.col("cells.at").alias("at"), F.col("cells.p").alias("p")).alias("cells"))
    zeros = rows.groupBy("lang", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "zero"))), lambda x: x["zero"]).alias("zeros"))
    lo = zeros.select("lang", F.col("block").alias("lo"), F.col("zeros").alias("zero_lo"))
    hi = zeros.select("lang", F.col("block").alias("hi"), F.col("zeros").alias("zero_hi"))
    blocks = lo.join(hi, "lang").filter("lo <= hi")
    nothing = F.lit(None).cast(tiles.schema["cells"].dataType)
    names = ["lang", "lo", "hi", "tile"]
    pairs = blocks.select("lang", "lo", "hi")
    left = tiles.withColumnRenamed("block", "lo").join(pairs, ["lang", "lo"]).select(*names, F.col("cells").alias("a"), nothing.alias("b"))
    right = tiles.withColumnRenamed("block", "hi").join(pairs.filter("lo < hi"), ["lang", "hi"]).select(*names, nothing.alias("a"), F.col("cells").alias("b"))
    met = left.unionByName(right).groupBy(*names).agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    return met.join(blocks, ["lang", "lo", "hi"]).select(
        "lang", "lo", "hi", "zero_lo", "zero_hi", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in ("at", "p")))


def divergences(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source's distance to the others, and its ``top`` own terms."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    named = docs.select(text("lang"), text("source"), text("text"))
    kept = cut_lineage(placed(document_counts(named).filter(F.col("docs") >= least)))
    cells = cut_lineage(group_counts(named, kept).select("lang", "source", "term", "n", "tile", "col"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(size, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("total", F.lit(0)) + 5 * F.coalesce("v", F.lit(0))).alias("total"))
    groups = groups.withColumn("zero", F.coalesce(share(F.lit(0), F.col("total")), F.lit(0)))
    groups = cut_lineage(groups.withColumn("i", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")))

    leaves = leaf_sums(_squares(cells, groups))
    one = groups.select("lang", "i", F.col("source").alias("one"), F.col("zero").alias("z"), "v")
    two = groups.select("lang", F.col("i").alias("j"), F.col("source").alias("two"), F.col("zero").alias("y"))
    pairs = one.join(two, "lang").filter("i < j").join(leaves, ["lang", "i", "j"], "left")
    value = F.coalesce("leaves", F.lit(0)) + (F.col("v") - F.coalesce("width", F.lit(0))) * F.abs(F.col("z") - F.col("y"))
    pairs = pairs.withColumn("value", value).select("lang", "value", F.explode(F.array(
        F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("e"))
    pairs = pairs.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    whole = cells.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    totals = groups.groupBy("lang").agg((F.sum(F.col("total") - 5 * F.col("v")) + 5 * F.first("v")).alias("of"))
    own = cells.join(groups.select("lang", "source", "total"), ["lang", "source"]).join(whole, ["lang", "term"]).join(totals, "lang")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     (share(F.col("n"), F.col("total")) - share(F.col("all"), F.col("of"))).alias("value")).filter("value > 0")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(own.withColumn("rank", rank).filter(F.col("rank") <= top))
