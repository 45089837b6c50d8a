"""Near-duplicate documents: MinHash bands propose pairs, odd sketches thin them, full sets confirm.

Every text gets ``bands * rows`` MinHash samples of its shingle set. The samples of a band
make a bucket key; all samples together are folded into an odd sketch, a bitmap that keeps
the parity of the samples that fall on each bit (Mitzenmacher, Pagh and Pham 2014). The
population count of the XOR of two sketches grows with the number of samples in which the
sets differ, and is sharp where similarities are high, so a pair that cannot reach the
threshold is dropped before its texts are fetched.

No step pairs all members of a bucket. Equal shingle sets are one class from the start.
In round one a class meets only the smallest document of each of its buckets, as a join on
the key. In round two classes meet only inside buckets that still hold more than one
component, and only across components. A link that neither round looks at would join
two documents that are already connected, so components are those of all links.

A second bitmap keeps the parity of the full set. Each bit in which two of these differ
needs an item in which the sets differ, so this count rejects without error, and sharply
where texts are short; copies that were each edited on their own fill large buckets, and
mostly fall here.

Texts that reach the threshold share a band but for a chance of ``(1 - t**rows)**bands``
(below 1e-6 for the defaults at 0.8), and the sketch limit lies 5.5 standard deviations
above what the threshold gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.llm.textops import U64, mix, shingle_sets, slices, token_hashes
from quillcell.operators.components import component_stars
from quillcell.session import cut_lineage, discard, written

SKETCH_BITS = 512
PARITY_BITS = 1024
_FILTER_BITS = 1 << 23


@dataclass(frozen=True)
class NearDup:
    """``shingle`` words a shingle; linked from ``percent`` hundredths of Jaccard similarity on."""

    shingle: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    seed: int = 17

    def limit(self) -> int:
        """The largest XOR population count that a pair at the threshold may show."""
        k, t, n = self.bands * self.rows, self.percent / 100, SKETCH_BITS
        differ = k * (1 - t)
        keep = (1 - 2 / n) ** (2 * differ)
        mean = n / 2 * (1 - keep)
        slope = -n / 2 * keep * 2 * math.log(1 - 2 / n)
        return math.ceil(mean + 5.5 * math.sqrt(slope**2 * k * t * (1 - t) + mean))


def _samples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return (
        (draw.integers(0, 1 << 32, (n, 1), dtype=np.uint64) | U64(1)).astype(np.uint32),
        draw.integers(0, 1 << 32, (n, 1), dtype=np.uint64).astype(np.uint32),
    )


def _minhash(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (items >> U64(32)).astype(np.uint32)
    best = None
    for at in range(0, len(low), 4096):
        here = (a * low[at : at + 4096] + b).min(axis=1)
        best = here if best is None else np.minimum(best, here)
    return best


def signatures(docs: DataFrame, how: NearDup) -> DataFrame:
    """``doc_id, n_shingles, fp1, fp2, bands, sketch, parity``; all but the first two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _samples(how.seed, how.bands * how.rows)
        which = np.arange(how.bands * how.rows, dtype=U64)
        for batch in (part for whole in batches for part in slices(whole)):
            hashes, counts = token_hashes(batch.column("text"))
            size, fp1, fp2, mins, even, full = [], [], [], [], [], []
            for items in shingle_sets(hashes, counts, how.shingle):
                size.append(len(items))
                full.append(len(items) > 0)
                if len(items):
                    fp1.append(items.sum(dtype=U64))
                    fp2.append(mix(items ^ U64(0x5DEECE66D)).sum(dtype=U64))
                    mins.append(_minhash(items, a, b))
                    per_bit = np.bincount((items & U64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
                    even.append(np.packbits((per_bit & 1).astype(np.uint8)))
            full = np.array(full, dtype=bool)
            n = int(full.sum())
            low = np.array(mins, dtype=np.uint32).reshape(n, how.bands * how.rows)
            spread = mix(low.astype(U64) + (which << U64(32)))
            keys = mix(spread.reshape(n, how.bands, how.rows).sum(axis=2, dtype=U64) + np.arange(how.bands, dtype=U64))
            bits = (spread >> U64(40)) % U64(SKETCH_BITS) + np.arange(n, dtype=U64)[:, None] * U64(SKETCH_BITS)
            odd = np.bincount(bits.ravel().astype(np.int64), minlength=n * SKETCH_BITS) & 1
            sketch = np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)
            parity = np.array(even, dtype=np.uint8).reshape(n, PARITY_BITS // 8).view(np.int64)
            place = np.where(full, np.cumsum(full) - 1, -1)

            def lay(values: np.ndarray, kind: pa.DataType) -> pa.Array:
                values = np.ascontiguousarray(values).view(np.int64)
                if values.ndim == 1:
                    flat = pa.array(values, pa.int64())
                else:
                    flat = pa.ListArray.from_arrays(
                        np.arange(n + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel(), pa.int64()))
                return flat.take(pa.array(place, mask=place < 0)).cast(kind)

            long, longs = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(long), pa.array(size, long), lay(np.array(fp1, dtype=U64), long),
                 lay(np.array(fp2, dtype=U64), long), lay(keys, longs), lay(sketch, longs), lay(parity, longs)],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch", "parity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>, parity array<long>")


def shingles(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``doc_id, items``: the distinct shingle hashes of the documents whose id ``wanted`` holds.

    A bitmap of the hashes of these ids, of one fixed size, keeps most other texts out of
    the shuffle; the join that follows is exact.
    """
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS))
    marks = wanted.select(spread.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(_FILTER_BITS // 64, dtype=np.int64)
    bitmap[marks.column("at").to_numpy()] = marks.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            kept = batch.filter(pa.array((shared.value[h // 64] >> (h % 64).astype(U64)) & U64(1) == 1))
            for part in slices(kept):
                sets = list(shingle_sets(*token_hashes(part.column("text")), k))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, dtype=U64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))], ["doc_id", "items"])

    named = docs.filter("doc_id is not null").select("doc_id", "text", spread.alias("h"))
    found = named.mapInArrow(run, "doc_id long, items array<long>")
    return found.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _apart(x: str, y: str, bits: int) -> Column:
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, bits // 64)),
               F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("ib"))
    both = pairs.join(right, "b").join(left, "a").select(
        "a", "b", F.size("ia").alias("na"), F.size("ib").alias("nb"), F.size(F.array_intersect("ia", "ib")).alias("both"))
    return both.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select(
        F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row's own included.
    A null or empty text, or one of white space only, has no shingle and no link. A row
    without ``doc_id`` is kept and has no component. Rows that repeat a ``doc_id`` with the
    same text are one node and come out once each. Other columns are not looked at.
    """
    spark = docs.sparkSession
    sig = cut_lineage(signatures(docs, how))
    named = sig.filter("fp1 is not null and doc_id is not null")
    least = named.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    least, least_path = written(least, "classes")
    ids = least.select("rep", "fp1", "fp2")
    reps, reps_path = written(
        named.join(ids, (named.doc_id == ids.rep) & (named.fp1 == ids.fp1) & (named.fp2 == ids.fp2), "left_semi")
        .groupBy("doc_id").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
             F.first("parity").alias("parity")),
        "reps")
    keys = reps.select("doc_id", F.posexplode("bands").alias("_band", "key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    placed, placed_path = written(keys.select("doc_id", "key").join(buckets.select("key", "lead"), "key"), "placed")

    facts = reps.select("doc_id", "n", "sketch", "parity")
    shorter, longer = F.least("na", "nb"), F.greatest("na", "nb")
    # sets of n and m items have a similarity of at most n / m, and differ in at least as many items as in bits of parity
    differ = (100 + how.percent) * _apart("pa", "pb", PARITY_BITS) <= (100 - how.percent) * (F.col("na") + F.col("nb"))
    possible = (100 * shorter >= how.percent * longer) & (_apart("sa", "sb", SKETCH_BITS) <= how.limit()) & differ

    def side(x: str) -> DataFrame:
        return facts.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("parity").alias(f"p{x}"))

    first = placed.filter("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    first, first_path = written(first.join(side("b"), "b").join(side("a"), "a").filter(possible).select("a", "b"), "pairs")
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    touched = first.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def sets_of(wanted: DataFrame) -> tuple[DataFrame, str]:
        return written(shingles(text, wanted, how.shingle), "sets")

    sets, sets_path = sets_of(touched)
    links, links_path = written(_confirmed(first, sets, how.percent), "links")
    stars = cut_lineage(component_stars(links))

    labelled = placed.join(stars, placed.doc_id == stars.node, "left").select(
        placed.doc_id, "key", F.coalesce("component", placed.doc_id).alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    known = labelled.join(mixed.select("key"), "key", "left_semi").join(facts, "doc_id")
    known, open_path = written(known, "open")
    x, y = (known.select("key", *(F.col(c).alias(f"{p}{end}") for c, p in (
        ("doc_id", ""), ("label", "l"), ("n", "n"), ("sketch", "s"), ("parity", "p")))) for end in "ab")
    second = x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & possible).select("a", "b")
    second, second_path = written(second.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    if second.limit(1).count():
        more, more_path = sets_of(
            second.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(touched, "doc_id", "left_anti"))
        extra = cut_lineage(_confirmed(second, sets.unionByName(more), how.percent))
        if extra.limit(1).count():
            stars = cut_lineage(component_stars(links.unionByName(extra)))
        discard(spark, more_path)
    for path in (reps_path, placed_path, first_path, sets_path, links_path, open_path, second_path):
        discard(spark, path)
    classes = least.join(stars, least.rep == stars.node, "left").select(
        "fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("class_id"))
    out = sig.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns.

    Of rows that repeat a ``doc_id`` all stay or go together; those without one stay.
    """
    gone = near_duplicates(docs, how).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
