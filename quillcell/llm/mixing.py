"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight, which sets its share of all words, and a schedule, which says when
in the training they come. A target stops at ``most`` times the size of its source, and what
it leaves is shared by weight among the others. The documents of a source follow one another
in hash order, round after round, until its target is met; the last document is cut there.

The schedule is a rate at evenly spaced times from 0 to 1, linear in between. Its integral,
scaled to 1, is the share of the source's words demanded so far; a document whose words
begin at share ``u`` gets the training position at which the demand is ``u``. Sorting all
copies by position gives the order of training.

Sums of sizes before a document are taken in two passes: per source and hash bucket, then
inside the bucket, so a source with a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcell.llm.textops import buffers, words
from quillcell.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: Rates at the start, middle and end: heavy sources first, light ones last.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_size``: the words of ``text``, 0 for a null text. Other columns pass through."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            for _, _, _, rows in words(*buffers(batch.column("text"))):
                counts += np.bincount(rows, minlength=len(counts))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(counts)], [*(batch.schema.names[i] for i in keep), "_size"])

    rest = docs.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return docs.mapInArrow(run, fields + ", _size long")


def targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``_null, _src, place, weight, source_size, target``, one row per source.

    The fill level is found in closed form: in rising order of the level that fills a
    source to its limit, a source is full if the level of the rest reaches that.
    """
    per = sized.groupBy("_null", "_src").agg(F.sum("_size").alias("source_size"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy("_null", "_src")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("limit").cast("double") / F.col("weight"), "place")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast(
        "double") / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    full = F.col("level") * F.col("weight") >= F.col("limit")
    final = F.min(F.when(~full, F.struct(F.col("limit").cast("double") / F.col("weight"), "place", "level"))).over(Window.partitionBy())
    return per.withColumn("target", F.when(full, F.col("limit").cast("double")).otherwise(final["level"] * F.col("weight"))).select(
        "_null", "_src", "place", "weight", "source_size", "target")


def position(share: Column, place: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """The time in [0, 1] at which the schedule of the source at ``place`` has demanded ``share``."""
    at = F.lit(None).cast("double")
    for i, rates in enumerate(schedules):
        step = 1.0 / (len(rates) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(rates, rates[1:])]
        total, done, inverse = sum(areas), 0.0, F.lit(1.0)
        for k in reversed(range(len(areas))):
            done = sum(areas[:k])
            a, b = rates[k], rates[k + 1]
            rest = F.greatest(share * total - done, F.lit(0.0))
            if a == b:
                local = rest / a if a else F.lit(0.0)
            else:
                slope = (b - a) / step
                local = (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))) - a) / slope
            here = k * step + F.least(local, F.lit(step))
            inverse = here if k == len(areas) - 1 else F.when(share * total <= done + areas[k], here).otherwise(inverse)
        at = F.when(place % len(schedules) == i, inverse).otherwise(at)
    return at


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3,
        schedules: Sequence[Sequence[float]] = SCHEDULES, whole: bool = False, with_text: bool = False) -> DataFrame:
    """``row, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``row`` is the struct of all columns of ``docs``, ``text`` only ``with_text``, so no name can clash.
    ``copies`` is an array of ``position, words``: full rounds, then the share of the last
    one; ``taken`` sums its words. With ``whole`` the last document is taken in full or not
    at all, whichever is nearer. A null text has size 0 and no copies; a null source is a
    source of its own, the last; repeated rows are rows of their own. No rows, no result.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if with_text or c != "text"]
    sized = word_counts(docs.select(
        F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"), F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_src"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"),
        F.col("doc_id").cast("long").alias("_id")))
    sized = cut_lineage(sized.withColumn("_bucket", F.substring("_order", 1, 3)))
    key = ["_null", "_src", "_bucket"]
    earlier = Window.partitionBy("_null", "_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy(*key).agg(F.sum("_size").alias("_sum")).select(
        *key, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*key).orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    # all that a document needs is in one row per bucket, so its own row is shuffled once
    facts = sums.join(targets(sized, weights, most), ["_null", "_src"])
    full = sized.withColumn("_local", F.coalesce(F.sum("_size").over(local), F.lit(0))).join(facts, key)
    words_ = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(words_ / F.nullif("source_size", F.lit(0))).cast("long")).otherwise(F.lit(0))
    full = full.withColumn("_rounds", rounds).withColumn("_left", words_ - F.col("_rounds") * F.col("source_size"))
    first = F.col("_offset") + F.col("_local")
    part = F.least(F.greatest(F.col("_left") - first, F.lit(0)), F.col("_size"))
    if whole:
        part = F.when(2 * part >= F.col("_size"), F.col("_size")).otherwise(F.lit(0))
    full = full.withColumn("_first", first).withColumn("_part", part.cast("long"))

    def copy(e: Column) -> Column:
        share = (e * F.col("source_size") + F.col("_first")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))
        return F.struct(
            position(share, F.col("place"), schedules).alias("position"),
            F.when(e < F.col("_rounds"), F.col("_size")).otherwise(F.col("_part")).alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_rounds")), copy), lambda c: c["words"] > 0)
    return full.withColumn("copies", copies).select(
        "row", F.col("_size").alias("size"), "source_size", "target", "copies",
        F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("taken"))


def training_order(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The ``columns`` of each copy that was taken, sorted by training position over the whole table.

    Copies with one position follow one another by the hash of their document.
    """
    each = mixed.select("row", F.explode("copies").alias("copy"))
    spread = F.xxhash64(F.col("row.doc_id"))
    keyed = each.select("row", F.col("copy.position").alias("_position"), spread.alias("_spread"))
    return in_order(keyed, "_position", "_spread").select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` sorted over the whole table: ranges of the keys ``by``, each sorted in its task."""
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)
