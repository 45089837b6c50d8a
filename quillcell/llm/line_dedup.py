r"""Lines that repeat across documents are dropped everywhere but in their first document.

A text is split at ``\n``. A line's key is the line without white space (``\x20\x09-\x0D``)
at its ends and with ``A-Z`` lower-cased. Keys are exploded, hashed to two 64-bit values, and
counted by distinct document. Keys of enough characters in enough documents lose all their
lines but those of the smallest ``doc_id`` that holds them. What is dropped comes back as
positions of lines, and the other lines of the text are put together again in their order.

The lines travel as hashes; only the last join moves texts. Counting distinct documents is
summed before each shuffle, so a line that a third of all documents share is no hot key there.
In the join that finds its lines again, keys that make up a thousandth of all repeated
lines or more (at most a thousand keys, by count) are broadcast; all others are joined by key,
where no key then has more than that share of the rows.

Rows: a null text is one empty line, as is an empty one. Rows of one ``doc_id`` are one
document, whatever their texts; rows without a ``doc_id`` are together one document, which
comes after all others. Repeated rows come out as often as they came in. No rows, no result.
All columns of the input stay in ``row``, so no name can clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
#: A key of at least one part in so many of all repeated lines is joined by broadcast.
HOT_PARTS = 1000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    low = F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(
        F.translate(line, string.ascii_uppercase, string.ascii_lowercase))
    return F.btrim(low, F.lit(WHITE))


def _places(docs: DataFrame, least: int) -> DataFrame:
    """``doc, digest, at, h, g``: every line whose key has ``least`` characters, without its text."""
    each = docs.select("doc", F.xxhash64("text").alias("digest"), F.posexplode(F.transform(lines(F.col("text")), key_of)).alias("at", "key"))
    return each.filter(F.length("key") >= least).select(
        "doc", "digest", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def repeated_keys(places: DataFrame, documents: int) -> DataFrame:
    """``h, g, first, n``: keys found in at least so many documents, their smallest one and their lines."""
    per = places.groupBy("h", "g").agg(
        F.count_distinct("doc").alias("known"), F.max(F.col("doc").isNull().cast("int")).alias("nameless"),
        F.min("doc").alias("first"), F.count("*").alias("n"))
    return per.filter(F.col("known") + F.col("nameless") >= documents).select("h", "g", "first", "n")


def _dropped(places: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc, digest, at`` of all lines that go."""
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_PARTS >= total
    few = F.broadcast(repeated.filter(hot).select("h", "g", "first", F.lit(True).alias("hot")))
    marked = places.join(few, ["h", "g"], "left")
    apart = marked.filter("hot is null").drop("first", "hot").join(repeated.filter(~hot).select("h", "g", "first"), ["h", "g"])
    columns = ["doc", "digest", "at", "first"]
    either = marked.filter("hot").select(*columns).unionByName(apart.select(*columns))
    return either.filter(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "digest", "at")


def without_repeated_lines(docs: DataFrame, least: int = 10, documents: int = 2) -> DataFrame:
    """``row, kept_text, n_lines, n_dropped`` for every row of ``docs``."""
    if documents < 2:
        raise ValueError("a line repeats from two documents on")
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                        F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    places = cut_lineage(_places(named.select("doc", "text"), least))
    gone = _dropped(places, cut_lineage(repeated_keys(places, documents)))
    # repeated rows name the same positions, so the set is no larger than one text's lines
    gone = gone.groupBy("doc", "digest").agg(F.collect_set("at").alias("gone")).withColumnRenamed("doc", "d").withColumnRenamed("digest", "x")
    whole = named.withColumn("digest", F.xxhash64("text"))
    both = whole.join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("x")), "left")
    every = lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return both.withColumn("lines", every).select(
        "row", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
