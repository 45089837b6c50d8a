"""Language of a text from n-grams in a bit-sliced Bloom filter.

Each slot of the filter holds one bit per language. The AND of an n-gram's slots is the mask
of all languages that contain it, read at once. A text's count of n-grams per language,
corrected for the share that would hit by chance, decides.

A language contains the n-grams that make up at least ``share`` of its training n-grams, so
it has at most ``1 / share`` of them whatever the corpus holds, and the filter's size is
bounded by the number of languages. N-grams are counted over all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcell.llm.textops import U64, buffers, mix

GRAM = 4
_SPAN = 1 << 19
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; digits, marks and white space are blanks. Latin-1 capitals are folded too."""
    low = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 0x20
    return low


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams of bytes within rows, and the row of each; those with two blanks in a row are left out."""
    data, offsets = buffers(column)
    for start in range(0, len(data), _SPAN):
        stop = min(len(data), start + _SPAN + GRAM - 1)
        low = _folded(data[max(0, start - 1) : stop])[min(start, 1) :]
        n = len(low) - GRAM + 1
        if n <= 0:
            continue
        code = np.zeros(n, dtype=np.uint32)
        for i in range(GRAM):
            code = (code << np.uint32(8)) | low[i : i + n]
        blank = low == 32
        pair = blank[:-1] & blank[1:]
        bad = pair[:n].copy()
        for i in range(1, GRAM - 1):
            bad |= pair[i : i + n]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, start, start + n)))
        bad |= np.arange(start, start + n) + GRAM > offsets[row + 1]
        keep = ~bad
        yield code[keep], row[keep]


def gram_counts(texts: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``lang, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            keys, counts = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
            for code, row in grams(batch.column("text")):
                key, count = np.unique((which[row].astype(U64) << U64(32)) | code, return_counts=True)
                keys.append(key)
                counts.append(count)
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
            lang = pa.DictionaryArray.from_arrays((key >> U64(32)).astype(np.int32), pa.array(names.tolist(), pa.string()))
            yield pa.RecordBatch.from_arrays(
                [lang.cast(pa.string()), pa.array((key & U64(0xFFFFFFFF)).astype(np.int64)), pa.array(count)], ["lang", "gram", "n"])

    return texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """Slots of language bits; ``chance`` is each language's rate of false hits."""

    names: list[str]
    slots: np.ndarray
    chance: np.ndarray
    hashes: int

    def _at(self, code: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(code.astype(U64) + U64(1))
        step = (h >> U64(32)) | U64(1)
        for i in range(self.hashes):
            yield ((h + U64(i) * step) & U64(len(self.slots) - 1)).astype(np.int64)

    def masks(self, code: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages that contain it, 64 to a word."""
        out = None
        for at in self._at(code):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out


def build(members: list[tuple[str, int]], bits: int = 16, hashes: int = 3) -> Filter:
    """A filter of ``(lang, gram)`` pairs with ``bits`` slots or more for each pair of a language."""
    names = sorted({n for n, _ in members})
    most = max((sum(n == m for m, _ in members) for n in names), default=1)
    size = 1 << max(10, int(np.ceil(np.log2(bits * most))))
    made = Filter(names, np.zeros((size, max(1, -(-len(names) // 64))), dtype=U64), np.zeros(len(names)), hashes)
    for i, name in enumerate(names):
        code = np.array([g for n, g in members if n == name], dtype=np.uint32)
        for at in made._at(code):
            made.slots[at, i // 64] |= U64(1 << (i % 64))
        made.chance[i] = float(((made.slots[:, i // 64] >> U64(i % 64)) & U64(1)).mean()) ** hashes
    return made


def learn(texts: DataFrame, share: float = 1e-5) -> Filter:
    """The filter of the rows ``lang, text`` whose ``lang`` is not null."""
    counts = gram_counts(texts.filter("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string")))
    total = counts.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("_total"))
    kept = counts.join(total, F.col("lang") == F.col("_l")).filter(F.col("n") >= share * F.col("_total")).select("lang", "gram")
    return build([(r["lang"], r["gram"]) for r in kept.toArrow().to_pylist()])


def predicted(docs: DataFrame, known: Filter) -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score``.

    ``und`` with score 0 for a null text or one without a letter, or if nothing was learned.
    The score is the best corrected share over the sum of the best two; ties, and texts
    without a known n-gram (score 0), get the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        langs = len(f.names)
        for batch in batches:
            text = batch.column("text")
            hits, total = np.zeros((batch.num_rows, max(1, langs))), np.zeros(batch.num_rows)
            for code, row in grams(text) if langs else ():
                mask = f.masks(code)
                total += np.bincount(row, minlength=len(total))
                for i in range(langs):
                    bit = (mask[:, i // 64] >> U64(i % 64)) & U64(1)
                    hits[:, i] += np.bincount(row, weights=bit, minlength=len(total))
            data, offsets = buffers(text)
            seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
            lettered = seen[offsets[1:]] > seen[offsets[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                lettered[i] = any(c.isalpha() for c in text[int(i)].as_py())
            fair = np.zeros_like(hits)
            if langs:
                fair = np.clip((hits / np.maximum(total, 1)[:, None] - f.chance) / (1 - f.chance), 0, 1)
            best = fair.argmax(axis=1)
            ranked = np.sort(fair, axis=1)[:, ::-1]
            top, second = ranked[:, 0], ranked[:, 1] if ranked.shape[1] > 1 else np.zeros(len(ranked))
            score = np.where(lettered & (top > 0), top / np.maximum(top + second, 1e-300), 0.0)
            lang = [f.names[b] if ok and langs else "und" for b, ok in zip(best, lettered)]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(lang, pa.string()), pa.array(score)],
                [*(batch.schema.names[i] for i in keep), "lang_pred", "score"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("text").schema.fields)
    return docs.mapInArrow(run, rest + ", lang_pred string, score double")
