"""Packing by concatenate and cut.

Pass one turns every text into token ids and writes them once, with the count of ids that
its split of a file had before; a split is then known by its total alone. Prefix sums over
the totals, by file name and place in the file, give each split its place in one endless row
of ids, and fixed windows cut that row. (The scan deals out splits by size, so tasks are not
in file order.)
A document that a cut crosses leaves one record on either side of it (``cut_before``,
``cut_after``). Only the last window can be short, so at most ``window - 1`` places are
padding.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcell.session import cut_lineage

_ROWS = 256
#: Texts whose words are looked up together: a word that is not kept is encoded once for all of them.
_TEXTS = 1024
#: Words and pieces of words whose ids a Python worker keeps; others are encoded anew in each batch that has them.
KEPT_WORDS, KEPT_PIECES = 300_000, 150_000


def drops_white_space(spec: dict) -> bool:
    """Whether the ids of a text are those of its words in turn, by the tokenizer's own file."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (
        split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert"))
        and "[^\\s" in split.get("pattern", {}).get("Regex", "") and not spec.get("post_processor")
        and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] or "\n" in t["content"] for t in spec["added_tokens"])
    )


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if visible in Latin-1, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


#: Words for which lower-casing is letter by letter and no rule of Unicode composition or white space is in doubt.
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0132-\u0148\u014a-\u0177\u0179-\u017e]+")


class Encoder:
    """Token ids of texts as bytes, little-endian, two bytes an id where the vocabulary allows.

    Where the tokenizer drops white space, ids are kept by word. The pieces of a new plain
    word go to the tokenizer's model one by one and are kept too; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = drops_white_space(spec)
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.pieces = None
        if self.by_word and steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"]:
            self.pieces = regex.compile(before[0]["pattern"]["Regex"])
        self.letters = byte_letters()
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) if special else "(?!)")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.words: dict[str, bytes] = {"": b""}
        self.known_pieces: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        # for a few ids the struct module is several times as fast as an array of numpy
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        ids = self._packed([t.id for t in self.tokenizer.model.tokenize(spelled)])
        if len(self.known_pieces) < KEPT_PIECES:
            self.known_pieces[piece] = ids
        return ids

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        out, rest, known = {}, [], self.known_pieces
        plain, special = _PLAIN.fullmatch, self.special.search
        cut = self.pieces.findall if self.pieces else None
        for word in words:
            if cut and plain(word) and not special(word):
                out[word] = b"".join([known.get(p) or self._piece(p) for p in cut(word.lower())])
            else:
                rest.append(word)
        for word, found in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            out[word] = self._packed(found.ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        get = self.words.get
        parts = [list(map(get, ws)) for ws in split]
        open_ = [(p, i, ws[i]) for p, ws in zip(parts, split) if None in p for i, x in enumerate(p) if x is None]
        if open_:
            found = self._encode_words(list({w for _, _, w in open_}))
            for p, i, w in open_:
                p[i] = found[w]
            if len(self.words) < KEPT_WORDS:
                self.words.update(found)
        return [b"".join(p) for p in parts]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def reads_files(docs: DataFrame) -> bool:
    """Whether rows come straight from files, so that each split of a file is in one task and in its own order."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName().startswith("LogicalRelation")


def tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, file, part, before, n, width, ids``: ``n`` counts the end id; ``before`` what the part had so far.

    A part is a split, by its file and start in it; of rows that do not come from files, a task.
    """
    files = reads_files(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        task, before, now = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                rows = batch.slice(at, _TEXTS)
                ids = [x + end for x in encoder.encode([t or "" for t in rows.column("text").to_pylist()])]
                n = np.array([len(x) // encoder.dtype.itemsize for x in ids], dtype=np.int64)
                file, part = rows.column("file"), rows.column("part")
                if not files:
                    part = pa.array(np.full(len(n), task))
                starts = np.empty(len(n), dtype=np.int64)
                for i, (key, size) in enumerate(zip(zip(file.to_pylist(), part.to_pylist()), n.tolist())):
                    if key != now:
                        now, before = key, 0
                    starts[i] = before
                    before += size
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), file, part, pa.array(starts), pa.array(n),
                     pa.array(np.full(len(n), encoder.dtype.itemsize)), pa.array(ids, pa.binary())],
                    ["doc_id", "file", "part", "before", "n", "width", "ids"])

    place = docs.metadataColumn("_metadata") if files else None
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (place["file_path"] if files else F.lit("")).alias("file"),
        (place["file_block_start"] if files else F.lit(0)).cast("long").alias("part"),
    ).mapInArrow(run, "doc_id long, file string, part long, before long, n long, width long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cut_before, cut_after``.

    One row per piece, with its ids as an array where ``with_ids`` is set. A null or empty
    text is its end id alone. Every row of ``docs`` is packed, repeated ones and those
    without ``doc_id`` too; other columns are not looked at. No rows, no pieces. The order
    of documents is that of the input's files by name, and of the rows in them; if ``docs``
    is not read from files, that of its tasks.

    The broadcast holds a row per split of the input, whatever the rows.
    """
    table = cut_lineage(tokens(docs, tokenizer, end_id))
    # a part number of more than five digits makes a name longer, so longer names come later
    earlier = Window.orderBy(F.length("file"), "file", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy("file", "part").agg(F.sum("n").alias("total"))
    places = totals.select("file", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("place"))
    placed = table.join(F.broadcast(places), ["file", "part"]).select(
        "doc_id", (F.col("place") + F.col("before")).alias("at"), "n", "width", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(lo, _ROWS).to_pydict()
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                        "sequence_id", "offset", "cut_before", "cut_after", "ids")}
                for doc, at, n, width, raw in zip(*(rows[k] for k in ("doc_id", "at", "n", "width", "ids"))):
                    ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(at + start, window)
                        length = min(n - start, window - offset)
                        piece = ids[start : start + length]
                        row = (doc, start, length, zlib.crc32(piece.tobytes()), n, sequence, offset,
                               start > 0, start + length < n, piece if with_ids else None)
                        for k, v in zip(out, row):
                            out[k].append(v)
                        start += length
                if not with_ids:
                    out.pop("ids")
                kinds = {"cut_before": pa.bool_(), "cut_after": pa.bool_(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, cut_before boolean, cut_after boolean") + (", ids array<int>" if with_ids else "")
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of pieces packed ``with_ids``: each window's ids in order, without padding."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return pieces.groupBy("sequence_id").agg(F.flatten(inside).alias("ids"))
