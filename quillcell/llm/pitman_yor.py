"""Language-model scores from a hierarchical Pitman-Yor model, fitted by Gibbs sampling.

A restaurant per context (the word before, or the start of a text) has as parent one restaurant
of single words, whose base is uniform over the vocabulary and one unknown word. Customers of a word
sit at its tables or open one; every table of a context is a customer of the parent. A Gibbs
step redraws the whole seating of one word in one restaurant, customer by customer by the
Chinese-restaurant rule given all other seatings; runs of customers who join old tables are
skipped in one draw, so a step costs the tables it opens and not the customers. Predictive
probabilities are averaged over the last sweeps.

Words are spread over buckets by hash, a bucket with all contexts of its words, so parent and
children are seated together. Only the totals of tables per restaurant are shared: each sweep
uses those of the sweep before. They are summed by context, and a bucket gets back those of
the contexts it has. It repeats its earlier sweeps from their seeds and the recorded totals,
so no seating is stored and a lost executor changes nothing.

Texts are scored in blocks of neighbouring rows. Each batch of a block asks once for every
distinct word and context in it; answers come back with their keys, and a block that lies in
several batches or tasks drops the repeats. Words, and pairs of words, are told apart by 64
bits of hash. Counts cover all training texts, and grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.llm.textops import U64, buffers, hash_spans, mix, words
from quillcell.session import cut_lineage, discard, written

_END = U64(0x1B873593CC9E2D51)
_START = U64(0xA0761D6478BD642F)
BLOCK = 8192
_ROWS = 1024
_ROWS_A_BUCKET = 4096
#: Bits of a key that say which of its bucket's contexts it has.
_LOCAL = 32


@dataclass(frozen=True)
class Sampler:
    sweeps: int = 4
    averaged: int = 2
    strength: float = 1.0
    seed: int = 29


def _stream(column: pa.Array, classes: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word, the context and the row of all tokens in order; every row ends with the end token.

    The context is the word before or, with ``classes``, a class of its last two bytes.
    """
    data, offsets = buffers(column)
    n = len(offsets) - 1
    hashes, kinds, rows = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
    for low, starts, ends, row in words(data, offsets):
        hashes.append(hash_spans(low, starts, ends))
        if classes:
            last = low[ends - 1].astype(U64) * U64(256) + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(U64)
            kinds.append(mix(last) % U64(classes))
        rows.append(row)
    h, row = np.concatenate(hashes), np.concatenate(rows)
    kind = np.concatenate(kinds) if classes else h
    count = np.bincount(row, minlength=n)
    at = np.arange(len(h)) + row
    end = np.cumsum(count) + np.arange(n)
    total = len(h) + n
    token, before, owner = np.empty(total, dtype=U64), np.empty(total, dtype=U64), np.empty(total, dtype=np.int64)
    token[at], token[end] = h, _END
    owner[at], owner[end] = row, np.arange(n)
    before[at + 1] = kind
    before[end - count] = U64(classes) if classes else _START
    return token, before, owner


def _pair(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(word + mix(before ^ _END))


def _shares(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first bits of sorted hashes: each value that comes, and where its run starts and ends."""
    part = (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    return part[starts], starts, np.append(starts[1:], len(hashes)).astype(np.int64)


def _raw(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def _requests(docs: DataFrame, bits: int, classes: int | None) -> DataFrame:
    """``bucket, block, words, before, counts``: the distinct pairs of a batch of a block in a bucket and how often training has them.

    A block has a row per bucket and batch that holds some of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose = batch.column("block").to_numpy(zero_copy_only=False)
            parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                word, before, row = _stream(rows.column("text"), classes)
                train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
                for b in np.unique(whose[at : at + _ROWS]):
                    mine = (whose[at : at + _ROWS] == b)[row]
                    w, u = word[mine], before[mine]
                    _, first, back = np.unique(_pair(w, u), return_index=True, return_inverse=True)
                    count = np.bincount(back, weights=train[row[mine]], minlength=len(first)).astype(np.uint32)
                    parts.setdefault(int(b), []).append((w[first], u[first], count))
            for b in sorted(parts):
                w, u, counts = (np.concatenate(x) for x in zip(*parts.pop(b)))
                _, first, back = np.unique(_pair(w, u), return_index=True, return_inverse=True)
                count = np.bincount(back, weights=counts, minlength=len(first)).astype(np.int64)
                order = np.argsort(w[first], kind="stable")
                w, u, count = w[first][order], u[first][order], count[order]
                buckets, starts, ends = _shares(w, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array(np.full(len(buckets), b)),
                     *(pa.array([_raw(x[s:e], kind) for s, e in zip(starts, ends)], pa.binary()) for x, kind in ((w, "<u8"), (u, "<u8"), (count, "<u4")))],
                    ["bucket", "block", "words", "before", "counts"])

    return docs.mapInArrow(run, "bucket long, block long, words binary, before binary, counts binary")


def _packed(requests: DataFrame) -> DataFrame:
    """One row per bucket: its distinct pairs, their training counts, and who asked for which.

    ``words`` and ``contexts`` are the distinct hashes, sorted; a key has the place of its
    word there in the upper half, that of its context in the lower.
    """

    def run(table: pa.Table) -> pa.Table:
        w, u, counts = (np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(c).to_pylist()])
                        for c, kind in (("words", "<u8"), ("before", "<u8"), ("counts", "<u4")))
        lengths = [len(x) // 8 for x in table.column("words").to_pylist()]
        _, first, back = np.unique(_pair(w, u), return_index=True, return_inverse=True)
        named, word = np.unique(w[first], return_inverse=True)
        contexts, kind = np.unique(u[first], return_inverse=True)
        keys = (word.astype(U64) << U64(_LOCAL)) | kind.astype(U64)
        order = np.argsort(keys)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        keys, back = keys[order], place[back]
        count = np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
        per_word = np.bincount(word[order], weights=count, minlength=len(named))
        facts = [int((per_word > 0).sum()), *(int((x == k).sum()) for x in (count, per_word) for k in (1, 2)), int(count.sum())]
        return pa.table({
            "bucket": table.column("bucket").slice(0, 1), "keys": pa.array([_raw(keys, "<u8")], pa.binary()),
            "words": pa.array([_raw(named, "<u8")], pa.binary()), "contexts": pa.array([_raw(contexts, "<u8")], pa.binary()),
            "counts": pa.array([_raw(count, "<i8")], pa.binary()), "facts": pa.array([facts], pa.list_(pa.int64())),
            "blocks": pa.array([table.column("block").to_pylist()], pa.list_(pa.int64())),
            "lengths": pa.array([lengths], pa.list_(pa.int64())), "asked": pa.array([_raw(back, "<u4")], pa.binary())})

    schema = ("bucket long, keys binary, words binary, contexts binary, counts binary, facts array<long>, blocks array<long>, "
              "lengths array<long>, asked binary")
    return requests.groupBy("bucket").applyInArrow(run, schema)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables after seating ``customers`` one by one; a new table has weight ``weight``, an old one its customers less the discount.

    The first sixteen are seated singly. From there the next to open a table is drawn from
    the chance that none does, ``(y / (y + m)) ** weight`` for ``m`` customers.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    n = np.ones(len(live), dtype=np.int64)
    while len(live):
        t, a, c = tables[live], weight[live], customers[live]
        u = draw.random(len(live))
        x = n - discount * t
        single = n < 16
        opens = single & (u * (x + a) < a)
        y = x - 0.5 + a / 2
        with np.errstate(over="ignore", divide="ignore"):
            jump = np.ceil(np.where(single, 1.0, y) * np.expm1(-np.log(np.maximum(u, 1e-300)) / np.maximum(a, 1e-300)))
        jump = np.where(single, 1, np.clip(np.nan_to_num(jump, nan=1e18, posinf=1e18), 1, 1e18)).astype(np.int64)
        opens |= ~single & (jump <= c - n)
        n = np.minimum(n + jump, c)
        tables[live] += opens
        more = n < c
        live, n = live[more], n[more]
    return tables


@dataclass
class Totals:
    """Customers and tables of contexts in all buckets, and tables of the parent.

    ``all_tables`` is for every context; without it the given ones are all there are.
    """

    customers: np.ndarray
    tables: np.ndarray
    parent_tables: float
    all_tables: float | None = None


@dataclass
class Model:
    words: int
    tokens: int
    discounts: tuple[float, float]
    how: Sampler
    history: list[Totals]
    bits: int = 5

    @property
    def base(self) -> float:
        return 1.0 / (self.words + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray, shared: Totals) -> np.ndarray:
        s, d = self.how.strength, self.discounts[1]
        kept = np.maximum(customers - d * tables, 0)
        return (kept + (s + d * shared.parent_tables) * self.base) / (s + (shared.tables.sum() if shared.all_tables is None else shared.all_tables))

    def run(self, bucket: int, keys: np.ndarray, counts: np.ndarray, sweeps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The seatings of a bucket after each sweep: tables per key, word of each key, customers and tables per word."""
        kind = (keys & U64((1 << self.bits) - 1)).astype(np.int64)
        change = np.diff(keys >> U64(self.bits), prepend=U64(0)) > 0
        if len(change):
            change[0] = True
        first = np.flatnonzero(change)
        word = np.cumsum(change) - 1
        guests = np.add.reduceat((counts > 0).astype(np.int64), first)
        held = np.minimum(guests, 1)
        for sweep in range(sweeps):
            shared, draw = self.history[sweep], np.random.default_rng([self.how.seed, bucket, sweep])
            up = self.parent(guests, held, shared)
            tables = seat(counts, (self.how.strength + self.discounts[0] * shared.tables[kind]) * up[word], self.discounts[0], draw)
            guests = np.add.reduceat(tables, first)
            opening = np.full(len(guests), (self.how.strength + self.discounts[1] * shared.parent_tables) * self.base)
            held = seat(guests, opening, self.discounts[1], draw)
            yield tables, word, guests, held


def _totals(sent: DataFrame) -> DataFrame:
    """``bucket, total``: for each context that a bucket sent a number for, in their order, the sum over all buckets."""

    def run(table: pa.Table) -> pa.Table:
        contexts = [np.frombuffer(x, dtype="<u8") for x in table.column("contexts").to_pylist()]
        values = np.concatenate([np.frombuffer(x, dtype="<i8") for x in table.column("values").to_pylist()])
        _, back = np.unique(np.concatenate(contexts), return_inverse=True)
        total = np.bincount(back, weights=values)[back].astype(np.int64)
        ends = np.cumsum([len(x) for x in contexts])
        return pa.table({"bucket": table.column("bucket"), "place": table.column("place"),
                         "total": pa.array([_raw(total[e - len(x) : e], "<i8") for x, e in zip(contexts, ends)], pa.binary())})

    summed = sent.select("place", "bucket", "contexts", "values").groupBy("place").applyInArrow(run, "bucket long, place long, total binary")
    return summed.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "total"))), lambda x: x["total"]).alias("total"))


def _restored(model: Model, shared: list[tuple[float, float]], totals: list[list[bytes]]) -> Model:
    """The model with the history of one bucket: customers of its contexts, then their tables after each sweep."""
    customers, *tables = (np.frombuffer(b"".join(x), dtype="<i8").astype(float) for x in totals)
    tables = [0.5 * customers, *tables]
    history = [Totals(customers, t, parent, every) for t, (parent, every) in zip(tables, shared)]
    return Model(model.words, model.tokens, model.discounts, model.how, history, _LOCAL)


def fit(packed: DataFrame, how: Sampler, bits: int) -> tuple[Model, list[tuple[float, float]], DataFrame]:
    """The model without its history, the sums over all contexts after each sweep, and ``bucket, totals`` with each bucket's history.

    A sweep writes the tables of each bucket by context; their sums go back to the buckets.
    The driver gets sums over all contexts alone.
    """
    facts = np.zeros(6, dtype=np.int64)
    for r in packed.select(F.posexplode("facts").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        facts[r.i] = r.x
    n_words, ones, twos, word_ones, word_twos, tokens = facts.tolist()
    discount = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
    model = Model(n_words, tokens, (discount(ones, twos), discount(word_ones, word_twos)), how, [], _LOCAL)
    shared = [(0.5 * n_words, 0.5 * tokens)]
    columns = ["bucket", "keys", "contexts", "counts"]
    state = None
    for sweep in range(how.sweeps + 1):
        def run(batches: Iterator[pa.RecordBatch], done: int = sweep, known: list = list(shared)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    keys, contexts, counts = (np.frombuffer(row[c], dtype=t) for c, t in (("keys", "<u8"), ("contexts", "<u8"), ("counts", "<i8")))
                    value, held = counts, np.zeros(0)
                    if done:
                        for value, _, _, held in _restored(model, known, row["totals"]).run(row["bucket"], keys, counts, done):
                            pass
                    kind = (keys & U64((1 << _LOCAL) - 1)).astype(np.int64)
                    per = np.bincount(kind, weights=value, minlength=len(contexts)).astype(np.int64)
                    places, starts, ends = _shares(contexts, bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(places), row["bucket"])), pa.array(places),
                         *(pa.array([_raw(x[s:e], t) for s, e in zip(starts, ends)], pa.binary()) for x, t in ((contexts, "<u8"), (per, "<i8"))),
                         pa.array(np.add.reduceat(per, starts)), pa.array(np.where(np.arange(len(places)) == 0, int(held.sum()), 0))],
                        ["bucket", "place", "contexts", "values", "tables", "held"])

        source = packed.select(*columns) if state is None else packed.select(*columns).join(state, "bucket")
        sent, path = written(source.mapInArrow(run, "bucket long, place long, contexts binary, values binary, tables long, held long"), "sweep")
        if sweep:
            sums = sent.agg(F.sum("held").alias("held"), F.sum("tables").alias("tables")).first()
            shared.append((float(sums.held or 0), float(sums.tables or 0)))
        totals = _totals(sent)
        state = cut_lineage(totals.select("bucket", F.array("total").alias("totals")) if state is None else state.join(totals, "bucket").select(
            "bucket", F.concat("totals", F.array("total")).alias("totals")))
        discard(packed.sparkSession, path)
    return model, shared, state


def _answers(packed: DataFrame, model: Model, shared: list[tuple[float, float]], state: DataFrame) -> DataFrame:
    """``block, bucket, keys, chance, count`` for the keys that each block asked for, once for each time it asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, d = model.how.strength, model.discounts[0]
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                keys = np.frombuffer(batch.column("keys")[i].as_py(), dtype="<u8")
                counts = np.frombuffer(batch.column("counts")[i].as_py(), dtype="<i8")
                named, contexts = (np.frombuffer(batch.column(c)[i].as_py(), dtype="<u8") for c in ("words", "contexts"))
                m = _restored(model, shared, batch.column("totals")[i].as_py())
                kind = (keys & U64((1 << _LOCAL) - 1)).astype(np.int64)
                pairs = _pair(named[(keys >> U64(_LOCAL)).astype(np.int64)], contexts[kind])
                chance = np.zeros(len(keys))
                for sweep, (tables, word, guests, held) in enumerate(m.run(bucket, keys, counts, m.how.sweeps), 1):
                    if sweep > m.how.sweeps - m.how.averaged:
                        now = m.history[sweep]
                        up = m.parent(guests, held, now)[word]
                        chance += (np.maximum(counts - d * tables, 0) + (s + d * now.tables[kind]) * up) / (s + now.customers[kind])
                chance = np.log10(chance / m.how.averaged)
                per_word = np.bincount(word, weights=counts)[word].astype(np.int64)
                asked = np.frombuffer(batch.column("asked")[i].as_py(), dtype="<u4")
                ends = np.cumsum(batch.column("lengths")[i].values.to_numpy())
                starts = np.append(0, ends[:-1])
                parts = [asked[a:b] for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("blocks")[i].values, pa.array(np.full(len(parts), bucket)),
                     pa.array([_raw(pairs[p], "<u8") for p in parts], pa.binary()),
                     pa.array([_raw(chance[p], "<f4") for p in parts], pa.binary()), pa.array([_raw(per_word[p], "<i8") for p in parts], pa.binary())],
                    ["block", "bucket", "keys", "chance", "count"])

    return packed.join(state, "bucket").mapInArrow(run, "block long, bucket long, keys binary, chance binary, count binary")


def scores(docs: DataFrame, train: Column, block: Column | None = None, how: Sampler = Sampler(),
           classes: int | None = 31) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` per row of ``docs``.

    ``train`` says which rows are learned from; null counts as not. ``block`` numbers runs
    of neighbouring rows; without it the table is written once and numbered by file and
    row. A null or empty text is its end token alone. Without a training text every
    probability is 1. Repeated rows are scored, and learned from, as often as they come;
    other columns are not looked at. ``classes`` is the number of classes of the word before
    that serve as contexts; None makes every word before a context of its own, as in op8.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"), *([block.alias("block")] if block is not None else []))
    if block is None:
        rows = cut_lineage(rows)
        rows = rows.select("doc_id", "text", "train", neighbours().alias("block"))
    count = rows.count()
    bits = max(0, int(np.ceil(np.log2(max(1, count / _ROWS_A_BUCKET)))))
    packed = cut_lineage(_packed(_requests(rows, bits, classes)))
    model, shared, state = fit(packed, how, bits)
    n, v = model.tokens, model.words

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, chance, known = (np.frombuffer(b"".join(right.column(c).to_pylist()), dtype=kind)
                                for c, kind in (("keys", "<u8"), ("chance", "<f4"), ("count", "<i8")))
        distinct, first = np.unique(asked, return_index=True)
        chance, known = chance[first].astype(np.float64), known[first]
        base = np.log10((known + 1) / (n + v + 1))
        out = []
        left = left.combine_chunks()
        for batch in left.to_batches(max_chunksize=_ROWS):
            word, before, row = _stream(batch.column("text"), classes)
            key = _pair(word, before)
            at = np.searchsorted(distinct, key)
            if not np.array_equal(distinct[np.minimum(at, len(distinct) - 1)], key):
                raise RuntimeError("a block has words that it never asked for")
            size = batch.num_rows
            total = np.bincount(row, minlength=size)
            lp = np.bincount(row, weights=chance[at], minlength=size)
            out.append(pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(~batch.column("train").to_numpy(zero_copy_only=False).astype(bool)), pa.array(total),
                 pa.array(np.bincount(row, weights=known[at] > 0, minlength=size).astype(np.int64)), pa.array(np.full(size, n)),
                 pa.array(np.bincount(row, weights=base[at], minlength=size)), pa.array(lp), pa.array(10.0 ** (-lp / total))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]))
        return pa.Table.from_batches(out, schema=None if out else _NONE)

    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
              "perplexity double")
    return rows.groupBy("block").cogroup(_answers(packed, model, shared, state).groupBy("block")).applyInArrow(score, schema)


_NONE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")),
                   *((c, pa.float64()) for c in ("base_score", "score", "perplexity"))])


def neighbours() -> Column:
    """A number for each run of :data:`BLOCK` rows of a file; for tables read from files."""
    return F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK))
