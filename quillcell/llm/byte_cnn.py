"""Quality of a text from a byte-level convolutional network, in numpy.

Bytes become small learned vectors; filters of :data:`WIDTH` bytes are laid on every
:data:`STRIDE`-th byte of the whole text. A chunk is :data:`CHUNK` bytes and begins half a
chunk after the one before; each filter keeps its maximum per chunk. Over all chunks the
greatest maximum and the mean one go into a logistic output, one probability per text.

Weights are learned by Adam on at most ``sample`` labelled texts, those of the smallest
hashes, of each a window of :data:`CROP` bytes (its place by hash). Every text is scored
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcell.llm.textops import buffers

WIDTH, STRIDE, CHUNK, CROP = 12, 4, 512, 3072
_HALF = CHUNK // 2
_STEPS = _HALF // STRIDE
_BYTES = 1 << 17


class Network:
    def __init__(self, filters: int = 24, embed: int = 6, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        self.p = {
            "embed": draw.normal(0, 0.5, (256, embed)), "filter": draw.normal(0, 1 / np.sqrt(WIDTH * embed), (WIDTH * embed, filters)),
            "bias": np.zeros(filters), "out": draw.normal(0, 0.1, 2 * filters), "shift": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts padded with zero bytes to half chunks, and the number of half chunks of each."""
        size = np.diff(offsets)
        halves = np.maximum(2, -(-(size + STRIDE) // _HALF))
        first = (np.cumsum(halves) - halves) * _HALF
        flat = np.zeros(int(halves.sum()) * _HALF + WIDTH, dtype=np.uint8)
        flat[np.repeat(first - offsets[:-1], size) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]
        return flat, halves

    def windows(self, flat: np.ndarray) -> np.ndarray:
        """The byte windows of all filter positions, one row each."""
        n = (len(flat) - WIDTH) // STRIDE
        return np.lib.stride_tricks.as_strided(flat, (n, WIDTH), (STRIDE, 1))

    def forward(self, flat: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        n = (len(flat) - WIDTH) // STRIDE
        x = p["embed"][flat]
        width = x.shape[1]
        cols = np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, WIDTH * width), (STRIDE * width * 4, 4)))
        act = cols @ p["filter"] + p["bias"]
        np.maximum(act, 0, out=act)
        per = act.reshape(-1, _STEPS, act.shape[1])
        peak = per.max(axis=1)
        ends = np.cumsum(halves)
        last = np.zeros(len(peak), dtype=bool)
        last[ends - 1] = True
        # a chunk is two neighbouring halves of one text
        left = np.flatnonzero(~last)
        chunk = np.maximum(peak[left], peak[left + 1])
        chunks = halves - 1
        start = np.cumsum(chunks) - chunks
        top = np.maximum.reduceat(chunk, start, axis=0)
        mean = np.add.reduceat(chunk, start, axis=0) / chunks[:, None]
        pooled = np.concatenate([top, mean], axis=1)
        z = pooled @ p["out"] + p["shift"]
        keep = {"cols": cols, "per": per, "peak": peak, "left": left, "chunk": chunk, "chunks": chunks, "start": start,
                "top": top, "pooled": pooled, "flat": flat}
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), keep

    def gradients(self, prob: np.ndarray, y: np.ndarray, k: dict) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        dz = ((prob - y) / n).astype(np.float32)
        out = {"out": k["pooled"].T @ dz, "shift": dz.sum(keepdims=True)}
        dpool = dz[:, None] * p["out"][None]
        filters = p["bias"].size
        owner = np.repeat(np.arange(n), k["chunks"])
        dchunk = (dpool[:, filters:] / k["chunks"][:, None])[owner]
        hit = k["chunk"] == k["top"][owner]
        ties = np.add.reduceat(hit, k["start"], axis=0).astype(np.float32)
        dchunk = dchunk + hit * (dpool[:, :filters] / ties)[owner]
        dpeak = np.zeros_like(k["peak"])
        first = k["peak"][k["left"]] >= k["peak"][k["left"] + 1]
        np.add.at(dpeak, k["left"], dchunk * first)
        np.add.at(dpeak, k["left"] + 1, dchunk * ~first)
        arg = k["per"].argmax(axis=1)
        dact = np.zeros_like(k["per"])
        np.put_along_axis(dact, arg[:, None, :], (dpeak * (k["peak"] > 0))[:, None, :], axis=1)
        dact = dact.reshape(-1, filters)
        out["filter"], out["bias"] = k["cols"].T @ dact, dact.sum(axis=0)
        rows = np.flatnonzero(np.any(dact != 0, axis=1))
        dcols = (dact[rows] @ p["filter"].T).reshape(len(rows), WIDTH, -1)
        at = k["flat"][rows[:, None] * STRIDE + np.arange(WIDTH)]
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, at.ravel(), dcols.reshape(-1, dcols.shape[2]))
        out["embed"] = embed
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 11) -> "Network":
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = draw.permutation(len(texts))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                sizes = np.array([len(texts[i]) for i in part])
                data = np.frombuffer(b"".join(texts[i] for i in part), dtype=np.uint8)
                prob, keep = self.forward(*self.layout(data, np.concatenate([[0], np.cumsum(sizes)])))
                step += 1
                lr = rate * (1 - step / (total + 1))
                for name, g in self.gradients(prob, labels[part], keep).items():
                    g = g + 1e-4 * self.p[name] * (name != "shift")
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                    self.p[name] = (self.p[name] - lr * move).astype(np.float32)
        return self

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = buffers(column)
        out = np.zeros(len(offsets) - 1)
        at = 0
        while at < len(out):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BYTES)) - 1)
            if offsets[stop] - offsets[at] > _BYTES:
                out[at] = self._long(data[offsets[at] : offsets[at + 1]])
            else:
                out[at:stop] = self.forward(*self.layout(data, offsets[at : stop + 1]))[0]
            at = stop
        return out

    def _long(self, data: np.ndarray) -> float:
        """A text too long for one pass, in pieces that share half a chunk; the pooling is the same."""
        flat, halves = self.layout(data, np.array([0, len(data)]))
        top, total, count = 0.0, 0.0, int(halves[0]) - 1
        step = _BYTES // _HALF
        for a in range(0, count, step):
            b = min(count, a + step)
            piece = flat[a * _HALF : (b + 1) * _HALF + WIDTH]
            keep = self.forward(piece, np.array([b + 1 - a]))[1]
            top, total = np.maximum(top, keep["chunk"].max(axis=0)), total + keep["chunk"].sum(axis=0)
        z = np.concatenate([top, total / count]) @ self.p["out"] + self.p["shift"]
        return float(1 / (1 + np.exp(-np.clip(z[0], -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 2048) -> Network | None:
    """A network fitted on the texts of ``docs`` that ``labels`` marks; None without two classes to tell apart.

    ``labels`` is ``doc_id, y``. Its ``sample`` rows of the smallest hashes are sent to the
    texts, so no text is shuffled; rows without id or mark do not count.
    """
    marked = labels.filter("y is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("y").cast("int").alias("y"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    size = F.octet_length("text")
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(size - CROP + 1, F.lit(1)).cast("long"))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(marked), F.col("doc_id") == F.col("_id")).withColumn("_hash", F.xxhash64("doc_id"))
    crop = F.substring(F.col("text").cast("binary"), (place + 1).cast("int"), F.lit(CROP))
    rows = rows.select("_hash", "doc_id", crop.alias("crop"), "y").orderBy("_hash", "doc_id").limit(sample).toArrow()
    y = rows.column("y").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return None
    return Network().fit(rows.column("crop").to_pylist(), y)


def scored(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with ``score`` in 0 to 1 for each whole text; a null text counts as empty.

    Without a network the score is 0.5. Columns of ``docs`` pass through; a column named
    ``score`` is not allowed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            score = net.score(batch.column("text")) if net and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, fields + ", score double")
