"""Mixing, packing, language, quality and scores: exact checks on small tables."""
import collections
import math
import re
import zlib

import numpy as np
import pytest
from odd_rows import documents, nothing
from pyspark.sql import functions as F

from quillcell.llm import byte_cnn, language
from quillcell.llm.catalog import fold, op3_curriculum_mix, op5_language_bitmask, op7_byte_cnn, tokenizer
from quillcell.llm.mixing import mix, training_order
from quillcell.llm.packing import Encoder, pack, sequences
from quillcell.llm.pitman_yor import Model, Sampler, Totals, scores, seat
from quillcell.llm.textops import token_hashes

WORD = r"[^\x20\x09-\x0D]+"
FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(WORD, (text or "").translate(FOLDED))


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["A b\x0bc", None, "", "  é\u00a0é a ", "x" * 100, "b A"]
    hashes, counts = token_hashes(pa.array(texts))
    assert counts.tolist() == [len(tokens(t)) for t in texts]
    named = {}
    for w, h in zip([w for t in texts for w in tokens(t)], hashes.tolist()):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


def test_mix_targets_and_order(spark):
    docs = documents(spark)
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["size"] == len(tokens(texts[r["row"]["doc_id"]])) for r in rows)
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
        one = per[r["row"]["source"]]
        one[0] += r["size"]
        one[1] += r["taken"]
        one[2] = r["target"]
    total = sum(v[0] for v in per.values())
    for size, taken, target in per.values():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-6
    assert abs(sum(v[2] for v in per.values()) - total) < 1e-6
    ordered = training_order(mix(docs, whole=True, with_text=True), docs.columns)
    assert ordered.columns == docs.columns and ordered.count() == sum(len(r["copies"]) for r in mix(docs, whole=True).collect())
    assert mix(nothing(spark)).count() == 0


def test_curriculum_follows_its_schedule(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    flat = mix(docs).select("row.source", F.explode("copies").alias("c")).select("source", "c.*").toPandas()
    for source, rates in (("s0", (1.5, 1.0, 0.5)), ("s1", (1, 1, 1)), ("s2", (0.5, 1.0, 1.5))):
        words = flat[flat.source == source]
        for lo in (0.0, 0.25, 0.5, 0.75):
            middle = np.interp(lo + 0.125, (0, 0.5, 1), rates)
            share = words[(words.position >= lo) & (words.position < lo + 0.25)].words.sum() / words.words.sum()
            assert share == pytest.approx(0.25 * middle, abs=0.01)


def test_pack_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer())
    odd = ["a<|endoftext|>b", "Σας İI ŉ é́", "don't 12½ \x1c\x85 x", "l'été Œuvre"]
    docs = documents(spark, [(20 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(odd)])
    pieces = pack(docs, tokenizer(), window=64, with_ids=True).cache()
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert r.sequence_id * 64 + r.offset == at and r.length == len(r.ids) and r.cut_after == (r.start + r.length < r.doc_tokens)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.length
    got = collections.defaultdict(dict)
    for r in rows:
        if r.doc_id not in (7, None):
            got[r.doc_id][r.start] = r.ids
    for d in docs.collect():
        if d.doc_id not in (7, None):
            assert sum((got[d.doc_id][s] for s in sorted(got[d.doc_id])), []) == whole.encode(d.text or "", add_special_tokens=False).ids + [2]
    full = sequences(pieces).collect()
    assert sorted(len(r.ids) for r in full)[1:] == [64] * (len(full) - 1)
    assert pack(nothing(spark), tokenizer()).count() == 0


def test_sequences_follow_positions_over_files(spark, tmp_path):
    """Files grow along the order, so the scan reads them in another one; packing keeps that of their names."""
    docs = spark.range(0, 400, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.md5(F.col("id").cast("string")), 20)).alias("text"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        copies = mix(docs, whole=True).select("row.doc_id", F.xxhash64("row.doc_id").alias("h"), F.explode("copies").alias("c")).collect()
        want = [r.doc_id for r in sorted(copies, key=lambda r: (r.c.position, r.h))]
        training_order(mix(docs, whole=True, with_text=True), docs.columns).write.parquet(f"{tmp_path}/mixed")
        for i, n in enumerate((5, 20, 60, 200)):
            docs.filter((F.col("doc_id") >= (0, 5, 25, 85)[i]) & (F.col("doc_id") < (0, 5, 25, 85)[i] + n)).write.parquet(f"{tmp_path}/grown/p={i}")
        for cost in ("4MB", "1"):
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            for path, ids in (("mixed", want), ("grown", list(range(285)))):
                table = spark.read.parquet(f"{tmp_path}/{path}")
                assert len(table.inputFiles()) == 4
                rows = sorted(pack(table, tokenizer(), window=64).collect(), key=lambda r: (r.sequence_id, r.offset))
                assert [r.doc_id for r in rows if r.start == 0] == ids
                assert [r.sequence_id * 64 + r.offset for r in rows] == np.cumsum([0] + [r.length for r in rows])[:-1].tolist()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_mix_query_is_in_training_order(spark):
    rows = op3_curriculum_mix(spark, "/root/testdata/sf0.01").collect()
    at = [-1.0 if r.position is None else r.position for r in rows]
    assert at == sorted(at) and len(set(at)) > 2


def test_words_encode_like_the_whole_tokenizer():
    e = Encoder(tokenizer())
    texts = ["Àé's we'll 1²a_b-c", "ſ ŉ ĳ \u00ad x\u0301 ª", "<|startoftext|>x", "tab\tnl\nnbsp\u00a0end", "", "😀😀 ß"]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, dtype=e.dtype).tolist() for x in e.encode(texts)] == want


def test_language_held_out(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in op5_language_bitmask(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.93 and all(0 <= r.score <= 1 for r in held)


def test_language_odd_rows(spark):
    docs = documents(spark)
    known = language.learn(docs.select("lang", "text"))
    assert known.names == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.predicted(docs.select("doc_id", "text"), known).collect()}
    assert got[3].lang_pred == got[2].lang_pred == got[4].lang_pred == got[10].lang_pred == "und" and got[2].score == 0
    assert got[9].lang_pred == "fr" and got[6].lang_pred == "de"
    none = language.learn(nothing(spark).select("lang", "text"))
    assert {r.lang_pred for r in language.predicted(docs.select("doc_id", "text"), none).collect()} == {"und"}
    code = np.array([1, 2, 3], dtype=np.uint32)
    made = language.build([("a", 1), ("b", 1), ("b", 2)])
    assert made.masks(code)[:, 0].tolist() == [3, 2, 0]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op7_byte_cnn(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.85


def test_quality_odd_rows(spark):
    docs = documents(spark).select("doc_id", "text")
    assert {r.score for r in byte_cnn.scored(docs, byte_cnn.learn(docs, docs.select("doc_id", F.lit(1).alias("y")))).collect()} == {0.5}
    net = byte_cnn.Network()
    got = {r.doc_id: r.score for r in byte_cnn.scored(docs, net).collect()}
    assert got[2] == got[3] and all(0 <= s <= 1 for s in got.values()) and got[5] == got[6]
    data = np.frombuffer((b"some text! " * 60_000), dtype=np.uint8)
    whole = net.forward(*net.layout(data, np.array([0, len(data)])))[0][0]
    assert net._long(data) == pytest.approx(float(whole), abs=1e-5)


def test_network_gradients():
    draw = np.random.default_rng(0)
    net = byte_cnn.Network(filters=4, embed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["embed"] = net.p["embed"].astype(np.float32)
    data = draw.integers(32, 120, 2000).astype(np.uint8)
    place, y = net.layout(data, np.array([0, 700, 2000])), np.array([1.0, 0.0])
    loss = lambda: -np.mean([math.log(p if t else 1 - p) for p, t in zip(net.forward(*place)[0], y)])
    prob, keep = net.forward(*place)
    for name in ("filter", "out", "bias"):
        g = net.gradients(prob, y, keep)[name]
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        step = 1e-5
        net.p[name][i] += step
        up = loss()
        net.p[name][i] -= 2 * step
        down = loss()
        net.p[name][i] += step
        assert (up - down) / (2 * step) == pytest.approx(g[i], rel=2e-2)


def test_scores_base_is_exact(spark):
    docs = documents(spark)
    got = scores(docs, fold(7) != 2).collect()
    train = [tokens(r.text) + [None] for r in docs.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    count = collections.Counter(w for ws in train for w in ws)
    n, v = sum(count.values()), len(count)
    texts = {r.doc_id: tokens(r.text) + [None] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        ws = texts[r.doc_id]
        assert r.n_tokens == len(ws) and r.train_tokens == n and r.n_known == sum(count[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score <= 0 and r.perplexity == pytest.approx(10 ** (-r.score / len(ws)))
    assert scores(nothing(spark), fold(7) != 2).count() == 0
    assert {r.score for r in scores(docs, F.lit(False)).collect()} == {0.0}


def test_scores_do_not_depend_on_batches(spark):
    """A block that batches or tasks cut asks several times, and every row is still scored by its own words."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.range(0, 300, 1, 1).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.element_at(
            F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", k), F.lit(40)) + 1).cast("int")))).alias("text"))
    read = lambda df: sorted(map(tuple, scores(df, F.col("doc_id") % 3 != 0, F.floor(F.col("doc_id") / 128), classes=None).collect()))
    whole = read(docs)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        assert read(docs) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert read(docs.repartition(5)) == whole


def test_every_word_before_is_a_context_of_its_own(spark):
    """Words before that end in the same two bytes foretell different words."""
    docs = spark.range(0, 400, 1, 2).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "aaxx left").otherwise("bbxx right").alias("text"))
    probe = spark.createDataFrame([(1000, "aaxx left"), (1001, "aaxx right"), (1002, "bbxx right"), (1003, "bbxx left")], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in scores(docs.unionByName(probe), F.col("doc_id") < 1000, classes=None).collect()}
    assert rows[1000] > rows[1001] + 1 and rows[1002] > rows[1003] + 1


def test_next_word_chances_sum_to_one(spark):
    """All first words, the unknown one and the end too, have probability one together."""
    docs = spark.createDataFrame([(i, "aa bb aa cc dd aa bb") for i in range(30)], "doc_id long, text string")
    probe = spark.createDataFrame([(100, "")] + [(101 + i, w) for i, w in enumerate(("aa", "bb", "cc", "dd", "zz"))], "doc_id long, text string")
    both = docs.unionByName(probe)
    rows = {r.doc_id: r.score for r in scores(both, F.col("doc_id") < 100).collect()}
    assert rows == {r.doc_id: r.score for r in scores(both, F.col("doc_id") < 100).collect()}
    # a text of one word also pays for its end, so single words are read from texts that share all but the first word
    assert rows[101] > rows[102] > rows[105] and all(math.isfinite(x) and x < 0 for x in rows.values())


def test_chances_of_a_context_sum_to_one():
    how = Sampler()
    keys = np.sort(np.array([(w << 5) | g for w in (3, 9, 12) for g in (0, 1)], dtype=np.uint64))
    counts = np.array([5, 1, 20, 0, 2, 7])
    model = Model(3, 35, (0.5, 0.4), how, [])
    per = np.bincount((keys & np.uint64(31)).astype(int), weights=counts, minlength=32)
    model.history.append(Totals(per, per * 0.5, 2.0))
    for sweep in range(3):
        tables, word, guests, held = list(model.run(0, keys, counts, sweep + 1))[-1]
        kind = (keys & np.uint64(31)).astype(int)
        now = Totals(per, np.bincount(kind, weights=tables, minlength=32), float(held.sum()))
        model.history.append(now)
        up, unknown = model.parent(guests, held, now), model.parent(np.zeros(1), np.zeros(1), now)[0]
        assert up.sum() + unknown == pytest.approx(1.0)
        for g in (0, 1):
            share = (np.maximum(counts - 0.5 * tables, 0) + (1 + 0.5 * now.tables[g]) * up[word]) / (1 + per[g])
            assert share[kind == g].sum() + (1 + 0.5 * now.tables[g]) * unknown / (1 + per[g]) == pytest.approx(1.0)


def test_seating_counts_tables():
    draw = np.random.default_rng(1)
    for c, a, d in ((5, 0.7, 0.4), (400, 3.0, 0.2), (400, 0.01, 0.0)):
        got = seat(np.full(4000, c), np.full(4000, a), d, draw).mean()
        single = []
        for _ in range(1500):
            t = 1
            for n in range(1, c):
                t += draw.random() < a / (n - d * t + a)
            single.append(t)
        assert got == pytest.approx(np.mean(single), rel=0.05)
    assert seat(np.array([0, 1]), np.array([1.0, 1.0]), 0.5, draw).tolist() == [0, 1]
