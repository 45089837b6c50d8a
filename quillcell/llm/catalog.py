"""The queries of this package: ``opN_<name>`` over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcell.llm import byte_cnn, language
from quillcell.llm.divergence import divergences
from quillcell.llm.line_dedup import without_repeated_lines
from quillcell.llm.mixing import in_order, mix
from quillcell.llm.multi_index import multi_index_search
from quillcell.llm.near_dup import NearDup, near_duplicates
from quillcell.llm.packing import pack
from quillcell.llm.pii import KINDS, listed, personal_data
from quillcell.llm.pitman_yor import neighbours, scores
from quillcell.llm.spelling import variants
from quillcell.llm.topk import exact_top_k, vectors
from quillcell.llm.url_filter import judged, parse
from quillcell.session import cut_lineage

RULES = (parse("org/", "allow"), parse("example.org/es/", "block"), parse("example.org/en/1", "block"),
         parse("com/fr/", "allow"), parse("com/de/", "block"))


def tokenizer() -> str:
    """The vocabulary file; only packing needs the package that knows its place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_inverted_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), zero=False))
    return multi_index_search(rows.filter("vec_id % 20 = 0"), rows, 20)


def op4_weak_supervision(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    found = found.select("row.doc_id", "spans", F.filter("spans", lambda x: x["base"]).alias("base"))
    of = lambda i: lambda x: x["k"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_language_bitmask(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = language.learn(docs.filter(fold(4) != 2).select("lang", "text"))
    rows = docs.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return language.predicted(rows, known)


def op7_byte_cnn(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").cast("string"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(fold(5) != 0).select("doc_id", F.col("quality").alias("y"))
    network = byte_cnn.learn(docs, labels)
    out = byte_cnn.scored(docs, network)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = cut_lineage(rows.withColumn("v", F.transform("v", lambda x: F.floor(64 * x).cast("double"))))
    return exact_top_k(rows.filter("vec_id % 20 = 0"), rows, 20, integer=True)


def fold(n: int) -> Column:
    """The remainder that splits documents into folds; null without ``doc_id``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_boosted_url_trees(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), RULES)


def op3_curriculum_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text"))
    first = F.element_at(F.transform("copies", lambda c: c["position"]), F.when(F.size("copies") > 0, F.lit(1)))
    placed = mixed.select("row.doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("position"), F.xxhash64("row.doc_id").alias("_spread"))
    return in_order(placed, "position", "_spread").drop("_spread")


def op8_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = scores(docs, fold(7) != 2, neighbours(), classes=None)
    return out


def op9_concatenate_cut(spark: SparkSession, sf: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer())


def op10_odd_sketches(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return near_duplicates(docs, NearDup(shingle=3, percent=85))


def op11_k2_quadtree(spark: SparkSession, sf: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf}/documents.parquet"))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf}/documents.parquet"))


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = without_repeated_lines(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_inverted_multi_index, op2_boosted_url_trees, op3_curriculum_mix, op4_weak_supervision, op5_language_bitmask, op6_exact_top_k, op7_byte_cnn, op8_pitman_yor, op9_concatenate_cut, op10_odd_sketches, op11_k2_quadtree, op12_spelling_variants, op13_line_dedup)}
ORACLES = {
    "op11_k2_quadtree": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT d.lang, source, coalesce(v, 0) AS v FROM d LEFT JOIN v ON d.lang = v.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, g.v, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM f),
l AS (SELECT lang, term, any_value(v) AS v, sum(n) AS n FROM f GROUP BY ALL),
q AS (SELECT *, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, CAST(p - q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
w AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), 128 + unicode(x) % 64] END))),
    lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM u, tab),
r AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM r WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.cut = b.word),
g AS (SELECT word, count(*) AS n_near, max(m) AS m, first(other ORDER BY m DESC, other) AS other FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n
  FROM v LEFT JOIN g USING (word)),
p AS (SELECT word, word AS root FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, p.root FROM f JOIN p ON f.form = p.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN p USING (word)
""",
    "op13_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, min(doc_id) AS one FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> one AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
""",
    "op6_exact_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
    "op3_curriculum_mix": """
WITH s AS (
  SELECT doc_id, source IS NULL AS no, coalesce(source, '') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
per AS (
  SELECT no, src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY no, src) - 1 AS place
  FROM s GROUP BY 1, 2),
w AS (SELECT *, [5, 2, 1][CAST(place % 3 AS INTEGER) + 1] AS weight, 3 * source_size AS lim FROM per),
lv AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (
      ORDER BY CAST(lim AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT no, src, place, source_size, CASE WHEN level * weight >= lim THEN CAST(lim AS DOUBLE) ELSE weight * (
    SELECT level FROM lv WHERE level * weight < lim ORDER BY CAST(lim AS DOUBLE) / weight, place LIMIT 1) END AS target FROM lv),
p AS (
  SELECT s.*, place, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
    CAST(coalesce(sum(size) OVER (PARTITION BY no, src ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM s JOIN t USING (no, src)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS rounds FROM p),
r AS (
  SELECT *, CAST(rounds * size + least(greatest(words - rounds * source_size - before, 0), size) AS BIGINT) AS taken,
    before / nullif(target, 0) AS u FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE place % 3
    WHEN 0 THEN CASE WHEN u <= 0.625 THEN (1.5 - sqrt(2.25 - 2 * u)) / 1.0
      ELSE 0.5 + (1.0 - sqrt(1.0 - 2 * (u - 0.625))) END
    WHEN 1 THEN u
    ELSE CASE WHEN u <= 0.375 THEN sqrt(0.25 + 2 * u) - 0.5
      ELSE 0.5 + (sqrt(1.0 + 2 * (u - 0.375)) - 1.0) END END, 9) END AS position
FROM r
""",
}
