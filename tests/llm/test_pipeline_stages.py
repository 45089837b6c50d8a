"""Each stage of the pipeline does its own work on what it is given."""
import corpus_pipeline as pipeline
from brute_near_dup import brute
from pyspark.sql import functions as F

from quillcell.llm import byte_cnn
from quillcell.llm.catalog import fold


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang")))
    (_, quality), (_, copies), (_, private), (_, mixing), (_, packing) = pipeline.STAGES
    kept = quality(spark, docs, sf).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(fold(5) != 0).select("doc_id", F.col("quality").alias("y"))
    score = byte_cnn.scored(docs.select("doc_id", "text"), byte_cnn.learn(docs, labels))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in score.collect() if r.score >= pipeline.LEAST_QUALITY}
    single = copies(spark, kept, sf).cache()
    groups = brute([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c}
    clean = private(spark, single, sf).cache()
    assert clean.count() == single.count() and not clean.filter("text rlike '[a-z0-9]@[a-z0-9]+[.]com'").count()
    ordered = mixing(spark, clean, sf).cache()
    assert all(df.columns == docs.columns for df in (kept, single, clean, ordered))
    assert {r.doc_id for r in ordered.collect()} <= {r.doc_id for r in clean.collect()}
    rows = packing(spark, ordered, sf).collect()
    assert sum(r.start == 0 for r in rows) == ordered.count()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
