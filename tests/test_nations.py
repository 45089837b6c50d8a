"""The nations of the planted query are found, in a number of Spark jobs that the rounds do not add to."""

from collections import defaultdict

from quillcell.plans.queries_graph import g03n


def test_nations_are_found_in_few_jobs(spark, tmp_path):
    rows = [(i, i % 3 if i % 11 else None) for i in range(1, 61)]  # some customers are of no nation
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    sc = spark.sparkContext
    sc.setJobGroup("nations", "nations")
    found = {r["cell"]: (r["size"], r["first"]) for r in g03n(spark, str(tmp_path)).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("nations"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    nations = defaultdict(list)
    for k, nation in rows:
        nations[nation if nation is not None else f"alone {k}"].append(k)
    assert found == {str(k): (len(v), str(min(v))) for v in nations.values() for k in v}
    assert jobs < 60
