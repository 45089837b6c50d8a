"""The part x nation matrix of the text queries is summed by number and named after."""

from collections import Counter

from quillcell.plans import adapters as ad
from quillcell.plans.queries_sources import part_nation


def test_sums_are_keyed_by_numbers(spark, sf):
    expr = part_nation(spark, sf)
    plan = expr._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_partkey" in plan
    nation = {r.s_suppkey: r.s_nationkey for r in ad.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").collect()}
    want = Counter()
    for r in ad.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").collect():
        if r.l_suppkey in nation:
            want[str(r.l_partkey), f"n{nation[r.l_suppkey]}"] += float(r.l_quantity)
    assert {(r.gene, r.cell): round(float(r.value), 6) for r in expr.collect()} == {k: round(v, 6) for k, v in want.items()}
