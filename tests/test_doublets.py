"""Simulated doublets are put together for the chosen genes alone, with the totals of all."""

from quillcell.matrix import Matrix
from quillcell.operators import doublets as D
from quillcell.operators.normalize import log_normalize


def test_doublets_of_some_genes_keep_all_totals_and_cells(spark):
    entries = [(f"g{g}", f"c{c}", float(1 + (g * c) % 7)) for g in range(12) for c in range(15) if (g + c) % 4 and not (c > 11 and g < 3)]
    m = Matrix(spark.createDataFrame(entries, "gene string, cell string, value double"))
    genes = spark.createDataFrame([("g0",), ("g1",), ("g2",)], "gene string")
    some, cells = D.normalized_doublets(m, genes, 40, 7)
    whole = log_normalize(D.simulate_doublets(m, 40, 7))
    chosen = {(r["gene"], r["cell"]): r["value"] for r in whole.expr.collect() if r["gene"] in ("g0", "g1", "g2")}
    assert {(r["gene"], r["cell"]): r["value"] for r in some.expr.collect()} == chosen
    assert {r["cell"] for r in cells.collect()} == {r["cell"] for r in whole.cells.collect()} and cells.count() == 40
