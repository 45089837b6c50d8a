"""The whole pipeline through its command line on a small matrix with planted clusters."""

import csv
import glob
import os

import numpy as np
import pytest

from quillcell import cli
from quillcell.params import ParameterError, PipelineParams
from quillcell.plans.stages import StageStore


def make_matrix(path, markers):
    rng = np.random.default_rng(21)
    genes = [f"Gene{i}" for i in range(150)] + ["mt-Co1", "mt-Nd1", "ERCC-00001", "ERCC-00002"]
    cells = [f"C{j:03d}" for j in range(90)]
    x = rng.poisson(0.4, (len(genes), len(cells)))
    for k in range(3):
        x[k * 20:(k + 1) * 20, k * 30:(k + 1) * 30] += rng.poisson(40, (20, 30))
    with open(path, "w") as f:
        f.write("\t".join(["id", *cells]) + "\n")
        for g, row in zip(genes, x):
            f.write("\t".join([g, *map(str, row)]) + "\n")
    with open(markers, "w") as f:
        f.write("species\tofficial gene symbol\tcell type\tubiquitousness index\n")
        for k in range(3):
            for i in range(k * 20, k * 20 + 12):
                f.write(f"Mm Hs\tGENE{i}\tType {k}\t0.01\n")


def table(path, sep="\t", header=True):
    rows = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part) as f:
            got = list(csv.reader(f, delimiter=sep))
        rows += got[1:] if header else got
    return rows


def test_command_line_run(spark, tmp_path):
    matrix, markers, out = str(tmp_path / "m.tsv"), str(tmp_path / "mk.tsv"), str(tmp_path / "out")
    make_matrix(matrix, markers)
    upper = tmp_path / "sym.tsv"
    upper.write_text("ENSMUSG00000000001\tGNAI3\n")
    args = [matrix, "--output", out, "--minreads", "100", "--min_genes", "100", "--min_cells", "50", "--hvg_n", "80", "--pca_n", "8",
            "--ignore_small_clusters", "5", "--embedding_iterations", "3", "--perplexity", "8", "--nologo", "--markers", markers,
            "--symbol_map", str(upper), "--qc_auto", "no", "--overlay_genes", "GENE3", "--violin_top", "3", "--doublets", "doublet_finder"]
    assert cli.main(args) == 0
    clusters = dict(table(f"{out}/csvs/clusters_leiden.csv", ",", False))
    assert len(clusters) == 90
    blocks = {c: {clusters[f"C{j:03d}"] for j in range(k * 30, k * 30 + 30)} for k, c in enumerate("abc")}
    assert blocks["a"].isdisjoint(blocks["b"]) and blocks["b"].isdisjoint(blocks["c"])
    assert len(table(f"{out}/csvs/highly_variable_genes.tsv", header=False)) == 80
    assert len(table(f"{out}/csvs/pca.csv", ",", False)[0]) == 9
    assert len(table(f"{out}/csvs/embeddings_tSNE.csv", ",", False)) == 90
    best = table(f"{out}/csvs/CTA_RANK_F/cell_type_pred_best.txt")
    assert {r[2] for r in best} <= {"Type 0", "Type 1", "Type 2"}
    markers_found = table(f"{out}/csvs/discovered_markers.tsv")
    assert markers_found and all(0 <= float(r[2]) <= 1 for r in markers_found)
    assert spark.read.parquet(f"{out}/plots/overlay_GENE3").count() == 90
    doublets = table(f"{out}/score.txt")
    assert {r[0] for r in doublets} == set(clusters) and {r[1] for r in doublets} == {"obs"} and all(0 <= float(r[2]) <= 1 for r in doublets)
    # a second run reads its stages; another input is refused
    stages = sorted(glob.glob(f"{out}/stages/*"))
    assert cli.main(args) == 0
    assert sorted(glob.glob(f"{out}/stages/*")) == stages
    other = str(tmp_path / "other.tsv")
    make_matrix(other, markers)
    assert cli.main([other, *args[1:]]) == 1


def test_options_are_checked():
    for bad in ({"minreads": -1}, {"hvg": "x"}, {"prune_snn": 2.0}, {"nn_k": -1}, {"hvg_n": 0}):
        with pytest.raises(ParameterError):
            PipelineParams(**bad)
    a, b = PipelineParams(hvg_n=10), PipelineParams(hvg_n=11)
    assert a.digest() != b.digest() and a.digest("seed") == b.digest("seed")
    assert cli.main(["x", "--prune_snn", "3"]) == 2


def test_stage_store_builds_once(spark, tmp_path):
    store, calls = StageStore(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert store.get("a", "k", build).count() == store.get("a", "k", build).count() == 3
    assert len(calls) == 1
    store.get("a", "other", build)
    assert len(calls) == 2


def test_relative_paths_and_changed_inputs(spark, tmp_path, monkeypatch):
    from quillcell.plans.stages import exists, input_mark, read_text, write_text

    monkeypatch.chdir(tmp_path)
    where = os.path.relpath(tmp_path / "out" / "note.txt", os.getcwd())
    home = spark._jvm.org.apache.hadoop.fs.Path(".").getFileSystem(spark._jsc.hadoopConfiguration()).getWorkingDirectory().toString()
    relative = os.path.relpath(str(tmp_path / "out" / "note.txt"), home.removeprefix("file:"))
    write_text(relative, "a\nb")
    assert exists(relative) and read_text(relative) == "a\nb" and (tmp_path / where).read_text() == "a\nb"
    before = input_mark(relative)
    write_text(relative, "longer text")
    assert input_mark(relative) != before
    store = StageStore(spark, os.path.dirname(relative))
    assert store.get("x", "1", lambda: spark.range(3)).count() == 3 and (tmp_path / "out" / "stages" / "x-1" / "_SUCCESS").exists()
