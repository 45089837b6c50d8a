"""Command line of the pipeline."""

from __future__ import annotations

import argparse
import logging
import sys
import time
import uuid

from quillcell import __version__
from quillcell import params as P

log = logging.getLogger("quillcell")
BANNER = "quillcell: single-cell count matrices on Spark"


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="quillcell", description=BANNER)
    a.add_argument("filename")
    a.add_argument("--output", default="", help="output folder; a random name when left out")
    a.add_argument("--dataformat", choices=P.DATA_FORMATS, default="raw")
    a.add_argument("--minreads", type=int, default=1000)
    a.add_argument("--minexpgenes", type=float, default=0.01)
    a.add_argument("--qc_auto", choices=("yes", "no"), default="yes")
    a.add_argument("--mrnafull", action="store_true")
    a.add_argument("--exclude_gene")
    a.add_argument("--delimiter", choices=P.DELIMITERS, default="auto")
    a.add_argument("--header", choices=P.HEADERS, default="auto")
    a.add_argument("--remove_mito", choices=("yes", "no"), default="no")
    a.add_argument("--hvg", choices=P.HVG_METHODS, default="seurat")
    a.add_argument("--hvg_n", type=int, default=1000)
    a.add_argument("--pca", choices=P.PCA_METHODS, default="irlb")
    a.add_argument("--pca_n", type=int, default=75)
    a.add_argument("--nn_k", type=int, default=10)
    a.add_argument("--prune_snn", type=float, default=0.067)
    a.add_argument("--leiden_partition", choices=P.PARTITIONS, default=P.PARTITIONS[0])
    a.add_argument("--leiden_res", type=float, default=0.8)
    a.add_argument("--ignore_small_clusters", type=int, default=10)
    a.add_argument("--annotations")
    a.add_argument("--custom_clustering")
    a.add_argument("--embedding", choices=P.EMBEDDINGS, default="tSNE")
    a.add_argument("--perplexity", type=float, default=30.0)
    a.add_argument("--embedding_iterations", type=int, default=50)
    a.add_argument("--species", choices=P.SPECIES, default="mouse")
    a.add_argument("--dark_bg", action="store_true")
    a.add_argument("--de_direction", choices=P.DE_DIRECTIONS, default="up")
    a.add_argument("--add_celltypes")
    a.add_argument("--overlay_genes")
    a.add_argument("--highlight_specific_cells")
    a.add_argument("--violin_top", type=int, default=10)
    a.add_argument("--timestamp", action="store_true")
    a.add_argument("--logfile")
    a.add_argument("--loglevel", choices=("regular", "debug"), default="regular")
    a.add_argument("--nologo", action="store_true")
    a.add_argument("--timeout", type=float, default=0.0, help="seconds to show the banner")
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--min_genes", type=int, default=1000)
    a.add_argument("--min_cells", type=int, default=100)
    a.add_argument("--on_duplicate", choices=P.DUPLICATE_POLICIES, default="error")
    a.add_argument("--doublets", choices=P.DOUBLET_METHODS, default="none", help="score cells against simulated doublets")
    for name in ("markers", "symbol_map", "exon_lengths", "gene_gtf"):
        a.add_argument(f"--{name}")
    a.add_argument("--master", help="Spark master; left to spark-submit when not given")
    a.add_argument("--version", action="version", version=__version__)
    return a


def to_params(args: argparse.Namespace) -> P.PipelineParams:
    values = {k: v for k, v in vars(args).items() if k != "master"}
    values["qc_auto"] = args.qc_auto == "yes"
    values["remove_mito"] = args.remove_mito == "yes"
    values["output"] = args.output or f"quillcell-{uuid.uuid4().hex[:10]}"
    return P.PipelineParams(**values)


def setup_logging(level: str, logfile: str | None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if logfile:
        handlers.append(logging.FileHandler(logfile))
    logging.basicConfig(
        level=logging.DEBUG if level == "debug" else logging.INFO, handlers=handlers,
        format="%(asctime)s %(levelname)s %(message)s",
    )
    for noisy in ("py4j", "pyspark"):
        logging.getLogger(noisy).setLevel(logging.WARNING)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    setup_logging(args.loglevel, args.logfile)
    from quillcell.operators.filters import MatrixError
    from quillcell.plans.pipeline import Pipeline
    from quillcell.session import build_session

    try:
        params = to_params(args)
    except P.ParameterError as e:
        log.error("%s", e)
        return 2
    if not args.nologo:
        print(BANNER)
        time.sleep(args.timeout)
    began = time.time()
    try:
        Pipeline(build_session(master=args.master), params).run()
    except MatrixError as e:
        log.error("%s", e)
        return 1
    log.info("finished in %.1f minutes, results in %s", (time.time() - began) / 60, params.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
