"""Parameters of the full pipeline and their validation."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

# The accepted choices of each option.
DATA_FORMATS = ("raw", "rpkm", "log2")
DELIMITERS = ("auto", "tab", "space")
HEADERS = ("auto", "yes", "no")
HVG_METHODS = ("seurat", "Brennecke2013", "scran", "Chen2016", "M3Drop_smartseq2", "M3Drop_UMI")
PCA_METHODS = ("irlb", "regular")
PARTITIONS = ("RBERVertexPartition", "ModularityVertexPartition")
EMBEDDINGS = ("tSNE", "UMAP")
SPECIES = ("human", "mouse", "other")
DE_DIRECTIONS = ("any", "up", "down")
DUPLICATE_POLICIES = ("error", "drop_all")
DOUBLET_METHODS = ("none", "scrublet", "doublet_finder")

# Options that name files or steer logging only; a change does not make a stage stale.
_COSMETIC = ("output", "dark_bg", "timestamp", "logfile", "loglevel", "nologo", "timeout")


class ParameterError(ValueError):
    """An option is outside its range."""


@dataclass(frozen=True)
class PipelineParams:
    filename: str = ""
    output: str = ""
    dataformat: str = "raw"
    minreads: int = 1000
    minexpgenes: float = 0.01
    qc_auto: bool = True
    mrnafull: bool = False
    exclude_gene: str | None = None
    delimiter: str = "auto"
    header: str = "auto"
    remove_mito: bool = False
    hvg: str = "seurat"
    hvg_n: int = 1000
    pca: str = "irlb"
    pca_n: int = 75
    nn_k: int = 10
    prune_snn: float = 0.067
    leiden_partition: str = "RBERVertexPartition"
    leiden_res: float = 0.8
    ignore_small_clusters: int = 10
    annotations: str | None = None
    custom_clustering: str | None = None
    embedding: str = "tSNE"
    perplexity: float = 30.0
    embedding_iterations: int = 50
    species: str = "mouse"
    dark_bg: bool = False
    de_direction: str = "up"
    add_celltypes: str | None = None
    overlay_genes: str | None = None
    highlight_specific_cells: str | None = None
    violin_top: int = 10
    timestamp: bool = False
    logfile: str | None = None
    loglevel: str = "regular"
    nologo: bool = False
    timeout: float = 0.0
    seed: int = 42
    min_genes: int = 1000
    min_cells: int = 100
    on_duplicate: str = "error"
    doublets: str = "none"
    markers: str | None = None
    symbol_map: str | None = None
    exon_lengths: str | None = None
    gene_gtf: str | None = None

    def __post_init__(self) -> None:
        for name, choices in (
            ("dataformat", DATA_FORMATS),
            ("delimiter", DELIMITERS),
            ("header", HEADERS),
            ("hvg", HVG_METHODS),
            ("pca", PCA_METHODS),
            ("leiden_partition", PARTITIONS),
            ("embedding", EMBEDDINGS),
            ("species", SPECIES),
            ("de_direction", DE_DIRECTIONS),
            ("on_duplicate", DUPLICATE_POLICIES),
            ("doublets", DOUBLET_METHODS),
        ):
            if getattr(self, name) not in choices:
                raise ParameterError(f"{name} must be one of {', '.join(choices)}")
        for name in ("minreads", "minexpgenes", "nn_k", "ignore_small_clusters"):
            if getattr(self, name) < 0:
                raise ParameterError(f"{name} must not be negative")
        for name in ("hvg_n", "pca_n", "violin_top", "leiden_res", "perplexity"):
            if getattr(self, name) <= 0:
                raise ParameterError(f"{name} must be positive")
        if not 0 <= self.prune_snn <= 1:
            raise ParameterError("prune_snn must lie in [0, 1]")

    def digest(self, *names: str) -> str:
        """Key of a stored stage: a hash of the options it depends on (all by default)."""
        chosen = names or [f.name for f in fields(self) if f.name not in _COSMETIC]
        picked = {n: asdict(self)[n] for n in sorted(chosen)}
        return hashlib.sha256(json.dumps(picked, sort_keys=True).encode()).hexdigest()[:16]
