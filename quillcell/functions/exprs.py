"""Column expressions shared by several operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gene-name patterns of mitochondrial and spike-in genes.
MITO_PATTERN = r"(?i)^mt-"
SPIKE_PATTERN = r"^ERCC[_-]\S+$"


def is_mito(gene: str = "gene") -> Column:
    return F.col(gene).rlike(MITO_PATTERN)


def is_spike(gene: str = "gene") -> Column:
    return F.col(gene).rlike(SPIKE_PATTERN)


def unversioned(gene: str = "gene") -> Column:
    """The id without its ``.N`` version suffix; ids without one stay as they are."""
    bare = F.regexp_extract(F.col(gene), r"^(.+)\.[0-9]+", 1)
    return F.when(bare != "", bare).otherwise(F.col(gene))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int = 20) -> Column:
    """1-based right-closed equal-width bin; the lowest edge belongs to bin 1."""
    width = F.nullif(high - low, F.lit(0.0)) / bins
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.coalesce(F.ceil((value - low) / width), F.lit(1))))


def smallest_overlap(k: int, prune: float) -> int:
    """The smallest shared count ``v`` of two k-sets with ``v / (2k - v) > prune``."""
    for v in range(0, k + 1):
        if v / (k + (k - v)) > prune:
            return v
    return k + 1


def half_even(value: float) -> int:
    return int(math.floor(value + 0.5)) if value % 1 != 0.5 else int(2 * round(value / 2))
