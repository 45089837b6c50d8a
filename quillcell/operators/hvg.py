"""Highly variable genes by six published methods.

Each function takes a matrix and returns at most ``n`` gene rows in rank order. All of
them reduce the matrix to one row per gene first; no step gathers the genes in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcell.functions.distributions import chi2_sf, normal_sf
from quillcell.functions.exprs import equal_width_bin
from quillcell.matrix import Matrix, gene_moments
from quillcell.operators.glm import GAMMA_IDENTITY, GAMMA_MIXED_LINK, fit_glm
from quillcell.operators.multiplicity import benjamini_hochberg
from quillcell.operators.normalize import unlog
from quillcell.operators.quantile import exact_quantile
from quillcell.session import cut_lineage

FDR = 0.10


def ranked(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in order, numbered. The window sees only those rows."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def significant(df: DataFrame, n: int, fdr: float = FDR) -> DataFrame:
    adjusted = benjamini_hochberg(df, "p_val", "padj").filter(F.col("padj") < fdr)
    return ranked(adjusted, [F.asc("p_val"), F.asc("gene")], n)


def binned_dispersion(m: Matrix, bins: int = 20) -> DataFrame:
    """Per gene: mean, dispersion, mean bin and the z-score of the dispersion in its bin."""
    stats = gene_moments(m).select("gene", "mean", (F.col("var") / F.nullif("mean", F.lit(0.0))).alias("dispersion"))
    edges = stats.agg(F.struct(F.min("mean").alias("lo"), F.max("mean").alias("hi"))).scalar()
    placed = stats.withColumn(
        "bin", equal_width_bin(F.col("mean"), edges.getField("lo"), edges.getField("hi"), bins).cast("int")
    )
    # one row per bin, so the broadcast is bounded by the number of bins
    per_bin = placed.groupBy("bin").agg(
        F.avg("dispersion").alias("bin_mean"), F.stddev_samp("dispersion").alias("bin_sd")
    )
    return placed.join(F.broadcast(per_bin), "bin").select(
        "gene", "mean", "dispersion", "bin",
        ((F.col("dispersion") - F.col("bin_mean")) / F.nullif(F.col("bin_sd"), F.lit(0.0))).alias("z"),
    )


def seurat(m: Matrix, n: int = 1000, bins: int = 20, digits: int | None = None) -> DataFrame:
    """Genes by normalised dispersion; genes alone in their bin have no z and come last.

    With ``digits`` values that agree to so many places count as ties, which go by name.
    """
    z = F.col("z") if digits is None else F.round("z", digits)
    order = [z.desc_nulls_last(), F.asc("gene")]
    return ranked(binned_dispersion(m, bins), order, n)


def brennecke_moments(m: Matrix) -> DataFrame:
    """Linear-scale mean, variance and squared coefficient of variation."""
    return gene_moments(unlog(m)).select(
        "gene", "n", "mean", "var", (F.col("var") / F.nullif(F.col("mean") * F.col("mean"), F.lit(0.0))).alias("cv2")
    )


def _mean_cutoff(genes: DataFrame, spread: str) -> DataFrame:
    return exact_quantile(genes.filter(F.col(spread) > 0.3), "mean", 0.8, name="cutoff")


def brennecke(
    m: Matrix, n: int = 1000, spikes: Matrix | None = None, fdr: float = FDR, min_bio_cv: float = 0.5,
    fit: str = "mle", compat: bool = False,
) -> DataFrame:
    """Genes whose squared coefficient of variation exceeds the technical fit.

    ``fit='mle'`` is the gamma likelihood with an identity link; ``'mixed_link'`` is the
    fixed point with the log-link derivative. ``compat`` uses the variance in the fallback
    cut-off and returns the genes by name instead of by p-value.
    """
    genes = cut_lineage(brennecke_moments(m))
    tech = cut_lineage(brennecke_moments(spikes)) if spikes else genes
    cutoff = _mean_cutoff(tech, "cv2")
    used = tech.filter(F.col("mean") >= cutoff.scalar())
    if used.limit(20).count() < 20:
        used = tech.filter(F.col("mean") >= _mean_cutoff(genes, "var" if compat else "cv2").scalar())
    points = used.filter(F.col("cv2") > 0).select("cv2", (1 / F.col("mean")).alias("inv_mean"))
    family = GAMMA_IDENTITY if fit == "mle" else GAMMA_MIXED_LINK
    model = fit_glm(points, ["inv_mean"], "cv2", family)
    a0, a1 = (float(c) for c in model.coef)
    bio = min_bio_cv ** 2
    cv2_level = a0 + bio + a0 * bio
    cells = tech.select(F.max("n").alias("m")).scalar() if spikes else F.col("n")
    mean = F.col("mean")
    expected = (mean * a1 + mean * mean * cv2_level) / (1 + cv2_level / cells)
    tested = genes.withColumn("p_val", chi2_sf(F.col("var") * (cells - 1) / expected, (cells - 1).cast("double")))
    if compat:
        adjusted = benjamini_hochberg(tested, "p_val", "padj").filter(F.col("padj") < fdr)
        return ranked(adjusted, [F.asc("gene")], n)
    return significant(tested, n, fdr)


def polynomial_fit(points: DataFrame, x: str, y: str, degree: int) -> tuple[np.ndarray, float, float]:
    """Least-squares polynomial in the standardised ``x``; one pass for scale, one for sums."""
    mean, sd = points.agg(F.avg(x), F.stddev_pop(x)).first()
    sd = sd or 1.0
    u = (F.col(x) - mean) / sd
    power = [F.pow(u, F.lit(k)) for k in range(2 * degree + 1)]
    sums = points.agg(*[F.sum(c) for c in power], *[F.sum(power[k] * F.col(y)) for k in range(degree + 1)]).first()
    s, t = np.array(sums[: 2 * degree + 1]), np.array(sums[2 * degree + 1:])
    normal = np.array([[s[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.lstsq(normal, t, rcond=None)[0], float(mean), float(sd)


def scran(m: Matrix, spikes: Matrix, n: int = 1000, compat: bool = False) -> DataFrame:
    """Genes by biological variance: total variance less the spike-in trend.

    The trend is a quartic in the mean, fitted to ln variance. ``compat`` subtracts it on
    the ln scale.
    """
    tech = gene_moments(spikes).filter(F.col("var") > 0).select("mean", F.ln("var").alias("ln_var"))
    tech = cut_lineage(tech)
    if tech.limit(1).count() == 0:
        raise ValueError("this method needs spike-in genes with non-zero variance")
    coef, centre, scale = polynomial_fit(tech, "mean", "ln_var", 4)
    u = (F.col("mean") - centre) / scale
    trend = sum((F.lit(float(c)) * F.pow(u, F.lit(k)) for k, c in enumerate(coef)), F.lit(0.0))
    scored = gene_moments(m).select(
        "gene", "mean", "var", (F.col("var") - (trend if compat else F.exp(trend))).alias("bio_var")
    )
    return ranked(scored, [F.col("bio_var").desc_nulls_last(), F.asc("gene")], n)


def mean_cv_points(m: Matrix) -> DataFrame:
    """``gene, lx, ly``: log10 mean and log10 coefficient of variation on the linear scale."""
    return (
        gene_moments(unlog(m)).filter((F.col("mean") > 0) & (F.col("var") > 0))
        .select("gene", F.log10("mean").alias("lx"), F.log10(F.sqrt("var") / F.col("mean")).alias("ly"))
    )


def mean_density(points: DataFrame, step: float = 0.005, reach: float = 0.05) -> DataFrame:
    """``i, x, genes``: genes within ``reach`` of each grid point of the log10 means.

    A gene adds itself to the grid points in its reach, at most ``2 * reach / step + 2`` rows.
    """
    edges = points.agg(F.struct(F.min("lx").alias("lo"), F.max("lx").alias("hi"))).scalar()
    lo, hi = edges.getField("lo"), edges.getField("hi")
    at = (F.col("lx") - lo) / step
    near = F.sequence(
        F.greatest(F.lit(0), F.floor(at - reach / step) - 1).cast("int"), (F.floor(at + reach / step) + 1).cast("int")
    )
    x = lo + F.col("i") * step
    return (
        points.select("lx", F.explode(near).alias("i"))
        .withColumn("x", x)
        .filter((F.col("x") < hi) & (F.col("lx") >= F.col("x") - reach) & (F.col("lx") < F.col("x") + reach))
        .groupBy("i", "x").agg(F.count("*").alias("genes"))
    )


def curve_distance(points: DataFrame, slope: float, intercept: float, step: float = 0.001, reach: float = 0.2) -> DataFrame:
    """Signed distance of each gene to the nearest grid point of the fitted line.

    The squared distance is a parabola in the grid position, so the nearest grid point in
    reach is next to its vertex: no join with the grid is needed.
    """
    edges = points.agg(F.struct(F.min("lx").alias("lo"), F.max("lx").alias("hi"))).scalar()
    lo, hi = edges.getField("lo"), edges.getField("hi")
    last = F.greatest(F.lit(0), F.ceil((hi - lo) / step) - 1)
    vertex = (F.col("lx") + slope * (F.col("ly") - intercept)) / (1 + slope * slope)
    first_ok = F.greatest(F.lit(0), F.ceil((F.col("lx") - reach - lo) / step))
    last_ok = F.least(last, F.ceil((F.col("lx") + reach - lo) / step) - 1)

    def clamp(i):
        return F.greatest(first_ok, F.least(last_ok, i))

    def gap(i):
        g = lo + i * step
        return F.sqrt(F.pow(g - F.col("lx"), 2) + F.pow(slope * g + intercept - F.col("ly"), 2))

    below = clamp(F.floor((vertex - lo) / step))
    above = clamp(F.floor((vertex - lo) / step) + 1)
    best = F.when(gap(above) < gap(below), above).otherwise(below)
    grid_x = lo + best * step
    fitted = slope * grid_x + intercept
    up = F.when(grid_x > F.col("lx"), fitted <= F.col("ly")).otherwise(fitted < F.col("ly"))
    return points.select("gene", "lx", "ly", F.when(up, gap(best)).otherwise(-gap(best)).alias("dist"))


def kde_mode(df: DataFrame, col: str, cells_per_bandwidth: int = 32) -> float:
    """The value of ``col`` nearest to the peak of its Gaussian density (Scott bandwidth).

    The density is the convolution of a histogram 32 cells per bandwidth wide; the
    histogram has a few thousand rows whatever the number of genes.
    """
    n, sd, lo, hi = df.agg(F.count(col), F.stddev_samp(col), F.min(col), F.max(col)).first()
    if not sd or hi <= lo:
        return float(lo)
    cell = sd * n ** (-0.2) / cells_per_bandwidth
    cell = max(cell, (hi - lo) / 2**17)
    hist = df.groupBy(F.floor((F.col(col) - lo) / cell).alias("b")).count().collect()
    width = int((hi - lo) / cell) + 1
    mass = np.zeros(width + 1)
    for row in hist:
        mass[min(int(row["b"]), width)] += row["count"]
    half = int(6 * sd * n ** (-0.2) / cell) + 1
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) * cell / (sd * n ** (-0.2))) ** 2)
    size = 1 << (len(mass) + len(kernel)).bit_length()
    density = np.fft.irfft(np.fft.rfft(mass, size) * np.fft.rfft(kernel, size), size)[half: half + len(mass)]
    peak = lo + (int(np.argmax(density)) + 0.5) * cell
    return float(df.agg(F.min_by(col, F.struct(F.abs(F.col(col) - peak), F.col(col)))).first()[0])


def chen(m: Matrix, n: int = 1000) -> DataFrame:
    """Genes above the log-log line of the coefficient of variation on the mean.

    The null spread is the left half of the distance distribution, mirrored at its mode.
    """
    points = cut_lineage(mean_cv_points(m))
    slope, intercept = points.agg(F.regr_slope("ly", "lx"), F.regr_intercept("ly", "lx")).first()
    away = curve_distance(points, slope, intercept).withColumn("dist", F.col("dist") * math.log2(10))
    away = cut_lineage(away)
    mode = kde_mode(away, "dist")
    left = F.col("dist") - mode
    count, total, squares = away.agg(
        F.count_if(left <= 0) + F.count_if(left < 0) + 1,
        F.sum(F.when(left < 0, left - left).otherwise(0.0)) + mode,
        2 * F.sum(F.when(left < 0, left * left).otherwise(0.0)) + mode * mode,
    ).first()
    centre = total / count
    sd = math.sqrt(max(squares / count - centre * centre, 1e-300))
    return significant(away.withColumn("p_val", normal_sf((F.col("dist") - centre) / sd)), n)


def dropout_moments(m: Matrix) -> DataFrame:
    """Dropout rate and mean expression with standard errors, on the linear scale."""
    lin = unlog(m)
    stored = lin.expr.groupBy("gene").agg(
        F.count_if(F.col("value") > 0).alias("z"), F.sum("value").alias("s1"), F.sum(F.col("value") ** 2).alias("s2")
    ).withColumn("n", lin.n_cells())
    p, s = 1 - F.col("z") / F.col("n"), F.col("s1") / F.col("n")
    return stored.select(
        "gene", p.alias("p"), F.sqrt(p * (1 - p) / F.col("n")).alias("p_err"), s.alias("s"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - s * s) / F.col("n")).alias("s_err"),
    )


def michaelis_constant(genes: DataFrame, rounds: int = 11, grid: int = 17) -> float:
    """The K that minimises ``sum (p - 1 + s / (K + s))^2``.

    With the error variance profiled out this is the maximum likelihood estimate. Every
    round evaluates a whole grid of K in one pass and narrows to the cells next to the best.
    """
    low, high = -7.0, 7.0
    for _ in range(rounds):
        ks = np.logspace(low, high, grid)
        gaps = [F.col("p") - float(k) / (float(k) + F.col("s")) for k in ks]
        losses = genes.agg(*[F.sum(g * g) for g in gaps]).first()
        best = int(np.argmin(np.array(losses, float)))
        step = (high - low) / (grid - 1)
        low, high = low + (best - 1) * step, low + (best + 1) * step
    return float(10 ** ((low + high) / 2))


def m3drop(m: Matrix, n: int = 1000) -> DataFrame:
    """Genes with more dropouts than the Michaelis-Menten curve allows (full-length reads)."""
    genes = cut_lineage(dropout_moments(m))
    k = michaelis_constant(genes)
    floor = genes.agg((F.min(F.when(F.col("p") > 0, F.col("p"))) / 2).alias("f")).scalar()
    base = genes.withColumn("always", F.col("p") == 0).withColumn(
        "p", F.when(F.col("p") == 0, floor).otherwise(F.col("p"))
    )
    k_gene = F.col("p") * F.col("s") / (1 - F.col("p"))
    rel = F.sqrt(F.pow(F.col("s_err") / F.col("s"), 2) + F.pow(F.col("p_err") / F.col("p"), 2))
    scored = base.filter((F.col("p") < 1) & (F.col("s") > 0)).withColumn("k_gene", k_gene).withColumn("k_err", F.abs("k_gene") * rel)
    log_k, rest = F.ln("k_gene"), F.col("k_gene") - F.col("k_err")
    scored = scored.withColumn("log_k", log_k).withColumn(
        "log_err", F.when(rest <= 0, F.lit(1e10)).otherwise(F.abs(F.ln(rest) - log_k))
    )
    spread = scored.agg((F.stddev_pop("log_k") / F.sqrt(F.count("*"))).alias("e")).scalar()
    z = (F.col("log_k") - math.log(k)) / F.sqrt(F.pow("log_err", 2) + F.pow(spread, 2))
    tested = scored.withColumn("z", z).withColumn("p_val", F.when(F.col("always"), 1.0).otherwise(normal_sf("z")))
    return significant(tested.select("gene", "p", "s", "k_gene", "z", "p_val"), n)


def umi_moments(m: Matrix) -> DataFrame:
    """Per gene of a raw count matrix: totals, dropouts and the size of the negative binomial.

    The variance around the depth-scaled mean expands into sparse sums, so only stored
    entries are read.
    """
    cell = m.expr.groupBy("cell").agg(F.sum("value").alias("t"))
    depth = cell.agg(
        F.struct(F.count("*").alias("nc"), F.sum("t").alias("total"), F.sum(F.col("t") * F.col("t")).alias("t2"))
    ).scalar()
    nc, total, t2 = (depth.getField(f) for f in ("nc", "total", "t2"))
    gene = m.expr.join(cell, "cell").groupBy("gene").agg(
        F.sum("value").alias("tj"), F.sum(F.col("value") ** 2).alias("x2"),
        F.sum(F.col("value") * F.col("t")).alias("xt"), F.count_if(F.col("value") > 0).alias("n_exp"),
    )
    share = F.col("tj") / F.col("total")
    var = (F.col("x2") - 2 * share * F.col("xt") + share * share * F.col("t2")) / F.col("nc")
    excess = (F.col("nc") - 1) * F.col("var_pop") - F.col("tj")
    size = F.col("tj") ** 2 * (F.col("t2") / F.col("total") ** 2) / F.nullif(excess, F.lit(0.0))
    return (
        gene.withColumn("nc", nc).withColumn("total", total).withColumn("t2", t2)
        .withColumn("var_pop", var).withColumn("raw_size", size)
        .select("gene", "tj", "nc", "total", "var_pop", "raw_size", (F.col("nc") - F.col("n_exp")).alias("dropouts"))
    )


def expected_dropout(genes: DataFrame, cells: DataFrame, block: int = 4096) -> DataFrame:
    """``gene, p_sum, v_sum``: sums over cells of ``p`` and ``p (1 - p)``.

    ``p = (1 + rate * t / size)^-size`` depends on a cell only through its total ``t``, so
    cells are first counted by total. Totals and genes are cut into blocks of about
    ``block`` rows; a task holds one block of each and returns one row per gene.
    ``genes`` has ``gene, rate, size``; ``cells`` has ``t``.
    """
    hist = cut_lineage(cells.groupBy("t").agg(F.count("*").alias("c")))
    n_t = max(1, -(-hist.count() // block))
    n_g = max(1, -(-genes.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    totals = hist.withColumn("_b", F.pmod(F.xxhash64("t"), F.lit(n_t)).cast("int")).withColumn("_s", every(n_g))
    rows = genes.withColumn("_s", F.pmod(F.xxhash64("gene"), F.lit(n_g)).cast("int")).withColumn("_b", every(n_t))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rate, size = left["rate"].to_numpy(float)[:, None], left["size"].to_numpy(float)[:, None]
        t, c = right["t"].to_numpy(float)[None, :], right["c"].to_numpy(float)
        p_sum, v_sum = np.empty(len(left)), np.empty(len(left))
        for lo in range(0, len(left), 256):
            at = slice(lo, lo + 256)
            p = np.exp(-size[at] * np.log1p(rate[at] * t / size[at]))
            p_sum[at], v_sum[at] = p @ c, (p * (1 - p)) @ c
        return pd.DataFrame({"gene": left["gene"], "p": p_sum, "v": v_sum})

    found = rows.groupBy("_b", "_s").cogroup(totals.groupBy("_b", "_s")).applyInPandas(sums, "gene string, p double, v double")
    return found.groupBy("gene").agg(F.sum("p").alias("p_sum"), F.sum("v").alias("v_sum"))


def m3drop_umi(m: Matrix, n: int = 1000) -> DataFrame:
    """Genes with more dropouts than the depth-adjusted negative binomial allows (raw counts)."""
    genes = cut_lineage(umi_moments(m))
    largest = genes.agg(F.max("raw_size")).first()[0]
    size = F.when(F.col("raw_size") < 0, 10 * largest).otherwise(F.col("raw_size"))
    genes = genes.withColumn("size", F.greatest(F.lit(1e-10), size)).withColumn("log_mean", F.ln(F.col("tj") / F.col("nc")))
    top, high = genes.agg(F.max("size"), F.count_if(F.log2(F.col("tj") / F.col("nc")) > 4)).first()
    usable = (F.col("size") < top) & (F.col("tj") > 0)
    if high > 2000:
        usable = usable & (F.log2(F.col("tj") / F.col("nc")) > 4)
    slope, intercept = genes.filter(usable).agg(
        F.regr_slope(F.ln("size"), F.col("log_mean")), F.regr_intercept(F.ln("size"), F.col("log_mean"))
    ).first()
    trend = genes.withColumn("size", F.exp(intercept + slope * F.col("log_mean"))).withColumn("rate", F.col("tj") / F.col("total"))
    cells = m.expr.groupBy("cell").agg(F.sum("value").alias("t"))
    joined = trend.join(expected_dropout(trend.select("gene", "rate", "size"), cells), "gene")
    expected = F.greatest(F.col("p_sum") / F.col("nc"), 1 / F.col("nc"))
    observed = F.col("dropouts") / F.col("nc")
    error = F.sqrt(F.col("v_sum") / F.col("nc") ** 2 + observed * (1 - observed) / F.col("nc"))
    tested = joined.select(
        "gene", observed.alias("observed"), expected.alias("expected"), ((observed - expected) / F.nullif(error, F.lit(0.0))).alias("z")
    )
    return significant(tested.withColumn("p_val", normal_sf("z")), n)
