"""Generalised linear models and elastic nets from Spark-side sufficient statistics.

The data stay in a DataFrame with one column per predictor. Each step is one aggregation
that returns p x p sums; only those reach the driver.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "_one"


@dataclass(frozen=True)
class Family:
    """Inverse link, its derivative, variance and unit deviance as column functions."""

    name: str
    inv_link: object
    d_inv_link: object
    variance: object
    deviance: object
    has_dispersion: bool
    start: object = None


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def _logistic(nu: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-nu))


def _poisson_dev(y: Column, mu: Column) -> Column:
    return 2.0 * (mu - y + _xlogy(y, y / mu))


def _gamma_dev(y: Column, mu: Column) -> Column:
    return 2.0 * ((y - mu) / mu - F.ln(y / mu))


def _bernoulli_dev(y: Column, mu: Column) -> Column:
    return -2.0 * (_xlogy(y, mu) + _xlogy(1.0 - y, 1.0 - mu))


GAUSSIAN = Family("gaussian", lambda nu: nu, lambda nu, mu: F.lit(1.0), lambda mu: F.lit(1.0),
                  lambda y, mu: (y - mu) * (y - mu), True, lambda mean: mean)
BERNOULLI = Family("bernoulli", _logistic, lambda nu, mu: mu * (1.0 - mu), lambda mu: mu * (1.0 - mu),
                   _bernoulli_dev, False, lambda mean: math.log(mean / (1 - mean)))
POISSON = Family("poisson", F.exp, lambda nu, mu: mu, lambda mu: mu, _poisson_dev, False, math.log)
QUASI_POISSON = Family("quasipoisson", F.exp, lambda nu, mu: mu, lambda mu: mu, _poisson_dev, True, math.log)
GAMMA = Family("gamma", F.exp, lambda nu, mu: mu, lambda mu: mu * mu, _gamma_dev, True, math.log)
EXPONENTIAL = Family("exponential", F.exp, lambda nu, mu: mu, lambda mu: mu * mu, _gamma_dev, False, math.log)
# the maximum likelihood fit of a gamma mean that is linear in the predictors
GAMMA_IDENTITY = Family("gamma_identity", lambda nu: nu, lambda nu, mu: F.lit(1.0), lambda mu: mu * mu,
                        _gamma_dev, True, lambda mean: mean)
# compatibility: identity mean with the derivative of the log link, solving sum x (y - mu) / mu = 0
GAMMA_MIXED_LINK = Family("gamma_mixed_link", lambda nu: nu, lambda nu, mu: mu, lambda mu: mu * mu,
                          _gamma_dev, True, lambda mean: mean)
FAMILIES = {f.name: f for f in (GAUSSIAN, BERNOULLI, POISSON, QUASI_POISSON, GAMMA, EXPONENTIAL,
                                GAMMA_IDENTITY, GAMMA_MIXED_LINK)}


class GlmInputError(ValueError):
    """Predictors, label, weights or offset cannot be used."""


def check_inputs(df: DataFrame, predictors: list[str], label: str) -> None:
    if not predictors:
        raise GlmInputError("no predictors given")
    missing = [c for c in (*predictors, label) if c not in df.columns]
    if missing:
        raise GlmInputError(f"missing columns: {missing}")


def _dot(coef: np.ndarray, cols: list[Column]) -> Column:
    total = F.lit(0.0)
    for b, c in zip(coef, cols):
        total = total + F.lit(float(b)) * c
    return total


def gram_sums(df: DataFrame, xs: list[Column], y: Column, w: Column, extra: list[Column] | None = None):
    """``X'WX``, ``X'Wy`` and further sums in one pass."""
    p = len(xs)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(w * xs[i] * xs[j]) for i, j in cells] + [F.sum(w * x * y) for x in xs] + list(extra or [])
    row = df.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
    xtx = np.zeros((p, p))
    for k, (i, j) in enumerate(cells):
        xtx[i, j] = xtx[j, i] = row[k]
    at = len(cells)
    return xtx, np.array(row[at:at + p], float), list(row[at + p:])


@dataclass
class GlmFit:
    family: Family
    predictors: list[str]
    coef: np.ndarray
    deviance: float
    n: float
    information: np.ndarray
    alpha: float = 0.0
    iterations: int = 0
    converged: bool = True
    offset: str | None = None

    @property
    def dispersion(self) -> float:
        return self.deviance / (self.n - len(self.coef)) if self.family.has_dispersion else 1.0

    @property
    def covariance(self) -> np.ndarray:
        return self.dispersion * np.linalg.inv(self.information)

    @property
    def standard_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    @property
    def p_values(self) -> np.ndarray:
        if self.alpha:
            raise GlmInputError("p-values are not defined for a penalised fit")
        return np.array([math.erfc(abs(z) / math.sqrt(2)) for z in self.coef / self.standard_errors])

    def mean(self) -> Column:
        nu = _dot(self.coef, _columns(self.predictors))
        return self.family.inv_link(nu + F.col(self.offset) if self.offset else nu)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.mean())

    def score(self, df: DataFrame, label: str) -> float:
        """Total deviance of the model on ``df``."""
        return df.agg(F.sum(self.family.deviance(F.col(label), self.mean()))).first()[0]

    def summary(self) -> list[dict]:
        return [
            {"name": "intercept" if n == INTERCEPT else n, "estimate": float(b), "std_error": float(s)}
            for n, b, s in zip([INTERCEPT, *self.predictors], self.coef, self.standard_errors)
        ]


def _columns(predictors: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in predictors]]


def _in_range(family: Family, mu: Column) -> Column:
    return mu > 0 if family.name.startswith("gamma") else F.lit(True)


def fit_glm(
    df: DataFrame, predictors: list[str], label: str, family: Family = GAUSSIAN, alpha: float = 0.0,
    weight: str | None = None, offset: str | None = None, max_iter: int = 100, tol: float = 1e-8,
    start: np.ndarray | None = None,
) -> GlmFit:
    """Fisher scoring with an optional ridge penalty ``alpha / 2 * |beta|^2`` (intercept free)."""
    check_inputs(df, predictors, label)
    xs, y = _columns(predictors), F.col(label).cast("double")
    sw = F.col(weight).cast("double") if weight else F.lit(1.0)
    total, mean = df.agg(F.sum(sw), F.sum(sw * y) / F.sum(sw)).first()
    if not total:
        raise GlmInputError("no rows to fit")
    p = len(xs)
    if start is None:
        coef = np.zeros(p)
        coef[0] = family.start(mean)
    else:
        coef = np.array(start, float)
    penalty = np.diag([0.0] + [alpha] * (p - 1))
    previous, converged, sound = math.inf, False, None
    for step in range(1, max_iter + 1):
        nu = _dot(coef, xs) + (F.col(offset) if offset else F.lit(0.0))
        mu = family.inv_link(nu)
        dmu, var = family.d_inv_link(nu, mu), family.variance(mu)
        # rows whose mean lies outside the family's range have no deviance
        dev = F.when(_in_range(family, mu), sw * family.deviance(y, mu))
        usable = F.when(_in_range(family, mu), dmu * dmu / var)
        info, score, (deviance, outside) = gram_sums(
            df, xs, F.when(_in_range(family, mu), (y - mu) / dmu), sw * usable, [F.sum(dev), F.count_if(dev.isNull())]
        )
        if outside and sound is not None:
            coef = (coef + sound) / 2.0
            continue
        sound = coef
        objective = deviance + alpha * float(np.sum(coef[1:] ** 2))
        if abs(objective - previous) <= tol * (abs(objective) + tol):
            converged = True
            break
        previous = objective
        coef = coef + np.linalg.solve(info + penalty, score - penalty @ coef)
    if not converged:
        warnings.warn(f"the fit has not converged in {max_iter} steps", RuntimeWarning, stacklevel=2)
    return GlmFit(family, list(predictors), coef, deviance, total, info, alpha, step, converged, offset)


def soft_threshold(z: float, gamma: float) -> float:
    return math.copysign(max(abs(z) - gamma, 0.0), z)


def coordinate_descent(
    xtx: np.ndarray, xty: np.ndarray, lam: float, alpha: float, start: np.ndarray | None = None,
    max_iter: int = 10_000, tol: float = 1e-10,
) -> np.ndarray:
    """Elastic-net coefficients from weighted sums by covariance updates (Friedman et al. 2010).

    Column 0 is the unpenalised intercept.
    """
    beta = np.zeros(len(xty)) if start is None else np.array(start, float)
    for _ in range(max_iter):
        largest = 0.0
        for j in range(len(beta)):
            rho = xty[j] - xtx[j] @ beta + xtx[j, j] * beta[j]
            if j == 0:
                new = rho / xtx[0, 0]
            else:
                new = soft_threshold(rho, lam * alpha) / (xtx[j, j] + lam * (1 - alpha))
            largest, beta[j] = max(largest, abs(new - beta[j])), new
        if largest <= tol * max(1.0, float(np.max(np.abs(beta)))):
            break
    return beta


def elastic_net(
    df: DataFrame, predictors: list[str], label: str, lam: float, alpha: float,
    weight: str | None = None, offset: str | None = None,
) -> np.ndarray:
    """Minimise ``1/2 sum w (y - xb)^2 + lam (alpha |b|_1 + (1 - alpha)/2 |b|^2)``, ``w`` = 1/n by default."""
    return elastic_net_path(df, predictors, label, [lam], alpha, weight, offset)[0]


def elastic_net_path(
    df: DataFrame, predictors: list[str], label: str, lambdas: list[float], alpha: float,
    weight: str | None = None, offset: str | None = None,
) -> list[np.ndarray]:
    """All penalties from one pass over the data, each warm-started by the one before."""
    check_inputs(df, predictors, label)
    xs, y = _columns(predictors), F.col(label).cast("double")
    if offset:
        y = y - F.col(offset)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    xtx, xty, _ = gram_sums(df, xs, y, w)
    scale = 1.0 if weight else 1.0 / xtx[0, 0]
    path: list[np.ndarray] = []
    for lam in lambdas:
        path.append(coordinate_descent(xtx * scale, xty * scale, lam, alpha, path[-1] if path else None))
    return path


def glm_net_path(
    df: DataFrame, predictors: list[str], label: str, family: Family, lambdas: list[float], alpha: float,
    max_iter: int = 25, tol: float = 1e-8,
) -> list[np.ndarray]:
    """Regularisation path of a GLM: weighted elastic nets on quadratic approximations."""
    check_inputs(df, predictors, label)
    xs, y = _columns(predictors), F.col(label).cast("double")
    n, mean = df.agg(F.count("*"), F.avg(y)).first()
    beta = np.zeros(len(xs))
    beta[0] = family.start(mean)
    path = []
    for lam in lambdas:
        for _ in range(max_iter):
            nu = _dot(beta, xs)
            mu = family.inv_link(nu)
            dmu, var = family.d_inv_link(nu, mu), family.variance(mu)
            xtx, xty, _ = gram_sums(df, xs, nu + (y - mu) / dmu, dmu * dmu / var)
            new = coordinate_descent(xtx / n, xty / n, lam, alpha, beta)
            change, beta = float(np.max(np.abs(new - beta))), new
            if change <= tol * max(1.0, float(np.max(np.abs(beta)))):
                break
        else:
            warnings.warn(f"the path has not converged at {lam} in {max_iter} steps", RuntimeWarning, stacklevel=2)
        path.append(beta.copy())
    return path


def simulate(fit: GlmFit, df: DataFrame, n_sim: int, seed: int, name: str = "y_sim") -> DataFrame:
    """``n_sim`` draws of the response for every row, as rows with a ``sim`` number."""
    sims = df.withColumn("_mu", fit.mean()).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sim - 1))))
    return sims.withColumn(name, _draw(fit, F.col("_mu"), seed)).drop("_mu")


def _draw(fit: GlmFit, mu: Column, seed: int) -> Column:
    phi = fit.dispersion
    if fit.family.name == "gaussian":
        return mu + F.randn(seed) * math.sqrt(phi)
    if fit.family.name == "bernoulli":
        return (F.rand(seed) < mu).cast("double")
    if fit.family.name == "exponential":
        return -mu * F.ln(1.0 - F.rand(seed))

    @F.pandas_udf("double")
    def sample(m, u):
        # one generator per batch, seeded by its first row's own uniform, so a re-run task draws the same
        rng = np.random.default_rng((u.to_numpy()[:1] * 2**62).astype(np.int64))
        mean = m.to_numpy(float)
        return pd.Series(rng.poisson(mean) if "poisson" in fit.family.name else rng.gamma(phi, mean / phi), dtype=float)

    return sample(mu, F.rand(seed))


def parametric_bootstrap(
    fit: GlmFit, df: DataFrame, n_sim: int, seed: int
) -> list[GlmFit]:
    """Refit on responses drawn from the fitted model."""
    return [
        fit_glm(simulate(fit, df, 1, seed + i), fit.predictors, "y_sim", fit.family, fit.alpha, offset=fit.offset)
        for i in range(n_sim)
    ]


def nonparametric_bootstrap(
    df: DataFrame, predictors: list[str], label: str, family: Family, n_sim: int, seed: int,
    offset: str | None = None,
) -> list[GlmFit]:
    """Refit on rows drawn with replacement; a draw is a Poisson count per row, used as a weight.

    Poisson counts are the usual distributed form of resampling: no row is moved or copied.
    """
    fits = []
    for i in range(n_sim):
        u = F.rand(seed + i)
        weighted = df.withColumn("_w", _poisson_one(u)).filter("_w > 0")
        fits.append(fit_glm(weighted, predictors, label, family, weight="_w", offset=offset))
    return fits


def _poisson_one(u: Column) -> Column:
    """Inverse of the Poisson(1) distribution function."""
    value, upto, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 20):
        upto += term
        value = F.when(u >= upto, k).otherwise(value)
        term /= k
    return value
