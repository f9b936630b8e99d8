"""Evidence weights: decay by rank, shrinkage, Beta quantiles (a power series and Newton steps, vectorised)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def decay(rank_gap: Column, half_life: float) -> Column:
    """What is left of evidence after rank_gap more opportunities."""
    return F.pow(F.lit(0.5), rank_gap / F.lit(float(half_life)))


def shrink(num: Column, den: Column, prior: Column, strength: float) -> Column:
    """A rate drawn to its prior, as if the prior had been seen `strength` times."""
    return (num + strength * prior) / (den + strength)


_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x):
    return np.asarray(_LGAMMA(np.asarray(x, float)), float)


def _parameters(*of) -> list[np.ndarray]:
    x, a, b = np.broadcast_arrays(*[np.asarray(v, float) for v in of])
    if not (np.all(a > 0) and np.all(b > 0)):
        raise ValueError("the Beta distribution's parameters must be positive")
    return [np.array(v).reshape(-1) for v in (x, a, b)] + [x.shape]


def _log_density(x, a, b):
    """Logarithm of the Beta density, for x strictly between 0 and 1."""
    return lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)


def _lower(x, a, b):
    """The regularised incomplete beta function where x is at most about the mean: its power series of positive terms,
    x**a (1-x)**b / (a B(a, b)) * (1 + (a+b)/(a+1) x + (a+b)(a+b+1)/((a+1)(a+2)) x**2 + ...), summed until terms fall below the
    last digit of each sum. Elements whose sum is complete drop out."""
    total, term, open_, n = np.ones_like(x), np.ones_like(x), np.arange(len(x)), 0
    while len(open_):
        term[open_] *= x[open_] * (a[open_] + b[open_] + n) / (a[open_] + 1 + n)
        total[open_] += term[open_]
        n += 1
        open_ = open_[term[open_] > 1e-17 * total[open_]]
    return np.exp(_log_density(x, a, b)) * x * (1 - x) / a * total


def incomplete_beta(x, a, b):
    """Regularised incomplete beta function, elementwise."""
    x, a, b, shape = _parameters(x, a, b)
    out = np.where(x >= 1, 1.0, 0.0)
    inner = (x > 0) & (x < 1)
    near = inner & (x <= (a + 1) / (a + b + 2))
    far = inner & ~near
    out[near] = _lower(x[near], a[near], b[near])
    out[far] = 1 - _lower(1 - x[far], b[far], a[far])
    return out.reshape(shape) if shape else out[0]


def beta_quantile(p, a, b):
    """The x with incomplete_beta(x, a, b) = p: Newton steps from the mean, kept between the nearest points known to lie below and
    above, or halving those where a step would leave them."""
    p, a, b, shape = _parameters(p, a, b)
    x, low, high = a / (a + b), np.zeros_like(p), np.ones_like(p)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    for _ in range(200):
        if not len(open_):
            break
        at, pa, pb = x[open_], a[open_], b[open_]
        off = incomplete_beta(at, pa, pb) - p[open_]
        low[open_], high[open_] = np.where(off < 0, at, low[open_]), np.where(off < 0, high[open_], at)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            new = at - off / np.exp(_log_density(at, pa, pb))
        inside = (new > low[open_]) & (new < high[open_])
        new = np.where(inside, new, (low[open_] + high[open_]) / 2)
        done = (np.abs(new - at) <= np.maximum(np.where(inside, 1e-12, 1e-15) * at, 1e-18)) | (off == 0)
        x[open_] = np.where(off == 0, at, new)
        open_ = open_[~done]
    x = np.where(p <= 0, 0.0, np.where(p >= 1, 1.0, x))
    return x.reshape(shape) if shape else x[0]


@pandas_udf(DoubleType())
def beta_quantile_udf(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(p.to_numpy(), a.to_numpy(), b.to_numpy()))


@pandas_udf(DoubleType())
def miss_run_udf(k: pd.Series, n: pd.Series, run: pd.Series) -> pd.Series:
    """Chance of `run` misses in a row under the Jeffreys posterior of k hits in n."""
    a, b, r = k.to_numpy() + 0.5, (n - k).to_numpy() + 0.5, run.to_numpy()
    return pd.Series(np.exp(lgamma(b + r) - lgamma(b) + lgamma(a + b) - lgamma(a + b + r)))
