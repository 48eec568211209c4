"""Tails and quantiles of the normal and chi-square distributions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_p(z: float) -> float:
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def two_sided_tail(z):
    """``two_sided_p`` of a column. Spark has no error function; a batch of rows goes to
    Python's."""
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(v) for v in (x.abs() / math.sqrt(2)).to_numpy()])

    return F.when(F.isnan(z), F.lit(math.nan)).when(z.isNotNull(), tail(z))


def chi_square_tail(x: float, df: int) -> float:
    """P(X >= x) for a whole number of degrees of freedom, in closed form."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        total = math.erfc(math.sqrt(half))
        term = math.sqrt(half) * math.exp(-half) / math.gamma(1.5)
        steps = range(3, df + 1, 2)
    else:
        total = math.exp(-half)
        term = half * math.exp(-half)
        steps = range(4, df + 1, 2)
    for k in steps:
        total += term
        term *= half / (k / 2)
    return min(1.0, total)


def round_columns(df, places: int = 6):
    """``df`` with its double columns rounded, without negative zero."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])
