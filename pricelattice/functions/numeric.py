"""Numeric column expressions and the Student-t tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, WindowSpec, functions as F, types as T

EARTH_RADIUS_KM = 6371.0088
MAD_SCALE = 0.67448975
# fixed labels, upper bounds exclusive
DISTANCE_BINS = [(100.0, "0–100"), (250.0, "100–250"), (500.0, "250–500"), (1000.0, "500–1000")]
LAST_BIN = ">1000"


def corr_safe(x: Column, y: Column) -> Column:
    """Sample correlation, NULL (not an error) when either side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def distance_bin(km: Column) -> Column:
    out = None
    for bound, label in DISTANCE_BINS:
        out = F.when(km < bound, label) if out is None else out.when(km < bound, label)
    return F.when(km.isNotNull(), out.otherwise(LAST_BIN))


def grid_index(value: Column, step: float) -> Column:
    """Integer cell number, ties to even; joins use this and never the floating cell centre."""
    return F.bround(value / F.lit(step), 0).cast("int")


def grid_centre(index: Column, step: float) -> Column:
    return F.round(index * F.lit(step), 4)


def power_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    return grid_centre(grid_index(lat, 0.5), 0.5), grid_centre(grid_index(lon, 0.625), 0.625)


def in_coordinate_range(lat: Column, lon: Column) -> Column:
    return lat.between(6, 38) & lon.between(67, 98)


def pct_from_log(r: Column) -> Column:
    return F.expm1(r) * 100


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def robust_z(x: Column, med: Column, mad: Column, sd: Column) -> Column:
    """z from precomputed median, MAD and population sd of the group.

    No spread at all gives 0 for every row, rows without a value included; a group without any value gives NULL.
    """
    by_sd = F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((x - med) / sd)
    return F.when(med.isNull(), None).when(F.coalesce(mad, F.lit(0.0)) == 0, by_sd).otherwise(MAD_SCALE * (x - med) / mad)


def with_robust_z(df, value: str, out: str, part: WindowSpec):
    """Add ``out`` = robust z of ``value`` within ``part`` (a bounded partition: one market's days)."""
    med, mad, sd = f"__med_{out}", f"__mad_{out}", f"__sd_{out}"
    x = F.col(value)
    df = df.withColumn(med, median(x).over(part)).withColumn(sd, F.stddev_pop(x).over(part))
    df = df.withColumn(mad, median(F.abs(x - F.col(med))).over(part))
    return df.withColumn(out, robust_z(x, F.col(med), F.col(mad), F.col(sd))).drop(med, mad, sd)


# ---- Student-t two-sided tail: regularised incomplete beta by continued fraction ----
def _lgamma(x):
    return np.array([math.lgamma(v) for v in x])


def _beta_fraction(a, b, x):
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def t_two_sided(t, dof):
    """P(|T| >= |t|) for arrays of t and degrees of freedom; NaN where undefined."""
    t = np.asarray(t, dtype=float)
    nu = np.asarray(dof, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(nu) & (nu > 0) & ~np.isnan(t)
    inf = ok & np.isinf(t)
    out[inf] = 0.0
    ok &= ~np.isinf(t)
    if not ok.any():
        return out
    tt, n = np.abs(t[ok]), nu[ok]
    a, b = n / 2.0, np.full(n.shape, 0.5)
    x = n / (n + tt * tt)
    y = tt * tt / (n + tt * tt)
    log_front = _lgamma(a + b) - _lgamma(a) - _lgamma(b)
    with np.errstate(divide="ignore"):
        log_front = log_front + a * np.log(x) + b * np.log(y)
    front = np.exp(log_front)
    low = x < (a + 1.0) / (a + b + 2.0)
    res = np.empty_like(x)
    if low.any():
        res[low] = front[low] * _beta_fraction(a[low], b[low], x[low]) / a[low]
    if (~low).any():
        k = ~low
        res[k] = 1.0 - front[k] * _beta_fraction(b[k], a[k], y[k]) / b[k]
    out[ok] = np.clip(res, 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    p = pd.Series(t_two_sided(t.to_numpy(dtype=float), dof.to_numpy(dtype=float)), index=t.index)
    return p.astype(object).where(p.notna(), None)


def t_pvalue(t: Column, dof: Column) -> Column:
    """Arrow-batched tail; meant for result tables (one row per pair or group), not for raw rows."""
    return _t_tail(t.cast("double"), dof.cast("double"))


def corr_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation; |r| = 1 gives infinity."""
    one = F.lit(1.0) - r * r
    return F.when(one <= 0, F.signum(r) * F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / one))
