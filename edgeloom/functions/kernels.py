"""Kernels as column expressions of a distance and a bandwidth."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(d: Column, h: Column) -> Column:
    """|d| / h clipped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(d) / h))


KERNELS = {
    "triangular": lambda d, h: 1 - _share(d, h),
    "parabolic": lambda d, h: 0.75 * (1 - _share(d, h) * _share(d, h)),
    "gaussian": lambda d, h: F.exp(-((d / h) * (d / h)) / 2) / math.sqrt(2 * math.pi),
    "bisquare": lambda d, h: (15 / 16) * F.pow(1 - _share(d, h) * _share(d, h), F.lit(2)),
    "tricube": lambda d, h: (70 / 81) * F.pow(1 - F.pow(_share(d, h), F.lit(3)), F.lit(3)),
    "cosine": lambda d, h: (math.pi / 4) * F.cos((math.pi / 2) * _share(d, h)),
    "exponential": lambda d, h: F.exp(-(d / h)),
    "boxcar": lambda d, h: F.when(d < h, 1.0).otherwise(0.0),
    "identity": lambda d, h: d,
}
KERNELS["epanechnikov"] = KERNELS["parabolic"]
KERNELS["uniform"] = KERNELS["boxcar"]


def kernel(distance: Column, bandwidth, name="gaussian", taper: bool | float = True, decay: bool = False) -> Column:
    """Kernel value. taper: zero beyond the bandwidth (True) or beyond a distance (a number). decay: divided by the
    value at distance 0. ``name`` may be a function of two columns; None is the identity."""
    h = bandwidth if isinstance(bandwidth, Column) else F.lit(float(bandwidth))
    if callable(name):
        f = name
    elif (name or "identity") in KERNELS:
        f = KERNELS[name or "identity"]
    else:
        raise ValueError(f"unknown kernel {name!r}; one of {sorted(KERNELS)}")
    value = f(distance, h)
    if decay:
        value = value / f(F.lit(0.0), h)
    if taper is True:
        value = F.when(distance > h, 0.0).otherwise(value)
    elif taper is not False:
        value = F.when(distance > F.lit(float(taper)), 0.0).otherwise(value)
    return value.cast("double")
