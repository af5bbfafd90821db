"""Statistical column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
#: The rational approximation of the normal distribution function (absolute error under 7.5e-8).
PHI_P, PHI_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_cdf(z: Column | str) -> Column:
    z = col(z)
    t = 1 / (1 + PHI_P * F.abs(z))
    poly = F.lit(0.0)
    for b in reversed(PHI_B):
        poly = t * (F.lit(b) + poly)
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def norm_cdf_sql(z: str) -> str:
    t = f"(1 / (1 + {PHI_P} * abs({z})))"
    poly = "0.0::DOUBLE"
    for b in reversed(PHI_B):
        poly = f"{t} * ({b}::DOUBLE + {poly})"
    upper = f"(exp(-({z}) * ({z}) / 2) / 2.5066282746310002::DOUBLE * ({poly}))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END"


def score_from_z(z: Column | str) -> Column:
    return 100 * norm_cdf(z)


def confidence(n: Column | str, prior: float, agreement: Column | float = 1.0) -> Column:
    n = col(n)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), n / (n + prior) * agreement))


def wilson(p: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a share on an effective sample; (0, 1) without one."""
    p, n = col(p), col(n)
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    empty = n <= 0
    return F.when(empty, 0.0).otherwise((centre - spread) / scale), F.when(empty, 1.0).otherwise((centre + spread) / scale)
