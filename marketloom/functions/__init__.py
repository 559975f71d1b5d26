"""Column helpers shared by the operators: guarded arithmetic, normal law, rounding, fixed numbers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F, types as T

ANN = 252  # trading days per year
RF_DAILY = 0.05 / ANN  # daily risk-free rate used by every Sharpe figure

_N = NormalDist()


def z_quantile(p: float) -> float:
    """Normal quantile of a plan-time constant."""
    return _N.inv_cdf(p)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def safe_div(a, b, fallback=0.0) -> Column:
    """a / b where |b| > 1e-12, else the fallback (ANSI mode raises on a zero divisor)."""
    a, b = c(a), c(b)
    return F.when(F.abs(b) > 1e-12, a / b).otherwise(lit(fallback))


def ratio(a, b) -> Column:
    """a / b, null for a zero or null divisor."""
    a, b = c(a), c(b)
    return F.when(b != 0, a / b)


def clamp(x, lo, hi) -> Column:
    x = c(x)
    return F.when(x.isNotNull(), F.greatest(lit(lo), F.least(lit(hi), x)))


def case(*pairs, default=None) -> Column:
    """case((cond, value), ..., default=value): a WHEN chain read top to bottom."""
    out = F.when(pairs[0][0], lit(pairs[0][1]))
    for cond, val in pairs[1:]:
        out = out.when(cond, lit(val))
    return out if default is None else out.otherwise(lit(default))


def flag(cond) -> Column:
    """1.0 where the condition holds, 0.0 where it is false or null."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def is_true(cond) -> Column:
    return F.coalesce(cond, F.lit(False))


# Rational approximation of the normal distribution (Hart 1968, double precision).
PHI_NUM = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376]
PHI_DEN = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def _horner(coefs, x):
    out = F.lit(coefs[0])
    for k in coefs[1:]:
        out = out * x + F.lit(k)
    return out


def phi(x) -> Column:
    """Standard normal distribution function; beyond |x| = 7 the tail is below 1e-11 and rounds to 0 or 1."""
    x = c(x)
    a = F.least(F.abs(x), F.lit(7.0))
    tail = F.exp(-a * a / 2) * _horner(PHI_NUM, a) / _horner(PHI_DEN, a)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def t_cdf(t, nu) -> Column:
    """Student t distribution function through the normal transform (error below 1e-4 for nu > 30)."""
    t, nu = c(t), c(nu)
    return phi(t * (1 - 1 / (4 * nu)) / F.sqrt(1 + t * t / (2 * nu)))


def t_quantile(p: float, nu) -> Column:
    """Student t quantile, second-order expansion in 1/nu around the normal quantile."""
    z, nu = z_quantile(p), c(nu)
    return F.lit(z) + F.lit((z**3 + z) / 4) / nu + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (nu * nu)


def sanitize_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every double column, inside arrays, maps and structs too."""

    def fix(col: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
        if isinstance(t, T.ArrayType):
            return F.transform(col, lambda x: fix(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(col, lambda _, v: fix(v, t.valueType))
        if isinstance(t, T.StructType):
            return F.when(col.isNotNull(), F.struct(*[fix(col[f.name], f.dataType).alias(f.name) for f in t.fields]))
        return col

    return df.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (reports round at output only) and turn -0.0 into 0.0."""

    def fix(f):
        if not isinstance(f.dataType, T.DoubleType):
            return F.col(f.name)
        r = F.round(F.col(f.name), places)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name)

    return df.select(*[fix(f) for f in df.schema.fields])
