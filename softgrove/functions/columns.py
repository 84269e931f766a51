"""Scalar column functions that Spark lacks, written as JVM-side expressions.

Every numeric routine here is also available as a SQL text template so the
DuckDB oracle evaluates the very same formula (``*_sql`` functions).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Coefficients of algorithm AS 241 (PPND16), Wichura (1988),
# Applied Statistics 37(3):477-484, for the inverse of the normal CDF.
# Each list runs from the constant term upwards.
AS241_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
           1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
           3.3430575583588128105e4, 2.5090809287301226727e3]
AS241_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
           5.2264952788528545610e3]
AS241_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
           3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
           2.27238449892691845833e-2, 7.74545014278341407640e-4]
AS241_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
           1.05075007164441684324e-9]
AS241_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
           2.04426310338993978564e-15]
# Quantile-transform bounds: values this close to the ends of the grid map to
# the ends, and the normal output is clipped at ppf(1e-7 - eps).
BOUNDS_THRESHOLD = 1e-7
# Euler–Mascheroni constant and the asymptotic series of the digamma function.
EULER_GAMMA = 0.5772156649015329
# ---------------------------------------------------------------------------


def _horner_sql(coefs: list[float], r: str) -> str:
    expr = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        expr = f"({expr} * {r} + {c!r})"
    return expr


def _horner_col(coefs: list[float], r: Column) -> Column:
    expr = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        expr = expr * r + F.lit(c)
    return expr


def norm_ppf_sql(p: str) -> str:
    """Inverse standard normal CDF of SQL expression ``p`` (0 < p < 1)."""
    q = f"(({p}) - 0.5)"
    r_c = f"(sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1 - ({p}) END)))"
    central = (f"({q} * {_horner_sql(AS241_A, f'(0.180625 - {q} * {q})')}"
               f" / {_horner_sql(AS241_B, f'(0.180625 - {q} * {q})')})")
    near = f"({_horner_sql(AS241_C, f'({r_c} - 1.6)')} / {_horner_sql(AS241_D, f'({r_c} - 1.6)')})"
    far = f"({_horner_sql(AS241_E, f'({r_c} - 5.0)')} / {_horner_sql(AS241_F, f'({r_c} - 5.0)')})"
    tail = f"(CASE WHEN {r_c} <= 5.0 THEN {near} ELSE {far} END)"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


def norm_ppf(p: Column) -> Column:
    q = p - F.lit(0.5)
    rc = F.sqrt(-F.log(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    rr = F.lit(0.180625) - q * q
    central = q * _horner_col(AS241_A, rr) / _horner_col(AS241_B, rr)
    near = _horner_col(AS241_C, rc - 1.6) / _horner_col(AS241_D, rc - 1.6)
    far = _horner_col(AS241_E, rc - 5.0) / _horner_col(AS241_F, rc - 5.0)
    tail = F.when(rc <= 5.0, near).otherwise(far)
    return F.when(F.abs(q) <= 0.425, central).when(q < 0, -tail).otherwise(tail)


def norm_ppf_scalar(p: float) -> float:
    """Python version of the same routine, used for the clip bounds."""
    q = p - 0.5
    if abs(q) <= 0.425:
        r = 0.180625 - q * q
        return q * _horner_py(AS241_A, r) / _horner_py(AS241_B, r)
    r = math.sqrt(-math.log(p if q < 0 else 1 - p))
    if r <= 5.0:
        v = _horner_py(AS241_C, r - 1.6) / _horner_py(AS241_D, r - 1.6)
    else:
        v = _horner_py(AS241_E, r - 5.0) / _horner_py(AS241_F, r - 5.0)
    return -v if q < 0 else v


def norm_ppf_np(p):
    """Vectorised version of the same routine (numpy arrays, 0 < p < 1)."""
    import numpy as np
    p = np.asarray(p, dtype=np.float64)
    q = p - 0.5
    out = np.empty_like(p)
    c = np.abs(q) <= 0.425
    r = 0.180625 - q[c] * q[c]
    out[c] = q[c] * _horner_py(AS241_A, r) / _horner_py(AS241_B, r)
    t = ~c
    with np.errstate(all="ignore"):
        rt = np.sqrt(-np.log(np.where(q[t] < 0, p[t], 1.0 - p[t])))
    near = rt <= 5.0
    v = np.where(near, _horner_py(AS241_C, rt - 1.6) / _horner_py(AS241_D, rt - 1.6),
                 _horner_py(AS241_E, rt - 5.0) / _horner_py(AS241_F, rt - 5.0))
    out[t] = np.where(q[t] < 0, -v, v)
    return out


def _horner_py(coefs: list[float], r: float) -> float:
    v = coefs[-1]
    for c in reversed(coefs[:-1]):
        v = v * r + c
    return v


# Normal-output clip bounds of the quantile transform.
CLIP_LOW = norm_ppf_scalar(BOUNDS_THRESHOLD - 2.220446049250313e-16)
CLIP_HIGH = norm_ppf_scalar(1 - (BOUNDS_THRESHOLD - 2.220446049250313e-16))


def _digamma_asym_sql(x: str) -> str:
    return (f"(ln({x}) - 1.0 / (2.0 * {x}) - 1.0 / (12.0 * power({x}, 2)) "
            f"+ 1.0 / (120.0 * power({x}, 4)) - 1.0 / (252.0 * power({x}, 6)) "
            f"+ 1.0 / (240.0 * power({x}, 8)))")


def digamma_sql(x: str) -> str:
    """Digamma for positive arguments: shift by six with the recurrence
    psi(x) = psi(x + 6) - sum 1/(x + i), then the asymptotic series."""
    x = f"CAST({x} AS DOUBLE)"
    shifted = " - ".join([_digamma_asym_sql(f"(({x}) + 6.0)")] + [f"1.0 / (({x}) + {i}.0)" for i in range(6)])
    return f"(CASE WHEN ({x}) >= 6.0 THEN {_digamma_asym_sql(f'({x})')} ELSE ({shifted}) END)"


def _digamma_asym(x: Column) -> Column:
    return (F.log(x) - F.lit(1.0) / (2.0 * x) - F.lit(1.0) / (12.0 * F.pow(x, 2))
            + F.lit(1.0) / (120.0 * F.pow(x, 4)) - F.lit(1.0) / (252.0 * F.pow(x, 6))
            + F.lit(1.0) / (240.0 * F.pow(x, 8)))


def digamma(x: Column) -> Column:
    x = x.cast("double")
    shifted = _digamma_asym(x + 6.0)
    for i in range(6):
        shifted = shifted - F.lit(1.0) / (x + float(i))
    return F.when(x >= 6.0, _digamma_asym(x)).otherwise(shifted)


def digamma_scalar(x: float) -> float:
    if x >= 6.0:
        return (math.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4)
                - 1 / (252 * x ** 6) + 1 / (240 * x ** 8))
    return digamma_scalar(x + 6.0) - sum(1.0 / (x + i) for i in range(6))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def node_prob(x: Column, theta: float | Column) -> Column:
    """Soft split: probability of going left, ``sigmoid(theta - x)``."""
    th = theta if isinstance(theta, Column) else F.lit(float(theta))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(x - th))


def permute(features: Column, order: list[int]) -> Column:
    """Array reordered by index: ``[features[order[0]], features[order[1]], ...]``."""
    return F.transform(F.array(*[F.lit(int(i)) for i in order]), lambda i: F.get(features, i))


def softmax(scores: Column) -> Column:
    """Softmax of an ARRAY<DOUBLE>, shifted by the maximum for stability."""
    m = F.array_max(scores)
    ex = F.transform(scores, lambda v: F.exp(v - m))
    s = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    return F.transform(ex, lambda v: v / s)


def log_softmax(scores: Column) -> Column:
    m = F.array_max(scores)
    lse = F.log(F.aggregate(scores, F.lit(0.0), lambda a, v: a + F.exp(v - m))) + m
    return F.transform(scores, lambda v: v - lse)


def argmax(scores: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


# ---------------------------------------------------------------------------
# Keyed randomness: values depend on the row key and the seed only, never on
# partitioning or task order, so a recomputed partition reproduces them.
_TWO52 = float(2 ** 52)


def keyed_uniform(seed: int, salt: int | Column, *keys: Column) -> Column:
    """Uniform in (0, 1) from 52 bits of the md5 of ``keys:seed:salt``."""
    salt_col = salt if isinstance(salt, Column) else F.lit(int(salt))
    h = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(int(seed))), salt_col.cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / _TWO52


def keyed_uniform_sql(seed: int, salt: str, *keys: str) -> str:
    """DuckDB text of ``keyed_uniform`` (``salt``: an integer expression)."""
    text = " || ':' || ".join([*(f"CAST({k} AS VARCHAR)" for k in keys), f"'{int(seed)}'", f"CAST({salt} AS VARCHAR)"])
    return f"((CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) + 0.5) / {_TWO52!r})"


def keyed_gaussian_sql(seed: int, salt: str, *keys: str) -> str:
    """DuckDB text of ``keyed_gaussian``."""
    u1, u2 = keyed_uniform_sql(seed, f"({salt}) * 2", *keys), keyed_uniform_sql(seed, f"({salt}) * 2 + 1", *keys)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"


def keyed_gaussian(seed: int, salt: int | Column, *keys: Column) -> Column:
    """Standard normal draw by Box–Muller from two keyed uniforms."""
    salt_col = salt if isinstance(salt, Column) else F.lit(int(salt))
    u1 = keyed_uniform(seed, salt_col * 2, *keys)
    u2 = keyed_uniform(seed, salt_col * 2 + 1, *keys)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


# ---------------------------------------------------------------------------
# Sorted-array search, JVM-side (binary search in a higher-order function).

def _search(grid: Column, x: Column, n_max: int, strict: bool) -> Column:
    iters = max(1, int(math.ceil(math.log2(n_max + 1))) + 1)
    init = F.struct(F.lit(0).alias("lo"), F.size(grid).alias("hi"))

    def step(acc, _i):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        g = F.get(grid, mid)
        go_right = (g < x) if strict else (g <= x)
        return F.when(lo >= hi, acc).otherwise(
            F.when(go_right, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(iters)), init, step, lambda acc: acc["lo"])


def count_less(grid: Column, x: Column, n_max: int) -> Column:
    """Number of elements of sorted ``grid`` strictly below ``x``."""
    return _search(grid, x, n_max, strict=True)


def count_less_equal(grid: Column, x: Column, n_max: int) -> Column:
    """Number of elements of sorted ``grid`` at most ``x``."""
    return _search(grid, x, n_max, strict=False)


def column_range(prefix: str, n: int, start: int = 0, suffix: str = "") -> list[str]:
    """Names of a numbered column family, e.g. ``word_freq_WORD_0..47``."""
    return [f"{prefix}{i}{suffix}" for i in range(start, start + n)]


def flatten_names(items) -> list[str]:
    out: list[str] = []
    for it in items:
        if isinstance(it, (list, tuple)):
            out.extend(flatten_names(it))
        else:
            out.append(it)
    return out
