"""Student-t probabilities and the split search: as SQL expressions for the JVM, and over arrays for checks of these."""

from __future__ import annotations

import math

import numpy as np


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    return h


def beta_regularised(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for positive ``a``, ``b`` and ``x`` in [0, 1]."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    inside = np.clip(x, 1e-308, 1 - 1e-16)
    log_front = _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside)
    front = np.exp(log_front)
    flip = inside > (a + 1.0) / (a + b + 2.0)
    lower = front * _beta_fraction(a, b, np.where(flip, 0.5, inside)) / a
    upper = 1.0 - front * _beta_fraction(b, a, np.where(flip, 1.0 - inside, 0.5)) / b
    out = np.where(flip, upper, lower)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a Student-t statistic; infinite statistics give 0."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    safe_t, safe_df = np.where(ok, t, 1.0), np.where(ok, df, 1.0)
    p = beta_regularised(safe_df / 2.0, np.full_like(safe_df, 0.5), safe_df / (safe_df + safe_t**2))
    return np.where(ok, p, np.where(np.isinf(t), 0.0, np.nan))


def _segment(x: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and squared standard error of the first ``k`` points of every row; constant parts have exactly none."""
    total, squares = np.cumsum(x, axis=1)[:, k - 1], np.cumsum(x * x, axis=1)[:, k - 1]
    flat = np.minimum.accumulate(x, axis=1)[:, k - 1] == np.maximum.accumulate(x, axis=1)[:, k - 1]
    mean = total / k
    var = np.where(flat, 0.0, np.maximum(squares - k * mean * mean, 0.0) / (k - 1))
    return mean, var / k


def best_splits(rows: np.ndarray, limit: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Per row: position and p-value of the split with the smallest Welch p-value, three points at least on each side.

    All rows have one length. The first of equal splits counts; (-1, 1.0) when no
    split is significant at ``limit``. A statistic that would not be significant
    even for a normal distribution is not evaluated further.
    """
    n = rows.shape[1]
    at, best = np.full(len(rows), -1), np.ones(len(rows))
    cuts = np.arange(3, n - 2)
    if len(cuts) == 0:
        return at, best
    x = rows - rows.mean(axis=1, keepdims=True)
    ma, va = _segment(x, cuts)
    mb, vb = (v[:, ::-1] for v in _segment(x[:, ::-1], (n - cuts)[::-1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (ma - mb) / np.sqrt(va + vb)
        df = (va + vb) ** 2 / (va**2 / (cuts - 1) + vb**2 / (n - cuts - 1))
    df = np.where(np.isnan(df), 1.0, df)
    floor = {0.05: 1.9599, 0.01: 2.5758}.get(limit, 0.0)
    near = np.abs(t) > floor
    p = np.full(t.shape, 2.0)
    p[near] = t_two_sided(t[near], df[near])
    p = np.where(np.isnan(p), 2.0, p)
    first = np.argmin(np.round(np.log(np.maximum(p, 1e-300)), 6), axis=1)
    low = p[np.arange(len(rows)), first]
    found = low < limit
    return np.where(found, cuts[first], at), np.where(found, low, best)


#: Steps of the continued fraction; for the degrees of freedom of a series it stands still long before.
STEPS = 60


def _bound(value: str, name: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _log_gamma(z: str) -> str:
    """SQL: the logarithm of the gamma function of a positive number, by Stirling's series eight steps up."""
    product = " * ".join(f"({z} + {k}D)" for k in range(8))
    series = ("(w - 0.5D) * ln(w) - w + 0.91893853320467274D + 1D / (12D * w) - 1D / (360D * pow(w, 3)) + 1D / (1260D * pow(w, 5)) - 1D / (1680D * pow(w, 7))")
    return "(" + _bound(f"{z} + 8D", "w", f"{series} - ln({product})") + ")"


def _apart(value: str) -> str:
    return f"if(abs({value}) < 1e-300D, 1e-300D, {value})"


def _fraction(a: str, b: str, x: str) -> str:
    """SQL: the continued fraction of the incomplete beta function in a fixed number of steps."""
    def half(state: str, number: str) -> str:
        after = _bound(f"struct(1D + {number} * {state}.d as d, 1D + {number} / {state}.c as c)", "u",
                       f"struct({_apart('u.c')} as c, 1D / {_apart('u.d')} as d)")
        return _bound(after, "y", f"struct(y.c as c, y.d as d, {state}.h * y.d * y.c as h)")

    m = "cast(m as double)"
    even = f"({m} * ({b} - {m}) * {x} / (({a} + 2D * {m} - 1D) * ({a} + 2D * {m})))"
    odd = f"(-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2D * {m}) * ({a} + 2D * {m} + 1D)))"
    step = _bound(half("s", even), "e", half("e", odd))
    start = _bound(f"1D / {_apart(f'(1D - ({a} + {b}) * {x} / ({a} + 1D))')}", "d0", "struct(1D as c, d0 as d, d0 as h)")
    return f"aggregate(sequence(1, {STEPS}), {start}, (s, m) -> {step}).h"


def t_pvalue_sql(t: str, df: str) -> str:
    """SQL text of the two-sided p-value of a finite t with positive degrees of freedom; null for nulls.

    The regularised incomplete beta function, as in ``t_two_sided``, inside the JVM.
    """
    inner = _bound("if(q.x > (q.a + 1D) / (q.a + 2.5D), struct(0.5D as a, q.a as b, q.y as x), struct(q.a as a, 0.5D as b, q.x as x))", "g",
                   f"exp({_log_gamma('(q.a + 0.5D)')} - {_log_gamma('q.a')} - 0.57236494292470008D + q.a * ln(q.x) + 0.5D * ln(q.y)) * {_fraction('g.a', 'g.b', 'g.x')} / g.a")
    value = _bound(inner, "v", "if(q.x > (q.a + 1D) / (q.a + 2.5D), 1D - v, v)")
    square = f"(({t}) * ({t}))"
    told = f"struct(({df}) / 2D as a, ({df}) / (({df}) + {square}) as x, {square} / (({df}) + {square}) as y)"
    return f"(case when ({t}) = 0 then 1D when ({df}) > 0 then " + _bound(told, "q", f"if(q.x <= 0 or q.y <= 0, if(q.x <= 0, 0D, 1D), {value})") + " end)"


def _prefixes(xs: str) -> str:
    """SQL: for every number of first points their sum, sum of squares, least and greatest value."""
    grown = "struct(a.s + x as s, a.q + x * x as q, least(a.lo, x) as lo, greatest(a.hi, x) as hi)"
    none = "cast(array() as array<struct<s:double,q:double,lo:double,hi:double>>)"
    start = f"struct(struct(0D as s, 0D as q, cast('inf' as double) as lo, cast('-inf' as double) as hi) as now, {none} as upto)"
    step = _bound("transform(array(a0.now), a -> " + grown + ")[0]", "z", "struct(z as now, concat(a0.upto, array(z)) as upto)")
    return f"aggregate({xs}, {start}, (a0, x) -> {step}).upto"


def split_search_sql(xs: str, limit: float = 0.01) -> str:
    """SQL text of the best split of a series: ``struct(at, p)``, null where none is significant at ``limit``.

    The split with the smallest Welch p-value, three points at least on each side; the first of those that agree to six digits. Sums of both sides
    come from prefix arrays, made once per series. A statistic that would not be significant even
    for a normal distribution is not evaluated further; constant parts have exactly no variance.
    """
    floor = {0.05: 1.9599, 0.01: 2.5758}.get(limit, 0.0)

    def side(part: str, k: str) -> str:
        spread = f"if({part}.lo = {part}.hi, 0D, greatest({part}.q - {part}.s * {part}.s / {k}, 0D) / ({k} - 1D)) / {k}"
        return f"struct({part}.s / {k} as m, {spread} as v)"

    tested = _bound("struct(l.m - r.m as d, l.v + r.v as v)", "c", f"struct(k as at, case when c.v = 0 then if(c.d = 0, cast(null as double), cast('inf' as double)) else c.d / sqrt(c.v) end as t, "
                    "case when c.v = 0 then 1D else c.v * c.v / (l.v * l.v / (k - 1D) + r.v * r.v / (n0 - k - 1D)) end as df)")
    both = _bound(side("b.f[k - 1]", "cast(k as double)"), "l", _bound(side("b.r[n0 - k - 1]", "cast(n0 - k as double)"), "r", tested))
    tests = f"transform(sequence(3, n0 - 3), k -> {both})"
    kept = f"filter({tests}, w -> w.t is not null and abs(w.t) > {floor}D)"
    p = f"if(abs(w.t) = cast('inf' as double), 0D, {t_pvalue_sql('w.t', 'w.df')})"
    # a mirrored series has two splits of one probability, whatever the last digits say
    scored = f"transform({kept}, w -> " + _bound(p, "pw", "struct(round(ln(greatest(pw, 1e-300D)), 6) as size, w.at as at, pw as p)") + ")"
    best = _bound(f"array_min({scored})", "best", f"if(best.p < {limit}D, struct(best.at as at, best.p as p), null)")
    centred = f"transform({xs}, x -> x - aggregate({xs}, 0D, (t, y) -> t + y) / size({xs}))"
    arrays = _bound(centred, "cx", f"struct({_prefixes('cx')} as f, {_prefixes('reverse(cx)')} as r)")
    return f"case when size({xs}) >= 6 then " + _bound(f"size({xs})", "n0", _bound(arrays, "b", best)) + " end"
