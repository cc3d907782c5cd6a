"""Combinatorial statistics as JVM-side SQL expressions over column names or SQL text.

The hypergeometric mass is computed from Stirling *errors* and deviances (Loader, "Fast and
accurate computation of binomial probabilities", 2000) and not from differences of large
log-factorials, so it keeps its digits for universes of billions of ids.

Formulas are assembled as SQL text and parsed once; ``_let`` binds intermediate values to a
lambda variable, so nested formulas are evaluated once and do not multiply.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN_2PI = math.log(2 * math.pi)
EXACT_FACTORIAL = 20  # largest n whose factorial fits a bigint
SERIES = (12, 360, 1260, 1680)  # Stirling series: +1/12x -1/360x^3 +1/1260x^5 -1/1680x^7


def _num(value: float) -> str:
    return f"{value!r}D"


def _dbl(c) -> str:
    return f"CAST({c} AS DOUBLE)"


def _let(var: str, body: str, **values: str) -> str:
    """``body``, which may use ``var.name`` for each named value."""
    fields = ", ".join(f"'{name}', {text}" for name, text in values.items())
    return f"element_at(transform(array(named_struct({fields})), {var} -> {body}), 1)"


def _series(x: str) -> str:
    a, b, c, d = (_num(1 / s) for s in SERIES)
    return f"(({a} - ({b} - ({c} - {d} / ({x} * {x})) / ({x} * {x})) / ({x} * {x})) / {x})"


def _factorial(x: str) -> str:
    return f"CAST(factorial(CAST(least({x}, {_num(EXACT_FACTORIAL)}) AS INT)) AS DOUBLE)"


def _stirling(x: str) -> str:
    return f"(({x} + 0.5D) * ln({x}) - {x} + {_num(0.5 * LN_2PI)})"


def _ln_factorial(n: str) -> str:
    return _let(
        "f",
        f"CASE WHEN f.x <= {EXACT_FACTORIAL} THEN ln({_factorial('f.x')}) "
        f"ELSE {_stirling('f.x')} + {_series('f.x')} END",
        x=_dbl(n),
    )


def _stirling_error(n: str) -> str:
    return _let(
        "e",
        f"CASE WHEN e.x <= 0 THEN 0D "
        f"WHEN e.x <= {EXACT_FACTORIAL} THEN ln({_factorial('e.x')}) - {_stirling('e.x')} "
        f"ELSE {_series('e.x')} END",
        x=_dbl(n),
    )


def _deviance(x: str, mean: str) -> str:
    """x ln(x/mean) + mean - x; by its series in v^2 when x is close to mean."""
    tail = _num(1 / 17)
    for odd in (15, 13, 11, 9, 7, 5, 3):
        tail = f"({_num(1 / odd)} + w.q * {tail})"
    near = _let("w", f"(d.x - d.m) * w.v + 2 * d.x * w.v * w.q * {tail}", v="v.v", q="v.v * v.v")
    far = "d.x * ln(d.x / d.m) + d.m - d.x"
    body = _let(
        "v", f"CASE WHEN abs(v.v) < 0.1D THEN {near} ELSE {far} END", v="(d.x - d.m) / (d.x + d.m)"
    )
    return _let("d", f"CASE WHEN d.x <= 0 THEN d.m ELSE {body} END", x=x, m=mean)


def _half_log(x: str, n: str) -> str:
    inner = f"0.5D * ({_num(LN_2PI)} + ln({x}) + ln(({n} - {x}) / {n}))"
    return f"(CASE WHEN {x} > 0 AND {x} < {n} THEN {inner} ELSE 0D END)"


def _ln_part(x: str, total: str, p: str, q: str) -> str:
    """ln of a binomial mass of x among total at chance p = 1 - q, without common factors."""
    return _let(
        "b",
        f"{_stirling_error('b.t')} - {_stirling_error('b.x')} - {_stirling_error('b.t - b.x')} "
        f"- {_deviance('b.x', 'b.t * b.p')} - {_deviance('b.t - b.x', 'b.t * b.q')} "
        f"- {_half_log('b.x', 'b.t')}",
        x=x,
        t=total,
        p=p,
        q=q,
    )


def _ln_pmf(k: str, n: str, m: str, u: str) -> str:
    p, q = "h.n / h.u", "(h.u - h.n) / h.u"
    drawn = (
        f"({_stirling_error('h.u')} - {_stirling_error('h.n')} - {_stirling_error('h.u - h.n')} "
        f"- {_half_log('h.n', 'h.u')})"
    )
    # With everything drawn the only possible k is the set size: mass one.
    return _let(
        "h",
        f"CASE WHEN h.n >= h.u THEN 0D ELSE {_ln_part('h.k', 'h.m', p, q)} "
        f"+ {_ln_part('h.n - h.k', 'h.u - h.m', p, q)} - {drawn} END",
        k=_dbl(k),
        n=_dbl(n),
        m=_dbl(m),
        u=_dbl(u),
    )


def _walk(steps: str, ratio: str, start: str) -> str:
    """Sum of successive products of ``ratio`` (in terms of i), plus ``start``."""
    step = f"named_struct('t', a.t * {ratio}, 's', a.s + a.t * {ratio})"
    return f"aggregate({steps}, named_struct('t', 1D, 's', {start}), (a, i) -> {step}, a -> a.s)"


def ln_factorial(n: str) -> Column:
    return F.expr(_ln_factorial(n))


def ln_choose(n: str, k: str) -> Column:
    """ln of n over k; null (no mass) outside 0 <= k <= n."""
    parts = f"{_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'{n} - {k}')}"
    return F.expr(f"CASE WHEN {k} BETWEEN 0 AND {n} THEN {parts} END")


def hypergeom_pmf(k: str, n: str, set_size: str, universe: str) -> Column:
    """P(X = k) for k hits among n draws, set_size marked ids, universe ids; 0 if impossible."""
    possible = (
        f"{k} >= 0 AND {k} >= {n} + {set_size} - {universe} AND {k} <= {n} AND {k} <= {set_size} "
        f"AND {n} <= {universe} AND {set_size} <= {universe}"
    )
    return F.expr(f"CASE WHEN {possible} THEN exp({_ln_pmf(k, n, set_size, universe)}) ELSE 0D END")


def hypergeom_upper_tail(k: str, n: str, set_size: str, universe: str) -> Column:
    """P(X >= k), summed outwards from the largest term so nothing over- or underflows.

    Degenerate inputs give 1: an empty universe, set or draw, or a set larger than the universe.
    Draws are clamped to the universe and k to its largest possible value. Terms further than
    9 standard deviations and 60 steps from the largest one are below double rounding and are
    not visited, so the work per row is bounded by the spread and not by the set size.
    """
    up = _walk(
        "sequence(t.mode + 1, least(c.hi, t.mode + t.reach))",
        "CAST(c.m - i + 1 AS DOUBLE) * (c.n - i + 1) / (CAST(i AS DOUBLE) * (c.u - c.m - c.n + i))",
        "1D",
    )
    down = _walk(
        "sequence(t.mode - 1, greatest(c.lo, t.mode - t.reach))",
        "CAST(i + 1 AS DOUBLE) * (c.u - c.m - c.n + i + 1) / (CAST(c.m - i AS DOUBLE) * (c.n - i))",
        "0D",
    )
    total = (
        f"exp({_ln_pmf('t.mode', 'c.n', 'c.m', 'c.u')}) "
        f"* ((CASE WHEN c.hi > t.mode THEN {up} ELSE 1D END) "
        f"+ (CASE WHEN c.lo < t.mode THEN {down} ELSE 0D END))"
    )
    peak = "CAST(floor((c.n + 1D) * (c.m + 1D) / (c.u + 2D)) AS BIGINT)"
    spread = "sqrt(greatest(0D, c.n * (c.m / c.u) * (1 - c.m / c.u)))"
    around = _let(
        "t",
        total,
        mode=f"greatest(c.lo, least(c.hi, {peak}))",
        reach=f"CAST(ceil({spread} * 9) AS BIGINT) + 60",
    )
    degenerate = "c.u <= 0 OR c.m <= 0 OR c.n <= 0 OR c.m > c.u"
    tail = f"CASE WHEN {degenerate} OR c.lo <= c.least THEN 1D ELSE least(1D, {around}) END"
    clamped = _let(
        "c",
        tail,
        lo="greatest(least(r.k, r.n, r.m), 0, r.n + r.m - r.u)",
        hi="least(r.n, r.m)",
        least="greatest(0, r.n + r.m - r.u)",
        n="r.n",
        m="r.m",
        u="r.u",
    )
    return F.expr(
        _let(
            "r",
            clamped,
            k=f"CAST({k} AS BIGINT)",
            n=f"CAST(least({n}, {universe}) AS BIGINT)",
            m=f"CAST({set_size} AS BIGINT)",
            u=f"CAST({universe} AS BIGINT)",
        )
    )
