"""The three estimators as closed forms, in SQL text that Spark and DuckDB read alike.

Evidence is a pair of likelihoods (yes, no); a null of either is skipped. The posterior is the logistic function of the sum
of log ratios, which can't underflow as a product of probabilities would.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

TINY = 1e-10


def _number(x: float) -> str:
    return f"{float(x)!r}" + ("" if "e" in repr(float(x)) else "e0")


def binary(condition: str, yes: float, no: float, when: str | None = None) -> str:
    """Log ratio of a feature that is there or not. A null condition counts as not there; where `when` isn't true the feature is skipped."""
    yes, no = (min(max(p, 1e-7), 1 - 1e-7) for p in (yes, no))
    ratio = f"CASE WHEN {condition} THEN {_number(math.log(yes / no))} ELSE {_number(math.log((1 - yes) / (1 - no)))} END"
    return f"CASE WHEN {when} THEN {ratio} ELSE 0e0 END" if when else ratio


def negative_binomial(k: str, n: int, p: float) -> str:
    """Probability of k failures before the n-th success: a product of n - 1 terms, as n is a whole number."""
    terms = [f"ln(({k} + {i}e0) / {i}e0)" for i in range(1, n)]
    return f"exp({' + '.join([*terms, _number(n * math.log(p)), f'{k} * {_number(math.log(1 - p))}'])})"


def count_ratio(k: str, yes: tuple[int, float], no: tuple[int, float], smooth: bool) -> str:
    """Log ratio of a number under two negative binomials; null is skipped. Smoothing pulls the smaller likelihood up to their mean."""
    a, b = (f"greatest({negative_binomial(k, *d)}, {TINY!r})" for d in (yes, no))
    if smooth:
        a, b = f"greatest({a}, ({a} + {b}) / 2e0)", f"greatest({b}, ({a} + {b}) / 2e0)"
    return f"coalesce(ln({a}) - ln({b}), 0e0)"


def ladder(value: str, table: Sequence[tuple[float, float, float]]) -> str:
    """Log ratio by cumulative tables (limit, yes, no): the step in which the value lies, or what is beyond the last; null is skipped."""
    cases, before = [], (0.0, 0.0)
    for limit, yes, no in table:
        ratio = math.log(max(yes - before[0], TINY) / max(no - before[1], TINY))
        cases.append(f"WHEN {value} <= {limit} THEN {_number(ratio)}")
        before = (yes, no)
    rest = math.log(max(1 - before[0], TINY) / max(1 - before[1], TINY))
    return f"CASE WHEN {value} IS NULL THEN 0e0 {' '.join(cases)} ELSE {_number(rest)} END"


def posterior(prior: float, ratios: Sequence[str]) -> str:
    """The probability from a prior and log ratios."""
    total = " + ".join([_number(math.log(prior / (1 - prior))), *(f"({r})" for r in ratios)])
    return f"1e0 / (1e0 + exp(-({total})))"


def estimate(features: Sequence[tuple[str, float, float]]) -> str:
    """The score estimator: features (truth from 0 to 1, weight if true, weight if not).

    A feature scores f * w1 + (1 - f) * w0, from -1 to 1; nulls are skipped. With pos = 1 - prod(1 - s) / 2 over scores from 0
    on, neg = prod(1 - |s|) / 2 over those under 0, each side is weighed by 0.01 and the sum of exp(5 (0.5 + |s|)) over its scores.
    """
    scores = [f"({f}) * {_number(w1)} + (1e0 - ({f})) * {_number(w0)}" for f, w1, w0 in features]
    product = lambda kind: " * ".join(f"CASE WHEN {s} {kind} THEN 1e0 - abs({s}) ELSE 1e0 END" for s in scores)
    weight = lambda kind: " + ".join(f"CASE WHEN {s} {kind} THEN exp((0.5e0 + abs({s})) * 5e0) ELSE 0e0 END" for s in scores)
    up, down = weight(">= 0"), weight("< 0")
    return f"((1e0 - 0.5e0 * {product('>= 0')}) * (0.01e0 + {up}) + (0.5e0 * {product('< 0')}) * (0.01e0 + {down})) / (0.02e0 + {up} + {down})"


def estimate_array(features: Sequence[tuple[str, float, float]]) -> str:
    """The same estimator for Spark alone, over an array that is bound once: its text, and so its planning, stays short where it is used for many labels and rounds."""
    scores = ", ".join(f"({f}) * {_number(w1)} + (1e0 - ({f})) * {_number(w0)}" for f, w1, w0 in features)
    product = lambda kind: f"aggregate(a, 1e0, (x, s) -> CASE WHEN s {kind} THEN x * (1e0 - abs(s)) ELSE x END)"
    weight = lambda kind: f"aggregate(a, 0.01e0, (x, s) -> CASE WHEN s {kind} THEN x + exp((0.5e0 + abs(s)) * 5e0) ELSE x END)"
    return f"transform(array(array({scores})), a -> ((1e0 - 0.5e0 * {product('>= 0')}) * {weight('>= 0')} + 0.5e0 * {product('< 0')} * {weight('< 0')}) / ({weight('>= 0')} + {weight('< 0')}))[0]"


def estimate_parts(features: Sequence[tuple[str, float, float]], name: str) -> list[str]:
    """The four running values of the estimator over some features, as columns <name>_0 to _3: both products and both weights. For Spark; each feature should be a column. See estimate_more."""
    scores = [f"(({f}) * {_number(w1)} + (1e0 - ({f})) * {_number(w0)})" for f, w1, w0 in features]
    up = [f"coalesce(1e0 - greatest({s}, 0e0), 1e0)" for s in scores]
    down = [f"coalesce(1e0 + least({s}, 0e0), 1e0)" for s in scores]
    weight = lambda kind: ["0.01e0", *(f"CASE WHEN {s} {kind} THEN exp((0.5e0 + abs({s})) * 5e0) ELSE 0e0 END" for s in scores)]
    parts = [" * ".join(up), " * ".join(down), " + ".join(weight(">= 0")), " + ".join(weight("< 0"))]
    return [f"{p} AS {name}_{i}" for i, p in enumerate(parts)]


def estimate_more(name: str, scores: Sequence[str]) -> str:
    """The estimate from running values and the scores (columns or short expressions) of further features, which come after them: the same as that of all features at once."""
    up, down, high, low = (f"{name}_{i}" for i in range(4))
    for s in scores:
        up, down = f"{up} * (1e0 - greatest({s}, 0e0))", f"{down} * (1e0 + least({s}, 0e0))"
        high, low = f"({high} + CASE WHEN {s} >= 0 THEN exp((0.5e0 + abs({s})) * 5e0) ELSE 0e0 END)", f"({low} + CASE WHEN {s} < 0 THEN exp((0.5e0 + abs({s})) * 5e0) ELSE 0e0 END)"
    return f"((1e0 - 0.5e0 * ({up})) * {high} + 0.5e0 * ({down}) * {low}) / ({high} + {low})"


def score(feature: str, true: float, false: float) -> str:
    """A feature's score from its truth."""
    return f"(({feature}) * {_number(true)} + (1e0 - ({feature})) * {_number(false)})"
