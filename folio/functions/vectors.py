"""Functions on arrays of doubles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Shifted by the largest, so no exponential overflows."""
    e = F.transform(x, lambda v: F.exp((v - F.array_max(x)) / temperature))
    return F.transform(e, lambda v: v / total(e))


def log_softmax(x: Column) -> Column:
    shift = F.array_max(x) + F.ln(total(F.transform(x, lambda v: F.exp(v - F.array_max(x)))))
    return F.transform(x, lambda v: v - shift)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def renormalised(p: Column) -> Column:
    """Clipped from below, then summing to one."""
    c = F.transform(p, lambda v: F.greatest(v, F.lit(TINY)))
    return F.transform(c, lambda v: v / total(c))


def entropy_share(p: Column, classes: int) -> Column:
    """Entropy as a share of the largest possible."""
    return total(F.transform(p, lambda v: -F.greatest(v, F.lit(TINY)) * F.ln(F.greatest(v, F.lit(TINY))))) / math.log(classes)


def argmax(p: Column) -> Column:
    """0-based place of the largest, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ranked(p: Column) -> Column:
    """Structs (p, k) by p descending, then k."""
    pairs = F.transform(p, lambda v, k: F.struct(v.alias("p"), k.alias("k")))
    return F.array_sort(pairs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(a["k"] - b["k"]))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == label, 1.0).otherwise(0.0))


def smooth(p: Column, eps: float, classes: int) -> Column:
    return F.transform(p, lambda v: (1 - eps) * v + eps / classes)


def blend(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of vectors; the weights are normalised."""
    whole = sum(w for _, w in parts)
    out = F.transform(parts[0][0], lambda v: v * (parts[0][1] / whole))
    for x, w in parts[1:]:
        out = _add(out, x, w / whole)
    return out


def _add(x: Column, y: Column, weight: float) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b * weight)


def masked_argmax(p: Column, allowed: Column) -> Column:
    """The best of the allowed labels (an array of numbers), of all where none is."""
    inside = F.transform(p, lambda v, k: F.when(F.array_contains(allowed, k), v).otherwise(-1.0))
    return F.when(F.size(allowed) > 0, argmax(inside)).otherwise(argmax(p))


def without_prior(p: Column, prior_logs: list[float]) -> Column:
    """Probabilities with each label's mean log-probability taken out, normalised again."""
    logs = F.array(*(F.lit(float(x)) for x in prior_logs))
    return softmax(F.zip_with(p, logs, lambda v, q: F.ln(v + 1e-12) - q))


def simplex_grid(n: int, steps: int = 10) -> list[tuple[float, ...]]:
    """All weights of n parts, in multiples of 1 / steps, that sum to one."""
    if n == 1:
        return [(1.0,)]
    out: list[tuple[int, ...]] = [(k,) for k in range(steps + 1)]
    for _ in range(n - 2):
        out = [(*x, k) for x in out for k in range(steps + 1 - sum(x))]
    return [tuple(k / steps for k in (*x, steps - sum(x))) for x in out]


def geometric_grid(low: float, high: float, n: int) -> list[float]:
    """n numbers from low to high in equal ratios."""
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)]
