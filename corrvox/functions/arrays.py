"""Sums, products and matching criteria over sample arrays as column expressions (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("sad", "ssd", "zssd", "nssd", "znssd")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def centred(a: Column) -> Column:
    # The mean is one value of the row: a one-element array carries it into the lambda.
    return F.flatten(F.transform(F.array(mean(a)), lambda m: F.transform(a, lambda x: x - m)))


def unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    return F.flatten(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(1.0))))


def reference_term(f: Column, kind: str) -> Column:
    """The reference side of the residual for each sample."""
    if kind not in KINDS:
        raise ValueError(f"unknown objective {kind!r}")
    if kind in ("zssd", "znssd"):
        f = centred(f)
    return unit(f) if kind in ("nssd", "znssd") else f


def objective(f: Column, g: Column, kind: str) -> Column:
    if kind == "sad":
        return total(F.zip_with(f, g, lambda x, y: F.abs(y - x)))
    p, q = reference_term(f, kind), reference_term(g, kind)
    ssd = total(F.zip_with(p, q, lambda x, y: (y - x) * (y - x)))
    return ssd * {"nssd": 0.5, "znssd": 0.25}.get(kind, 1.0)


def textureless(f: Column, tol: float = 1e-12) -> Column:
    """No texture to correlate; NaN samples count as none (the comparison is negated on purpose)."""
    spread = F.array_max(f) - F.array_min(f)
    some = spread > tol * F.array_max(F.transform(f, lambda x: F.abs(x)))
    return ~some | F.exists(f, lambda x: F.isnan(x))


def share_between(f: Column, lo: float, hi: float) -> Column:
    return mean(F.transform(f, lambda x: F.when((x >= lo) & (x <= hi), 1.0).otherwise(0.0)))
