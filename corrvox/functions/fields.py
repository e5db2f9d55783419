"""Analytic displacement fields of synthetic cases as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrvox.functions.geometry import Matrix, apply


class Field:
    """A displacement field; call it with a point's columns, or ask for its gradient there."""

    def __call__(self, p: tuple) -> list[Column]:
        raise NotImplementedError

    def gradient(self, p: tuple) -> Matrix:
        raise NotImplementedError

    def inverse(self, x: tuple, steps: int = 12) -> list[Column]:
        """Fixed-point iteration for X with X + u(X) = x, unrolled."""
        at = list(x)
        for _ in range(steps + 1):
            at = [a - d for a, d in zip(x, self(tuple(at)), strict=True)]
        return at


def _m(rows) -> Matrix:
    return [[F.lit(float(v)) for v in r] for r in rows]


class Linear(Field):
    """Rigid and affine fields: a translation and a gradient about a centre."""

    def __init__(self, translation, gradient, centre) -> None:
        self.t, self.rows, self.c = translation, gradient, centre

    def __call__(self, p):
        d = tuple(a - c for a, c in zip(p, self.c, strict=True))
        return [F.lit(float(t)) + v for t, v in zip(self.t, apply(_m(self.rows), d), strict=True)]

    def gradient(self, p):
        return _m(self.rows)


class Sinusoid(Field):
    def __init__(self, translation, amplitude, wavelength, axis=0, component=0, phase=0.0) -> None:
        self.t, self.a, self.k, self.axis, self.comp, self.phase = translation, amplitude, 2 * math.pi / wavelength, axis, component, phase

    def __call__(self, p):
        out = [F.lit(float(t)) for t in self.t]
        out[self.comp] = out[self.comp] + self.a * F.sin(self.k * p[self.axis] + self.phase)
        return out

    def gradient(self, p):
        g = _m([[0] * 3] * 3)
        g[self.comp][self.axis] = self.a * self.k * F.cos(self.k * p[self.axis] + self.phase)
        return g


class Inclusion(Field):
    """A stiff ball: strain scaled by ``ratio`` inside the radius, rising to the full strain far away."""

    def __init__(self, translation, centre, radius, strain, ratio=0.25) -> None:
        self.t, self.c, self.a, self.rows, self.b = translation, centre, radius, strain, ratio

    def _r(self, p):
        d = tuple(a - c for a, c in zip(p, self.c, strict=True))
        return d, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    def __call__(self, p):
        d, r = self._r(p)
        s = F.when(r > self.a, 1 - (1 - self.b) * F.pow(self.a / r, 3)).otherwise(F.lit(float(self.b)))
        return [F.lit(float(t)) + s * v for t, v in zip(self.t, apply(_m(self.rows), d), strict=True)]

    def gradient(self, p):
        d, r = self._r(p)
        s = F.when(r > self.a, 1 - (1 - self.b) * F.pow(self.a / r, 3)).otherwise(F.lit(float(self.b)))
        ds = F.when(r > self.a, 3 * (1 - self.b) * self.a**3 / F.pow(r, 4)).otherwise(F.lit(0.0))
        e = _m(self.rows)
        ed = apply(e, d)
        far = F.greatest(r, F.lit(1e-12))
        return [[s * e[i][j] + ds / far * ed[i] * d[j] for j in range(3)] for i in range(3)]
