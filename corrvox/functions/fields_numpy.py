"""Displacement fields of synthetic cases at places (..., 3), in numpy: what images are made with."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

from corrvox.functions.kernels import deformation, stretch


class Field(Protocol):
    def at(self, x: np.ndarray) -> np.ndarray: ...


def origin_of(field: Field, x: np.ndarray, steps: int = 12) -> np.ndarray:
    """Where the content at ``x`` of the deformed image came from: X with X + u(X) = x, by fixed-point steps."""
    back = x - field.at(x)
    for _ in range(steps):
        back = x - field.at(back)
    return back


@dataclass(frozen=True)
class Uniform:
    """A translation and a constant gradient about a centre (rigid and affine fields)."""

    translation: tuple
    gradient: tuple
    centre: tuple

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.translation) + (x - np.array(self.centre)) @ np.array(self.gradient).T


@dataclass(frozen=True)
class Wave:
    """One component varies as a sine along one axis."""

    amplitude: float
    wavelength: float
    axis: int = 0
    component: int = 0

    def at(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x, dtype=float)
        out[..., self.component] = self.amplitude * np.sin(x[..., self.axis] * (2 * np.pi / self.wavelength))
        return out


@dataclass(frozen=True)
class Ball:
    """A stiff ball in a strained body: ``ratio`` of the strain inside, growing to all of it with the cube of the distance."""

    centre: tuple
    radius: float
    gradient: tuple
    ratio: float

    def at(self, x: np.ndarray) -> np.ndarray:
        away = x - np.array(self.centre)
        near = np.minimum(1.0, self.radius / np.maximum(np.sqrt((away**2).sum(-1)), 1e-12))
        return (1 - (1 - self.ratio) * near**3)[..., None] * (away @ np.array(self.gradient).T)


KINDS = ("rigid", "affine", "sinusoid", "inclusion")


def default_field(kind: str, shape: tuple[int, int, int]) -> Field:
    """The synthetic cases' fields for a volume of ``shape`` (x, y, z), scaled so that no displacement passes about 3 voxels."""
    last = np.array(shape, float) - 1
    centre, half = tuple(last / 2), last.min() / 2
    g = 1.5 / half
    # Fixed values of the cases: translations in voxels, angles and strains in units of g.
    if kind == "rigid":
        turn = deformation(np.array([[0, 0, 0, 0.6 * g, -0.5 * g, 0.7 * g]]))[0] - np.eye(3)
        return Uniform((1.6, -0.9, 0.7), tuple(map(tuple, turn)), centre)
    if kind == "affine":
        return Uniform((1.2, -0.4, 0.3), tuple(map(tuple, stretch(np.array([[0.8, -0.5, 0.4, 0.2, 0.0, -0.3]]) * g)[0])), centre)
    if kind == "sinusoid":
        return Wave(1.0, float(shape[0]))
    if kind == "inclusion":
        return Ball(centre, half / 3, tuple(map(tuple, stretch(np.array([[1.5, -0.75, -0.75, 0.0, 0.0, 0.0]]) * g)[0])), 0.2)
    raise ValueError(f"unknown field kind {kind!r}: one of {', '.join(KINDS)}")


def hermite_tricubic(taps: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Tricubic interpolation by 64 coefficients: the polynomial whose value, slopes and mixed slopes at the eight corners of the
    middle cell are those of central differences of ``taps`` (n, 4, 4, 4; z, y, x). ``t``: (n, 3) places in the cell (x, y, z).

    A check of the separable weights: both describe the same polynomial.
    """
    power = np.arange(4)
    corner = {0: (0.0**power, power * 0.0 ** np.maximum(power - 1, 0)), 1: (np.ones(4), power.astype(float))}
    # Value and slope at the cell's ends from four taps in a row.
    data = np.array([[0, 1, 0, 0], [-0.5, 0, 0.5, 0], [0, 0, 1, 0], [0, -0.5, 0, 0.5]])
    rows = np.array([corner[0][0], corner[0][1], corner[1][0], corner[1][1]])
    whole = np.kron(rows, np.kron(rows, rows))  # 64 conditions on 64 coefficients
    given = np.kron(data, np.kron(data, data)) @ taps.reshape(len(taps), 64).T
    coefficients = np.linalg.solve(whole, given).T.reshape(-1, 4, 4, 4)
    x, y, z = (t[:, a, None] ** power for a in range(3))
    return np.einsum("nkji,nk,nj,ni->n", coefficients, z, y, x)
