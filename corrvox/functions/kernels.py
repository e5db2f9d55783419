"""Dense numerics of one batch of points in float64 numpy: interpolation, warps, criteria, Gauss-Newton.

Arrays are (points, samples, ...). Volumes are (z, y, x); points and vectors are (x, y, z).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

GOOD, RANGE_FAIL, CONVG_FAIL, NOT_SEARCHED, THRESH_FAIL, SINGULAR = 0, -1, -2, -3, -4, -5
SCALE = {"nssd": 0.5, "znssd": 0.25}
CENTRED, NORMALISED = ("zssd", "znssd"), ("nssd", "znssd")
KINDS = ("sad", "ssd", "zssd", "nssd", "znssd")
TAPS = {"nearest": (0, 0), "trilinear": (0, 1), "tricubic": (1, 2)}
FLAT, PIVOT, FEATURELESS = 1e-12, 1e-10, 1e-12
CALL_SAMPLES = 1 << 13


@dataclass(frozen=True)
class Search:
    dof: int = 3
    objective: str = "znssd"
    interpolation: str = "tricubic"
    obj_tol: float = 1e-5
    disp_tol: float = 1e-4
    max_iterations: int = 30
    disp_max: float = 10.0
    basin_radius: float = 0.0
    threshold: tuple[float, float, float] | None = None  # least and most grey level, least share
    report_convg_fail: bool = True

    def __post_init__(self) -> None:
        if self.dof not in (3, 6, 12) or self.objective not in KINDS or self.interpolation not in TAPS:
            raise ValueError("unknown dof, objective or interpolation")
        if not 1 <= self.max_iterations <= 255 or self.disp_max <= 0 or self.basin_radius < 0:
            raise ValueError("max_iterations must be 1 to 255, disp_max positive, basin_radius not negative")


@dataclass
class Volume:
    """A part of an image: ``data[0, 0, 0]`` is voxel ``origin`` (x, y, z)."""

    data: np.ndarray
    origin: tuple[int, int, int] = (0, 0, 0)
    flat: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.data = np.ascontiguousarray(self.data, np.float64)
        self.flat = self.data.reshape(-1)


def axis_weights(t: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and derivative weights of the taps, taps first."""
    if method == "trilinear":
        one = np.ones_like(t)
        return np.stack([one - t, t]), np.stack([-one, one])
    t2 = t * t
    t3 = t2 * t
    w = np.stack([2 * t2 - t3 - t, 3 * t3 - 5 * t2 + 2, t + 4 * t2 - 3 * t3, t3 - t2])
    d = np.stack([4 * t - 3 * t2 - 1, 9 * t2 - 10 * t, 1 + 8 * t - 9 * t2, 3 * t2 - 2 * t])
    return w / 2, d / 2


def sample(vol: Volume, centres: np.ndarray, moved: np.ndarray, method: str, grad: bool = False):
    """Values (B, M), gradients (B, M, 3) or None, and whether each sample's taps lie inside."""
    nz, ny, nx = vol.data.shape
    dims = np.array([nx, ny, nz])
    rel = centres - np.array(vol.origin, float)
    whole = np.floor(rel)
    local = (rel - whole)[:, None] + moved
    if method == "nearest":
        base = np.floor(local + 0.5)
    else:
        base = np.floor(local)
    with np.errstate(invalid="ignore"):
        at = base.astype(np.int64) + whole.astype(np.int64)[:, None]
    before, after = TAPS[method]
    ok = np.isfinite(local).all(-1) & (at >= before).all(-1) & (at + after <= dims - 1).all(-1)
    at = np.clip(at, before, np.maximum(dims - 1 - after, before)).reshape(-1, 3)
    if method == "nearest":
        v = vol.flat[(at[:, 2] * ny + at[:, 1]) * nx + at[:, 0]].reshape(ok.shape)
        return v, np.zeros((*ok.shape, 3)) if grad else None, ok
    n = before + after + 1
    frac = np.where(ok[..., None], local - base, 0.0).reshape(-1, 3)
    corner = ((at[:, 2] - before) * ny + at[:, 1] - before) * nx + at[:, 0] - before
    (wx, dx), (wy, dy), (wz, dz) = (axis_weights(frac[:, a], method) for a in range(3))
    n_at = len(corner)
    value, g = np.zeros(n_at), np.zeros((3, n_at)) if grad else None
    index, tap, part = np.empty(n_at, np.int64), np.empty(n_at), np.empty(n_at)
    row, row_x, plane, plane_x, plane_y = (np.empty(n_at) for _ in range(5))

    def gather(into: np.ndarray, factor: np.ndarray, what: np.ndarray, first: bool) -> None:
        if first:
            np.multiply(what, factor, out=into)
        else:
            np.multiply(what, factor, out=part)
            into += part

    for k in range(n):
        for j in range(n):
            np.add(corner, (k * ny + j) * nx, out=index)
            for i in range(n):
                np.take(vol.flat, index, out=tap, mode="clip")  # the places are inside; the mode spares a copy
                index += 1
                gather(row, wx[i], tap, not i)
                if grad:
                    gather(row_x, dx[i], tap, not i)
            gather(plane, wy[j], row, not j)
            if grad:
                gather(plane_x, wy[j], row_x, not j)
                gather(plane_y, dy[j], row, not j)
        gather(value, wz[k], plane, False)
        if grad:
            for into, factor, what in zip(g, (wz[k], wz[k], dz[k]), (plane_x, plane_y, plane), strict=True):
                gather(into, factor, what, False)
    return value.reshape(ok.shape), None if g is None else np.moveaxis(g, 0, -1).reshape(*ok.shape, 3), ok


def _turns(angles: np.ndarray, slope: bool) -> list[np.ndarray]:
    """The factors about x, y and z of the direction-cosine matrix for (phi, the, psi), or their derivatives."""
    out = []
    for axis, a in ((0, angles[:, 2]), (1, angles[:, 1]), (2, angles[:, 0])):
        i, j = (axis + 1) % 3, (axis + 2) % 3
        c, s = (-np.sin(a), np.cos(a)) if slope else (np.cos(a), np.sin(a))
        m = np.zeros((len(a), 3, 3))
        m[:, axis, axis] = 0.0 if slope else 1.0
        m[:, i, i] = m[:, j, j] = c
        m[:, i, j], m[:, j, i] = s, -s
        out.append(m)
    return out


def stretch(strains: np.ndarray) -> np.ndarray:
    e = np.zeros((len(strains), 3, 3))
    for k, (i, j) in enumerate(((0, 0), (1, 1), (2, 2), (0, 1), (1, 2), (0, 2))):
        e[:, i, j] = e[:, j, i] = strains[:, k]
    return e


def deformation(params: np.ndarray) -> np.ndarray:
    """(I + E) R of each row of parameters."""
    eye = np.broadcast_to(np.eye(3), (len(params), 3, 3))
    if params.shape[1] == 3:
        return eye.copy()
    x, y, z = _turns(params[:, 3:6], False)
    r = x @ y @ z
    return r if params.shape[1] == 6 else (eye + stretch(params[:, 6:])) @ r


def deformation_slopes(params: np.ndarray) -> np.ndarray:
    """Derivatives of the deformation by the parameters after the translation, (B, dof - 3, 3, 3)."""
    if params.shape[1] == 3:
        return np.zeros((len(params), 0, 3, 3))
    x, y, z = _turns(params[:, 3:6], False)
    sx, sy, sz = _turns(params[:, 3:6], True)
    turn = np.stack([x @ y @ sz, x @ sy @ z, sx @ y @ z], 1)
    if params.shape[1] == 6:
        return turn
    r = x @ y @ z
    unit = stretch(np.eye(6))  # dE / d strain
    return np.concatenate([(np.eye(3) + stretch(params[:, 6:]))[:, None] @ turn, unit[None] @ r[:, None]], 1)


def normalise(v: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    if kind in CENTRED:
        v = v - v.mean(1, keepdims=True)
    n = np.sqrt((v * v).sum(1))
    n = np.where((n > 0) & (kind in NORMALISED), n, 1.0)
    return v / n[:, None], n


def criterion(f: np.ndarray, g: np.ndarray, kind: str) -> np.ndarray:
    if kind == "sad":
        return np.abs(g - f).sum(1)
    r = normalise(g, kind)[0] - normalise(f, kind)[0]
    return SCALE.get(kind, 1.0) * (r * r).sum(1)


def system(q: np.ndarray, f: np.ndarray, g: np.ndarray, jac: np.ndarray, kind: str):
    """H, b and the criterion: ``jac`` (B, M, dof) is the slope of g, ``q`` the reference term.

    The slope of the normalised target is what is left of ``jac`` without its mean and its part along the target.
    """
    unit, n = normalise(g, kind)
    if kind in CENTRED:
        jac = jac - jac.mean(1, keepdims=True)
    if kind in NORMALISED:
        jac = (jac - unit[:, :, None] * (unit[:, None] @ jac)) / n[:, None, None]
    r = unit - q
    jt = np.swapaxes(jac, 1, 2)
    value = np.abs(g - f).sum(1) if kind == "sad" else SCALE.get(kind, 1.0) * (r * r).sum(1)
    return jt @ jac, (jt @ r[:, :, None])[..., 0], value


def step(h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """dp of H dp = -b, and which systems are singular by the pivots of the unit-diagonal Cholesky."""
    n = h.shape[1]
    diag = np.einsum("bii->bi", h)
    bad = ~(diag > 0).all(1)
    s = 1 / np.sqrt(np.where(diag > 0, diag, 1.0))
    a = np.where(np.isfinite(h), h, 0.0) * s[:, :, None] * s[:, None]
    rest = a.copy()
    for j in range(n):  # eliminate a column at a time; what is left of the diagonal are the pivots
        pivot = rest[:, j, j].copy()
        bad |= ~(pivot > PIVOT)
        col = rest[:, j + 1 :, j] / np.where(pivot > PIVOT, pivot, 1.0)[:, None]
        rest[:, j + 1 :, j + 1 :] -= col[:, :, None] * rest[:, j, j + 1 :][:, None]
    a[bad] = np.eye(n)
    x = np.linalg.solve(a, (-b * s)[:, :, None])[..., 0] * s
    return np.where(bad[:, None], 0.0, x), bad


def flat(f: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return ~(f.max(1) - f.min(1) > FLAT * np.abs(f).max(1))


def translations(search: Search) -> np.ndarray:
    """The grid of translations of a basin search, z slowest."""
    n = max(1, math.floor(search.disp_max / search.basin_radius))
    a = np.arange(-n, n + 1) * (search.disp_max / n)
    z, y, x = np.meshgrid(a, a, a, indexing="ij")
    return np.stack([x.ravel(), y.ravel(), z.ravel()], 1)


def best_translation(vol: Volume, f: np.ndarray, centres: np.ndarray, seeds: np.ndarray, offsets: np.ndarray, search: Search) -> np.ndarray:
    """Of each point the grid translation with the least criterion; the first of equals; outside never."""
    best, at = np.full(len(f), np.inf), seeds.copy()
    for t in translations(search):
        g, _, ok = sample(vol, centres, (seeds + t)[:, None] + offsets[None], search.interpolation)
        v = np.where(ok.all(1), criterion(f, g, search.objective), np.inf)
        better = v < best
        best[better] = v[better]
        at[better] = (seeds + t)[better]
    return at


def solve(ref: Volume, moved: Volume, centres: np.ndarray, seeds: np.ndarray, offsets: np.ndarray, search: Search) -> dict[str, np.ndarray]:
    """params, status, objmin and n_iter of each point, a bounded number of samples at a time. Points that agree bit by bit in
    place and seed have one answer, which is found once."""
    bits = np.ascontiguousarray(np.concatenate([centres, seeds], 1), np.float64).view(np.int64)
    _, first, copy = np.unique(bits, axis=0, return_index=True, return_inverse=True)
    centres, seeds, copy = centres[first], seeds[first], copy.reshape(-1)
    many = max(1, CALL_SAMPLES // max(1, len(offsets)))
    out = States(np.zeros((len(centres), search.dof)), np.zeros(len(centres), np.int8), np.full(len(centres), np.nan), np.zeros(len(centres), np.int16))
    for k in range(0, len(centres), many):
        own = slice(k, k + many)
        Batch(ref, moved, centres[own], seeds[own], offsets, search, out.part(own)).run()
    return {"params": out.params[copy], "status": out.status[copy], "objmin": out.objmin[copy], "n_iter": out.n_iter[copy]}


@dataclass
class States:
    """What is known of each point; parts are views."""

    params: np.ndarray
    status: np.ndarray
    objmin: np.ndarray
    n_iter: np.ndarray

    def part(self, own: slice) -> States:
        return States(self.params[own], self.status[own], self.objmin[own], self.n_iter[own])

    def settle(self, at: np.ndarray, *rules: tuple[np.ndarray, int]) -> np.ndarray:
        """Each point of ``at`` gets the status of the first rule that holds for it; returns the points that none holds for."""
        free = np.ones(len(at), bool)
        for holds, code in rules:
            self.status[at[free & holds]] = code
            free &= ~holds
        return at[free]


class Batch:
    """Gauss-Newton for a few points at once. ``run`` takes them through reference, start, steps and end; each stage settles
    the points that a status rule holds for and hands on the others."""

    def __init__(self, ref: Volume, moved: Volume, centres: np.ndarray, seeds: np.ndarray, offsets: np.ndarray, search: Search, states: States) -> None:
        self.ref, self.moved, self.centres, self.seeds, self.offsets, self.search, self.states = ref, moved, centres, seeds, offsets, search, states
        states.params[:, :3] = seeds

    def run(self) -> None:
        live = self.start(self.reference(np.arange(len(self.centres))))
        ended, before = [], np.full(len(self.centres), np.inf)
        for _ in range(self.search.max_iterations):
            if not len(live):
                break
            live, near = self.step(live, before)
            ended.append(live[near])
            live = live[~near]
        self.states.status[live] = CONVG_FAIL if self.search.report_convg_fail else GOOD
        self.end(np.sort(np.concatenate([live, *ended])))

    def reference(self, at: np.ndarray) -> np.ndarray:
        """The reference samples, and the terms that stay as they are."""
        self.f, _, ok = sample(self.ref, self.centres, np.broadcast_to(self.offsets, (len(at), *self.offsets.shape)), self.search.interpolation)
        self.q, _ = normalise(self.f, self.search.objective)
        dim = np.zeros(len(at), bool)
        if self.search.threshold is not None:
            low, high, share = self.search.threshold
            dim = ((self.f >= low) & (self.f <= high)).mean(1) < share
        return self.states.settle(at, (~ok.all(1), RANGE_FAIL), (dim, THRESH_FAIL), (flat(self.f), SINGULAR))

    def start(self, at: np.ndarray) -> np.ndarray:
        if self.search.basin_radius > 0 and len(at):
            self.states.params[at, :3] = best_translation(self.moved, self.f[at], self.centres[at], self.states.params[at, :3], self.offsets, self.search)
        return at

    def look(self, at: np.ndarray, grad: bool):
        """The deformed image at the moved samples: values, gradients, and whether a point's samples are all inside."""
        p = self.states.params[at]
        places = p[:, None, :3] + self.offsets[None] @ np.swapaxes(deformation(p), 1, 2)
        g, slope, ok = sample(self.moved, self.centres[at], places, self.search.interpolation, grad=grad)
        return g, slope, ok.all(1)

    def jacobian(self, at: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """How the samples change with the parameters."""
        if self.search.dof == 3:
            return slope
        turned = np.einsum("bkij,mj->bmki", deformation_slopes(self.states.params[at]), self.offsets, optimize=True)
        return np.concatenate([slope, (turned @ slope[..., None])[..., 0]], 2)

    def step(self, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One update. Returns the points that go on, and which of them changed so little that they are done."""
        st, search = self.states, self.search
        g, slope, inside = self.look(at, True)
        h, b, value = system(self.q[at], self.f[at], g, self.jacobian(at, slope), search.objective)
        move, singular = step(h, b)
        singular |= ~((slope * slope).sum((1, 2)) > FEATURELESS * (g * g).sum(1))
        st.objmin[at[inside]] = value[inside]
        able = inside & ~singular
        st.params[at[able]] += move[able]
        st.n_iter[at[able]] += 1
        far = able & (np.abs(st.params[at, :3] - self.seeds[at]).max(1) > search.disp_max)
        near = (np.abs(value - before[at]) < search.obj_tol) | (np.linalg.norm(move[:, :3], axis=1) < search.disp_tol)
        before[at] = value
        st.settle(at, (~inside, RANGE_FAIL), (singular, SINGULAR), (far, RANGE_FAIL))
        on = able & ~far
        return at[on], near[on]

    def end(self, at: np.ndarray) -> None:
        """The criterion at the last parameters decides what an ended point is worth."""
        st = self.states
        at = st.settle(at, (~np.isfinite(st.params[at]).all(1), SINGULAR))
        if len(at):
            g, _, inside = self.look(at, False)
            st.objmin[at] = criterion(self.f[at], g, self.search.objective)
            st.settle(at, (~inside, RANGE_FAIL), (~np.isfinite(st.objmin[at]) | flat(g), SINGULAR))


def cube_offsets(n_samples: int, size: float, aspect=(1.0, 1.0, 1.0)) -> np.ndarray:
    """A cube of the least k**3 samples that is enough, z slowest."""
    k = 1
    while k**3 < n_samples:
        k += 1
    a = np.linspace(-1, 1, k) if k > 1 else np.zeros(1)
    z, y, x = np.meshgrid(a, a, a, indexing="ij")
    return (np.stack([x.ravel(), y.ravel(), z.ravel()], 1) * (0.5 * size * np.asarray(aspect))).astype(np.float32).astype(np.float64)


def sphere_offsets(n_samples: int, size: float, seed: int = 0, aspect=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Uniform samples of a ball by rejection (fixed draw sizes and generator, so sample sets can be compared), z slowest."""
    rng, kept, have = np.random.Generator(np.random.MT19937(seed)), [], 0
    while have < n_samples:
        draw = rng.uniform(-1.0, 1.0, size=(2 * (n_samples - have) + 64, 3))
        kept.append(draw[(draw * draw).sum(1) <= 1.0])
        have += len(kept[-1])
    o = np.concatenate(kept)[:n_samples] * (0.5 * size * np.asarray(aspect))
    return o[np.lexsort((o[:, 0], o[:, 1], o[:, 2]))].astype(np.float32).astype(np.float64)


def gaussian(data: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of radius ceil(4 sigma), edges repeated."""
    if sigma <= 0:
        return data
    r = math.ceil(4 * sigma)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    out = np.asarray(data, float)
    for axis in range(3):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
        out = sum(w[k] * np.take(wide, np.arange(k, k + data.shape[axis]), axis) for k in range(2 * r + 1))
    return out
