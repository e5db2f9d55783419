import numpy as np
import pytest

from corrvox.functions import kernels as k
from corrvox.plans.correlate import wave_values

RNG = np.random.default_rng(0)
WAVES = np.column_stack([RNG.uniform(0.1, 0.5, (24, 3)) * RNG.choice([-1, 1], (24, 3)), RNG.uniform(0, 6.28, 24)])


def volume(n=40, back=None):
    z, y, x = np.meshgrid(*[np.arange(float(n))] * 3, indexing="ij")
    p = np.stack([x, y, z], -1)
    return k.Volume(wave_values(WAVES, p if back is None else back(p)))


REF = volume()
CENTRES = np.stack(np.meshgrid(*[np.array([14.0, 20.0, 26.0])] * 3), -1).reshape(-1, 3)


def solve(shift=(1.3, -0.7, 0.4), seeds=0.0, offsets=None, **search):
    d = volume(back=lambda p: p - np.array(shift))
    return k.solve(REF, d, CENTRES, np.full_like(CENTRES, seeds), k.cube_offsets(343, 12.0) if offsets is None else offsets, k.Search(**{"disp_max": 3.0} | search))


@pytest.mark.parametrize("kind", k.KINDS)
@pytest.mark.parametrize("dof", [3, 6, 12])
def test_recovers_a_shift(kind, dof):
    r = solve(objective=kind, dof=dof, obj_tol=1e-9)
    assert (r["status"] == 0).all() and np.abs(r["params"][:, :3] - (1.3, -0.7, 0.4)).max() < 0.02 and np.abs(r["params"][:, 3:]).max(initial=0) < 0.01


def test_statuses():
    assert (solve(max_iterations=1)["status"] == k.CONVG_FAIL).all()
    assert (solve(max_iterations=1, report_convg_fail=False)["status"] == k.GOOD).all()
    assert (solve(disp_max=0.5)["status"] == k.RANGE_FAIL).all()
    assert (solve(offsets=k.cube_offsets(27, 60.0))["status"] == k.RANGE_FAIL).all()
    assert (solve(threshold=(1e6, 2e6, 0.1))["status"] == k.THRESH_FAIL).all()
    assert (solve(interpolation="nearest")["status"] == k.SINGULAR).all()
    even = k.Volume(np.full((40, 40, 40), 7.0))
    r = k.solve(even, even, CENTRES, CENTRES * 0, k.cube_offsets(27, 8.0), k.Search())
    assert (r["status"] == k.SINGULAR).all() and np.isnan(r["objmin"]).all()
    bad = np.zeros((40, 40, 40))
    bad[:] = np.nan
    assert (k.solve(k.Volume(bad), REF, CENTRES, CENTRES * 0, k.cube_offsets(27, 8.0), k.Search())["status"] == k.SINGULAR).all()
    assert len(k.solve(REF, REF, CENTRES[:0], CENTRES[:0], k.cube_offsets(27, 8.0), k.Search())["status"]) == 0


def test_chunks_do_not_change_results(monkeypatch):
    a = solve(dof=6)
    monkeypatch.setattr(k, "CALL_SAMPLES", 343 * 2)
    b = solve(dof=6)
    assert all((a[n] == b[n]).all() for n in ("params", "status", "n_iter"))


@pytest.mark.parametrize("method", ["trilinear", "tricubic"])
def test_interpolation(method):
    z, y, x = np.meshgrid(*[np.arange(9.0)] * 3, indexing="ij")
    lin = k.Volume(1 + 2 * x - y + 0.5 * z)
    p = np.array([[[3.25, 4.5, 2.125], [2.0, 3.0, 4.0]]])
    v, g, ok = k.sample(lin, np.zeros((1, 3)), p, method, grad=True)
    assert ok.all() and np.allclose(v, 1 + 2 * p[..., 0] - p[..., 1] + 0.5 * p[..., 2]) and np.allclose(g, [2, -1, 0.5])
    _, _, ok = k.sample(lin, np.zeros((1, 3)), np.array([[[0.5, 4, 4], [7.5, 4, 4], [4, 4, 8.5], [np.nan, 1, 1]]]), method)
    assert ok.tolist() == [[method == "trilinear", method == "trilinear", False, False]]


def test_slopes_match_differences():
    p = RNG.normal(0, 0.1, (4, 12))
    s = k.deformation_slopes(p)
    for i in range(9):
        e = np.zeros(12)
        e[3 + i] = 1e-6
        assert np.allclose((k.deformation(p + e) - k.deformation(p - e)) / 2e-6, s[:, i], atol=1e-8)


def test_system_is_the_slope_of_the_criterion():
    f, g, j = RNG.normal(size=(3, 50)), RNG.normal(size=(3, 50)), RNG.normal(size=(3, 50, 4))
    for kind in ("ssd", "zssd", "nssd", "znssd"):
        q, _ = k.normalise(f, kind)
        h, b, _ = k.system(q, f, g, j, kind)
        scale = k.SCALE.get(kind, 1.0)
        for i in range(4):
            up, down = (k.criterion(f, g + e * j[:, :, i], kind) for e in (1e-6, -1e-6))
            assert np.allclose((up - down) / 2e-6, 2 * scale * b[:, i], rtol=1e-4, atol=1e-6)
        assert (np.linalg.eigvalsh(h) > 0).all()


def test_step():
    a = RNG.normal(size=(5, 6, 6))
    h, b = a @ np.swapaxes(a, 1, 2) + np.eye(6), RNG.normal(size=(5, 6))
    h[3, :, 5] = h[3, :, 4]
    h[3, 5, :] = h[3, 4, :]
    x, bad = k.step(h, b)
    assert bad.tolist() == [False] * 3 + [True, False] and (x[3] == 0).all()
    assert np.allclose((h[:3] @ x[:3, :, None])[..., 0], -b[:3])


def test_templates():
    assert len(k.cube_offsets(64, 10.0)) == 64 and len(k.cube_offsets(65, 10.0)) == 125 and (k.cube_offsets(1, 9.0) == 0).all()
    s = k.sphere_offsets(500, 10.0, 3)
    assert s.shape == (500, 3) and (np.sqrt((s**2).sum(1)) <= 5.00001).all() and (s == k.sphere_offsets(500, 10.0, 3)).all()
    assert (np.diff(s[:, 2]) >= 0).all()


def test_gaussian():
    a = np.zeros((15, 15, 15))
    a[7, 7, 7] = 1
    out = k.gaussian(a, 0.8)
    assert out.sum() == pytest.approx(1) and out[7, 7, 7] == out.max() and np.allclose(out, out.transpose(2, 1, 0))
    assert np.allclose(k.gaussian(np.full((4, 4, 4), 3.0), 1.0), 3)
