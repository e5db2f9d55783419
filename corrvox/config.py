"""Settings of a run: strict dataclasses, read from nested dicts (YAML or JSON) and checked on the driver."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import types
import typing
import warnings
from dataclasses import dataclass, field
from typing import Any

from corrvox.functions.kernels import KINDS, TAPS, Search, cube_offsets, sphere_offsets

Xyz = tuple[float, float, float]


@dataclass(frozen=True)
class Volumes:
    reference: str = ""
    deformed: str = ""
    raw_shape_xyz: tuple[int, int, int] | None = None
    raw_dtype: str | None = None
    raw_header_bytes: int = 0
    prefilter_sigma: float = 0.0


@dataclass(frozen=True)
class Subvolume:
    geometry: str = "sphere"
    size: float = 32.0
    n_samples: int = 2000
    aspect: Xyz = (1.0, 1.0, 1.0)
    seed: int = 0


@dataclass(frozen=True)
class SearchSettings:
    dof: int = 6
    objective: str = "znssd"
    interpolation: str = "tricubic"
    method: str = "fagn"
    obj_tol: float = 1e-5
    disp_tol: float = 1e-4
    max_iterations: int = 30
    disp_max: float = 10.0
    basin_radius: float = 0.0
    rigid_trans: Xyz = (0.0, 0.0, 0.0)
    threshold: Xyz | None = None
    report_convg_fail: bool = True


@dataclass(frozen=True)
class Seeding:
    strategy: str = "wavefront"
    start: Xyz | None = None
    neighbours: int = 25
    coarse_stride: int = 4
    shell_width: float | None = None
    repair_passes: int = 0


@dataclass(frozen=True)
class Cluster:
    """Results do not depend on these. ``tile_points``: tiles are leaves of a k-d tree of at most so many points (0: of a fixed
    size); ``task_mb``: what a task's images may take, a tile beyond it is refused before anything is solved."""

    tile: float = 256.0
    brick: int = 64
    tile_points: int = 0
    task_mb: int = 8192


@dataclass(frozen=True)
class RunConfig:
    volumes: Volumes = field(default_factory=Volumes)
    points: str = ""
    output: str = ""
    subvolume: Subvolume = field(default_factory=Subvolume)
    search: SearchSettings = field(default_factory=SearchSettings)
    seeding: Seeding = field(default_factory=Seeding)
    cluster: Cluster = field(default_factory=Cluster)
    num_points_to_process: int = 0

    def __post_init__(self) -> None:
        s, v, q = self.search, self.subvolume, self.seeding

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(v.geometry in ("cube", "sphere"), "subvolume.geometry must be cube or sphere")
        need(v.size > 0 and v.n_samples >= 1 and all(a > 0 for a in v.aspect), "subvolume.size, n_samples and aspect must be positive")
        need(s.dof in (3, 6, 12), "search.dof must be 3, 6 or 12")
        need(s.objective in KINDS, f"search.objective must be one of {', '.join(KINDS)}")
        need(s.interpolation in TAPS, f"search.interpolation must be one of {', '.join(TAPS)}")
        need(s.method == "fagn", "search.method: only fagn is implemented")
        need(1 <= s.max_iterations <= 255, "search.max_iterations must be 1 to 255")
        need(s.disp_max > 0 and s.obj_tol > 0 and s.disp_tol > 0 and s.basin_radius >= 0, "search tolerances and disp_max must be positive, basin_radius not negative")
        need(s.threshold is None or (s.threshold[0] <= s.threshold[1] and 0 <= s.threshold[2] <= 1), "search.threshold must be (least, most, share)")
        need(q.strategy in ("rigid", "wavefront", "coarse"), "seeding.strategy must be rigid, wavefront or coarse")
        need(q.neighbours >= 1 and q.coarse_stride >= 1, "seeding.neighbours and coarse_stride must be positive")
        need(self.cluster.tile > 0 and self.cluster.brick >= 8, "cluster.tile must be positive, cluster.brick 8 at least")
        need(self.cluster.tile_points >= 0 and self.cluster.task_mb > 0, "cluster.tile_points must not be negative, cluster.task_mb must be positive")
        need(self.num_points_to_process >= 0, "num_points_to_process must not be negative")
        need(self.volumes.prefilter_sigma >= 0, "volumes.prefilter_sigma must not be negative")
        if q.repair_passes:
            warnings.warn("seeding.repair_passes has no effect", stacklevel=3)

    def halo(self) -> float:
        """How far around its points a tile reads."""
        v = self.subvolume
        far = math.sqrt(sum(a * a for a in v.aspect)) if v.geometry == "cube" else max(v.aspect)
        return v.size / 2 * far + self.search.disp_max + 2.0

    def offsets(self, seed: int | None = None):
        v = self.subvolume
        if v.geometry == "cube":
            return cube_offsets(v.n_samples, v.size, v.aspect)
        return sphere_offsets(v.n_samples, v.size, v.seed if seed is None else seed, v.aspect)

    def kernel(self) -> Search:
        s = self.search
        return Search(s.dof, s.objective, s.interpolation, s.obj_tol, s.disp_tol, s.max_iterations, s.disp_max, s.basin_radius, s.threshold, s.report_convg_fail)

    def fingerprint(self) -> dict[str, str]:
        """Dotted keys of all that decides the results, with a digest of the sample set."""
        out = {k: json.dumps(v) for k, v in flatten(dataclasses.asdict(self)).items() if not k.startswith(("output", "cluster"))}
        out["template"] = hashlib.sha256(self.offsets().astype("<f4").tobytes()).hexdigest()[:16]
        return out


def flatten(tree: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in tree.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def build(kind: Any, value: Any, where: str = "config") -> Any:
    """``value`` as the annotated type; unknown keys and wrong types are errors that name the key."""
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ValueError(f"{where}: expected a section")
        hints = typing.get_type_hints(kind)
        unknown = sorted(set(value) - set(hints))
        if unknown:
            raise ValueError(f"{where}: unknown keys {', '.join(unknown)}")
        return kind(**{k: build(hints[k], v, f"{where}.{k}") for k, v in value.items()})
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return None if value is None else build(next(a for a in args if a is not type(None)), value, where)
    if origin is tuple:
        if not isinstance(value, (list, tuple)) or len(value) != len(args):
            raise ValueError(f"{where}: expected {len(args)} values")
        return tuple(build(a, v, where) for a, v in zip(args, value, strict=True))
    if kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind is int and isinstance(value, float) and value.is_integer():
        return int(value)
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
        raise ValueError(f"{where}: expected {kind.__name__}, got {value!r}")
    return value


def load(path: str) -> RunConfig:
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return build(RunConfig, json.loads(text))
    import yaml

    return build(RunConfig, yaml.safe_load(text) or {})


def from_settings(s: dict[str, str]) -> RunConfig:
    """A run from the keys of a classic settings file."""
    need = "reference_filename correlate_filename point_cloud_filename output_filename vol_bit_depth vol_hdr_lngth vol_wide vol_high vol_tall subvol_geom subvol_size subvol_npts disp_max num_srch_dof obj_function interp_type".split()
    missing = [k for k in need if k not in s]
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")

    def num(key: str, whole: bool = False):
        try:
            x = float(s[key])
        except ValueError:
            raise ValueError(f"{key}: expected a number, got {s[key]!r}") from None
        if whole and not x.is_integer():
            raise ValueError(f"{key}: expected a whole number, got {s[key]!r}")
        return int(x) if whole else x

    def three(key: str) -> Xyz:
        parts = s[key].replace(",", " ").split()
        if len(parts) != 3:
            raise ValueError(f"{key}: expected 3 numbers, got {s[key]!r}")
        return tuple(float(p) for p in parts)

    depth = num("vol_bit_depth", True)
    if depth not in (8, 16):
        raise ValueError(f"vol_bit_depth: expected 8 or 16, got {depth}")
    order = ">" if s.get("vol_endian", "little") == "big" else "<"
    threshold = None
    if s.get("subvol_thresh", "off") == "on":
        threshold = (num("gray_thresh_min"), num("gray_thresh_max"), num("min_vol_fract") if "min_vol_fract" in s else 0.2)
    start = s.get("starting_point")
    return RunConfig(
        volumes=Volumes(s["reference_filename"], s["correlate_filename"], (num("vol_wide", True), num("vol_high", True), num("vol_tall", True)), f"{order}u{depth // 8}", num("vol_hdr_lngth", True)),
        points=s["point_cloud_filename"], output=s["output_filename"],
        subvolume=Subvolume(s["subvol_geom"], num("subvol_size"), num("subvol_npts", True), three("subvol_aspect") if "subvol_aspect" in s else (1.0, 1.0, 1.0)),
        search=SearchSettings(dof=num("num_srch_dof", True), objective=s["obj_function"], interpolation=s["interp_type"], disp_max=num("disp_max"), basin_radius=num("basin_radius") if "basin_radius" in s else 0.0, rigid_trans=three("rigid_trans") if "rigid_trans" in s else (0.0, 0.0, 0.0), threshold=threshold),
        seeding=Seeding(start=three("starting_point") if start else None), num_points_to_process=num("num_points_to_process", True) if "num_points_to_process" in s else 0,
    )
