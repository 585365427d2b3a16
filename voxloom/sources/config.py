"""Run configuration from YAML; every key is optional."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from voxloom.functions.text import expand_home


@dataclass
class RunConfig:
    log: str = ""
    calib: str = ""
    cam: int = 211
    out: str = ""
    start: int = 0
    count: int = 50
    stride: int = 1
    voxel: float = 0.05
    radius: float = 0.0
    proj_radius: float = 0.0
    tau: float = 0.1
    splat: int = 1
    splat_mult: float = 0.0
    splat_min: int = 2
    surf_band: float = 0.0
    things_only: bool = False
    thing: list[str] = field(default_factory=lambda: ["door", "chair", "table", "person", "trash can", "box", "monitor", "shelf", "window"])
    stuff: list[str] = field(default_factory=lambda: ["wall", "floor", "ceiling"])
    dynamic: list[str] = field(default_factory=list)
    endpoint: str = ""
    viz_endpoint: str = ""
    voting: dict = field(default_factory=dict)
    superpoints: dict = field(default_factory=dict)
    hdbscan: dict = field(default_factory=dict)
    grow: dict = field(default_factory=dict)
    objects: dict = field(default_factory=dict)
    sign: dict = field(default_factory=dict)
    viz: dict = field(default_factory=dict)


#: What a section's keys are where the file says nothing.
SECTIONS: dict[str, dict[str, Any]] = {
    "voting": {"enabled": False, "stuff_bias": 2.0, "min_votes": 1, "min_conf": 0.0},
    "superpoints": {"enabled": False, "seed": 0.60, "thing_frac": 0.5, "spatial": 0.4, "normal": 1.0, "refine": 0},
    "hdbscan": {"enabled": False, "min_pts": 15, "min_cluster_size": 50, "min_class_points": 50, "allow_single_cluster": True, "leaf_selection": False, "single_scan": True, "sor_enabled": False, "sor_mean_k": 16, "sor_std_mul": 1.0, "split_radius": 0.25},
    "grow": {"enabled": False, "affinity": 0.5, "require_class": True, "neighbor_pool": False, "sweeps": 1, "dis_decay": 0.5, "pool_k": 6},
    "objects": {"enabled": False, "merge_thresh": [0.5, 0.35, 0.25, 0.2], "min_merges": 3, "require_class": True, "consol_stride": 1, "global_context": False, "min_evidence": 2.0, "dis_decay": 0.5, "use_semantic_affinity": True, "use_containment": True, "small_seg_min": 0, "overlap_sets": False},
    "sign": {"enabled": False, "vlm_url": "http://localhost:8080/v1", "classes": ["sign"], "min_px": 60, "workers": 1, "queue": 4, "mock_delay_ms": 1500, "mock_text": "MOCK: toilet -> left; exit -> right"},
    "viz": {"endpoint": "", "seg_overlay": "both", "seg_alpha": 0.5, "seg_min_area": 80},
}


def from_dict(root: dict[str, Any]) -> RunConfig:
    """Keys that a section or the file lacks keep their defaults; values take the defaults' types."""
    root = {k: v for k, v in (root or {}).items() if v is not None}
    out = RunConfig()
    for name, value in vars(out).copy().items():
        if name in SECTIONS:
            given = {k: v for k, v in (root.get(name) or {}).items() if v is not None}
            setattr(out, name, {k: type(d)(given.get(k, d)) for k, d in SECTIONS[name].items()})
        elif name in root:
            setattr(out, name, type(value)(root[name]))
    out.log, out.calib = expand_home(out.log), expand_home(out.calib)
    out.stride = max(1, out.stride)
    out.viz_endpoint = out.viz_endpoint or out.viz["endpoint"]
    # One switch for overlapping sets governs seeding, growing and merging.
    for section in ("hdbscan", "grow"):
        getattr(out, section)["overlap_sets"] = out.objects["overlap_sets"]
    return out


def load(path: str) -> RunConfig:
    """From a YAML file.  Needs the yaml package."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package yaml; use from_dict()") from e
    with open(expand_home(path)) as f:
        return from_dict(yaml.safe_load(f) or {})
