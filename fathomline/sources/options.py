"""Options of a run: defaults in code, overridden by `section: key: value` text.

Only what the texts use is read: nested keys by indentation, scalars, and lists in brackets.
"""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    # The defaults in code.
    window_sec: float = 1.5
    gnss_rate_hz: float = 10.0
    min_speed_mps: float = 2.0
    fusion_open_height: float = 160.0
    fusion_anchor_min_used_points: int = 180
    fusion_anchor_max_age_sec: float = 3.0
    fusion_imu_only_max_duration_sec: float = 15.0
    kf_process_xy_rw_sigma_m_sqrt_s: float = 0.35
    kf_visual_min_xy_sigma_m: float = 2.0
    kf_visual_adaptive_enable: bool = True
    kf_visual_nis_gate: float = 16.266
    imu_preintegration_max_gap_sec: float = 0.05
    map_path: str = ""
    dem_path: str = ""


def parse(text: str) -> dict[str, object]:
    """Leaf keys and their values; a later key overrides an earlier one."""
    out: dict[str, object] = {}
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        key, mark, value = body.strip().partition(":")
        value = value.strip().strip("'\"")
        if mark and value:
            out[key.strip()] = [float(v) for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else value
    return out


def load(path: str) -> Options:
    """Options of a file; a missing file gives the defaults; relative paths are taken from the file's folder."""
    if not os.path.exists(path):
        return Options()
    with open(path) as lines:
        found = parse(lines.read())
    changes: dict[str, object] = {}
    for f in fields(Options):
        if f.name not in found:
            continue
        value, default = found[f.name], f.default
        if isinstance(default, bool):
            changes[f.name] = str(value).lower() in {"1", "true", "yes", "on"}
        elif isinstance(default, (int, float)):
            changes[f.name] = type(default)(float(str(value)))
        else:
            text = str(value)
            changes[f.name] = text if not text or os.path.isabs(text) or not f.name.endswith("_path") else os.path.join(os.path.dirname(path), text)
    return dataclasses.replace(Options(), **changes)
