"""Queries of the trajectory operators and the SQL that checks them."""

from __future__ import annotations

from fathomline.plans import q_calibration, q_composites, q_frames, q_fusion, q_geometry, q_ingest, q_motion, q_sync, q_tracks

MODULES = (q_tracks, q_frames, q_fusion, q_composites, q_ingest, q_motion, q_geometry, q_sync, q_calibration)
FLAGSHIP = "traj_error_summary"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
