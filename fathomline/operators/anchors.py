"""Anchors for fixes: which accepted vision position each fix is propagated from.

A vehicle's anchors and fixes are folded in time order (anchors first at equal times).  An anchor is
adopted at the first fix not before it, if it isn't stale there, passes the quality gate, and isn't
farther from the active anchor than the innovation gate; the last accepted one is active.  It expires
when it is older than max_age at a fix.  Where fixes say up to when nothing can be propagated to them, an
anchor that would have to be is lost at that fix.  At the first fix with a closed gate all anchors so far
are forgotten; fixes give no row while it is closed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.vision import reject_reason
from fathomline.plans.fold import fold_sorted


@dataclass(frozen=True)
class Gates:
    min_used: int = 20
    min_ratio: float = 0.2
    max_reproj: float = 6.0
    max_age: float = 3.0
    innovation: float = 80.0


@dataclass
class _State:
    pending: list
    active: tuple | None = None
    rejected: int = 0
    reason: str | None = None
    open: bool = True
    since: float = -math.inf  # what was propagated last: the anchor or a fix


#: Reason of a fix whose anchor couldn't be propagated.
FAILED = "imu_preintegration_failed"


def assign(anchors: DataFrame, fixes: DataFrame, gates: Gates | None = None, by: str = "vehicle_id") -> DataFrame:
    """by, t, seq of every fix with anchor_seq, anchor_t, age, rejected (so far), reason (of the last rejection or expiry) and lost.

    anchors: by, t, seq, east, north, used, inlier_ratio, reproj, and headed (false: can't be propagated); fixes: by, t,
    seq, is_open (of the gate; open where it lacks), and fail_before with first_state: what is propagated from earlier than fail_before fails, and nothing moves before first_state.
    """
    g = gates or Gates()
    quality = reject_reason(F.col("used"), F.col("inlier_ratio"), F.col("reproj"), g.min_used, g.min_ratio, g.max_reproj)
    none = F.lit(None)
    headed = F.coalesce("headed", F.lit(False)) if "headed" in anchors.columns else F.lit(True)
    one = anchors.select(
        by, "t", F.lit(0).alias("kind"), F.col("seq").cast("long"), F.col("east").cast("double"), F.col("north").cast("double"), quality.alias("bad"),
        none.cast("double").alias("fail_before"), none.cast("double").alias("first_state"), headed.alias("headed"), F.lit(True).alias("is_open"),
    )
    shown = F.coalesce("is_open", F.lit(False)) if "is_open" in fixes.columns else F.lit(True)
    moving = "fail_before" in fixes.columns
    other = fixes.select(
        by, "t", F.lit(1).alias("kind"), F.col("seq").cast("long"), none.cast("double").alias("east"), none.cast("double").alias("north"), none.cast("string").alias("bad"),
        *(F.col(c).cast("double").alias(c) if moving else none.cast("double").alias(c) for c in ("fail_before", "first_state")), F.lit(True).alias("headed"), shown.alias("is_open"),
    )

    def step(state, row):
        _, t, kind, seq, east, north, bad, fail_before, first_state, headed, is_open = row
        state = state or _State([])
        if kind == 0:
            state.pending.append((t, seq, east, north, bad, headed))
            return state, []

        if not is_open:
            if state.open:
                state = _State([], open=False)
            return state, []
        state.open = True

        def expire() -> None:
            if state.active and 0 < g.max_age < max(0.0, t - state.active[0]):
                state.active, state.reason = None, "visual_anchor_expired"

        expire()
        for anchor in state.pending:
            why = anchor[4]
            if 0 < g.max_age < t - anchor[0]:
                why = "anchor_rejected_stale"
            elif why is None and state.active and math.hypot(anchor[2] - state.active[2], anchor[3] - state.active[3]) > g.innovation > 0:
                why = "anchor_rejected_large_innovation"
            if why is None:
                state.active, state.reason, state.since = anchor, None, anchor[0]
            else:
                state.rejected, state.reason = state.rejected + 1, why
        state.pending = []
        expire()
        a, lost = state.active, False
        if a and moving:
            known = first_state is not None and first_state == first_state
            start = max(state.since, first_state) if known else state.since
            lost = t > start + 1e-9 and not (known and a[5] and not start < fail_before - 1e-9)
            state.since = t
            if lost:
                state.active, state.reason = None, FAILED
        return state, [(row[0], t, seq, a[1] if a else None, a[0] if a else None, t - a[0] if a else None, state.rejected, state.reason, lost)]

    kind = fixes.schema[by].dataType.simpleString()
    out = f"{by} {kind},t double,seq bigint,anchor_seq bigint,anchor_t double,age double,rejected bigint,reason string,lost boolean"
    return fold_sorted(one.unionByName(other), by, ["t", "kind", "seq"], step, out)
