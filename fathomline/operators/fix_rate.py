"""The fused position at every fix: propagated from the active anchor, or the running filter's where there is none.

Every fix takes its anchor (`anchors.assign`).  From there the vehicle is carried from fix to fix by
preintegration, errors adding up until the next anchor; the pieces of an anchor's fixes are folded in
order by one expression, a row of at most max_age seconds, and anchors are independent of each other.
Where preintegration fails the anchor is lost: the fix says so, later fixes have no anchor until the
next one, and that one needn't be near the lost one.

Defined results: fixes while the gate is closed have a reason only; fixes with a value that isn't finite
are passed over by `ingest.valid_fixes` before; null keys are one key; (by, seq) tells fixes apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.functions import rotations as rot
from fathomline.functions.angles import wrap_to_pi, wrap_to_two_pi
from fathomline.operators import anchors as anchor_rules
from fathomline.operators import asof
from fathomline.operators import preintegration as pre

FAILED = anchor_rules.FAILED


def anchors_of(records: DataFrame, headings: DataFrame | None = None, by: str = "vehicle_id") -> DataFrame:
    """Anchors from finished frames (by, t, seq, localized, lon, lat, alt, fused_lon, fused_lat, fused_alt, fused_vel, yaw_deg, used, inliers, reproj).

    The position is the frame's own if finite, else the fused one; the velocity is the fused one if it and
    the fused position are finite, else zero; the heading is the frame's, else the estimate (by, t, heading) before it.
    """
    own = geo.finite(F.col("lon"), F.col("lat"), F.col("alt"))
    fused = geo.finite(F.col("fused_lon"), F.col("fused_lat"), F.col("fused_alt"))
    kept = records.where(F.coalesce("localized", F.lit(False)) & geo.finite(F.col("t")) & (own | fused))
    place = {c: F.when(own, F.col(c)).otherwise(F.col(f"fused_{c}")) for c in ("lon", "lat", "alt")}
    kept = kept.withColumns({**place, "vel": F.when(fused & rot.all_finite(F.col("fused_vel")), F.col("fused_vel")).otherwise(F.expr(pre.ZEROS))})
    if headings is not None:
        kept = asof.latest(kept, headings, ["heading"], by=by)
    estimate = F.col("ref_heading") if headings is not None else F.lit(None).cast("double")
    heading = F.when(geo.finite(F.col("yaw_deg")), F.radians("yaw_deg")).otherwise(estimate)
    ratio = F.when(F.col("used") > 0, F.col("inliers") / F.col("used"))
    return kept.select(by, "t", "seq", "lon", "lat", "alt", "vel", wrap_to_two_pi(heading).alias("heading"), "used", ratio.alias("inlier_ratio"), "reproj")


def propagable(fixes: DataFrame, states: DataFrame, limits: pre.Limits, by: str = "vehicle_id", width: float = 60.0) -> DataFrame:
    """fixes with first_state (time of the vehicle's first state) and fail_before: what starts earlier can't be carried to the fix, for a gap lies between.

    A piece (a, b) longer than max_gap stops everything that starts before b - max_gap; the last such piece at a fix is the one from
    the last state to the fix, or else the last one between states.
    """
    pairs = asof.neighbours(states.select(by, "t", "seq"), states, [], by=by, width=width)
    long = pairs.where(F.col("t") - F.col("before.t") > limits.max_gap + pre.SAME).select(by, "t", "seq", (F.col("t") - limits.max_gap).alias("stops"))
    seen = asof.latest(asof.latest(fixes, states.withColumn("own_t", F.col("t")), ["own_t"], by=by, width=width, prefix="_l_"), long, ["stops"], by=by, width=width, prefix="_g_")
    begins = states.groupBy(F.col(by).alias("_key")).agg(F.min("t").alias("first_state"))
    met = seen.join(begins, F.col(by).eqNullSafe(F.col("_key")), "left")
    tail = F.when(F.col("t") - F.col("_l_own_t") > limits.max_gap + pre.SAME, F.col("t") - limits.max_gap)
    return met.select(*fixes.columns, "first_state", F.coalesce(tail, F.col("_g_stops"), F.lit(float("-inf"))).alias("fail_before"))


def _assigned(fixes: DataFrame, given: DataFrame, states: DataFrame, gates: anchor_rules.Gates, limits: pre.Limits, by: str, width: float) -> DataFrame:
    first = given.groupBy(F.col(by).alias("_by")).agg(F.min(F.struct("t", "seq", "lon", "lat")).alias("_f"))
    local = given.join(first, F.col(by).eqNullSafe(F.col("_by")))
    east, north = geo.sphere_error(F.col("lon"), F.col("lat"), F.col("_f.lon"), F.col("_f.lat"))
    local = local.withColumns({"east": east, "north": north, "headed": geo.finite(F.col("heading"))})
    return anchor_rules.assign(local, propagable(fixes, states, limits, by, width), gates, by)


def _chains(found: DataFrame, given: DataFrame, states: DataFrame, limits: pre.Limits, by: str, width: float) -> DataFrame:
    """by, seq, ok, place (lon, lat, alt), vel, clipped and rel (relative heading at the anchor) of every fix that has an anchor."""
    about = pre.causal(given, states, limits, by, width).select(
        F.col(by).alias("_by"), F.col("seq").alias("_anchor"), "lon", "lat", "alt", "heading",
        F.coalesce(F.when(rot.all_finite(F.col("vel")), F.col("vel")), F.expr(pre.ZEROS)).alias("vel"), rot.heading_of(F.col("state.r")).alias("_rel"),
    )
    begins = states.groupBy(F.col(by).alias("_key")).agg(F.min("t").alias("_first"))
    own = Window.partitionBy(by, "anchor_seq").orderBy("t", "seq")
    legs = found.where(F.col("anchor_seq").isNotNull()).withColumn("_since", F.coalesce(F.lag("t").over(own), F.col("anchor_t")))
    legs = legs.join(begins, F.col(by).eqNullSafe(F.col("_key")), "left").drop("_key")
    legs = legs.withColumns({"start": F.greatest("_since", "_first"), "stop": F.col("t")})
    legs = legs.withColumn("_still", ~(F.col("stop") > F.col("start") + pre.SAME))
    requests = legs.where(~F.col("_still")).select(by, "seq", "start", "stop")
    parts = pre.pieces(requests, states, limits, by, width).groupBy(F.col(by).alias("_key"), F.col("seq").alias("_leg")).agg(pre.ordered().alias("_p"))
    legs = legs.join(parts, legs[by].eqNullSafe(F.col("_key")) & (F.col("seq") == F.col("_leg")), "left").drop("_key", "_leg")
    # With no state at the start of an anchor or of its vehicle, the relative heading is that of the first state.
    missing = begins.select("_key", "_first").join(states.select(F.col(by).alias("_s"), "t", "r"), F.col("_key").eqNullSafe(F.col("_s")) & (F.col("t") == F.col("_first")))
    about = about.join(missing.select("_key", rot.heading_of(F.col("r")).alias("_rel0")), about["_by"].eqNullSafe(F.col("_key")), "left").drop("_key")
    about = about.withColumn("_rel", F.coalesce("_rel", "_rel0")).drop("_rel0")

    run = F.sort_array(F.collect_list(F.struct("t", "seq", "_still", "_p")))
    chain = legs.groupBy(F.col(by).alias("_key"), F.col("anchor_seq").alias("_a")).agg(run.alias("_legs"))
    chain = chain.join(about, chain["_key"].eqNullSafe(about["_by"]) & (F.col("_a") == F.col("_anchor"))).drop("_by", "_anchor")
    chain = chain.withColumn("_yaw", F.when(geo.finite(F.col("heading")), wrap_to_pi(F.col("_rel") - F.col("heading"))))
    row = "struct<seq:bigint,ok:boolean,lon:double,lat:double,alt:double,vel:array<double>,still:boolean>"
    state = f"struct<lon:double,lat:double,alt:double,vel:array<double>,ok:boolean,rows:array<{row}>>"

    none = F.array().cast(legs.schema["_p"].dataType)

    def leg(s: Column, x: Column) -> Column:
        """The next fix of an anchor: what is known of it (x) after what is known of the last one (s)."""

        def moved(c: Column) -> Column:
            sound = c["ok"] & x["_p"].isNotNull() & F.col("_yaw").isNotNull()
            ok = s["ok"] & F.coalesce(x["_still"] | sound, F.lit(False))
            ecef = geo.moved(geo.Geo(s["lon"], s["lat"], s["alt"]), geo.Enu(*rot.parts(c["pos"], 3)))
            return F.struct(ecef.x.alias("x"), ecef.y.alias("y"), ecef.z.alias("z"), (s["alt"] + F.get(c["pos"], F.lit(2))).alias("alt"), c["vel"].alias("vel"), ok.alias("ok"))

        def placed(c: Column) -> Column:
            there = geo.from_ecef(geo.Ecef(c["x"], c["y"], c["z"]))
            pick = lambda new, name: F.when(x["_still"], s[name]).otherwise(new).alias(name)
            return F.struct(pick(there.lon, "lon"), pick(there.lat, "lat"), pick(c["alt"], "alt"), pick(c["vel"], "vel"), c["ok"].alias("ok"))

        def written(n: Column) -> Column:
            made = F.struct(x["seq"].alias("seq"), n["ok"].alias("ok"), n["lon"].alias("lon"), n["lat"].alias("lat"), n["alt"].alias("alt"), n["vel"].alias("vel"), x["_still"].alias("still")).cast(row)
            return F.struct(n["lon"].alias("lon"), n["lat"].alias("lat"), n["alt"].alias("alt"), n["vel"].alias("vel"), n["ok"].alias("ok"), F.array_append(s["rows"], made).alias("rows")).cast(state)

        carried = F.aggregate(F.coalesce(x["_p"], none), pre.start_state(s["vel"]), lambda c, p: pre.carried(c, p["p"], F.col("_yaw"), limits))
        return rot.let(rot.let(rot.let(carried, moved), placed), written)

    start = F.struct("lon", "lat", "alt", "vel", F.lit(True).alias("ok"), F.array().cast(f"array<{row}>").alias("rows")).cast(state)
    done = chain.withColumn("_done", F.aggregate("_legs", start, leg)["rows"])
    return done.select(F.col("_key").alias(by), F.col("_a").alias("anchor_seq"), "_rel", "heading", F.explode("_done").alias("_row")).select(by, "anchor_seq", "_rel", "heading", "_row.*")


def positions(
    fixes: DataFrame,
    given: DataFrame,
    states: DataFrame,
    gates: anchor_rules.Gates | None = None,
    limits: pre.Limits | None = None,
    continuous: DataFrame | None = None,
    by: str = "vehicle_id",
    width: float = 60.0,
) -> DataFrame:
    """by, seq, t, anchor_seq, age, rejected, lon, lat, alt, speed, heading (radians), heading_source and failure_reason of every fix.

    fixes: by, t, seq and, if there is a gate, is_open; given: anchors as `anchors_of` makes them; continuous:
    by, seq, lon, lat, alt, speed of the running filter at fixes (`streaming.fusion`, fixes as events).
    """
    g, k = gates or anchor_rules.Gates(), limits or pre.Limits()
    opened = fixes.withColumn("is_open", F.coalesce("is_open", F.lit(False)) if "is_open" in fixes.columns else F.lit(True))
    active = opened.select(by, "t", F.col("seq").cast("long").alias("seq"), "is_open")
    found = _assigned(active, given, states, g, k, by, width)
    chained = _chains(found.where("NOT lost"), given, states, k, by, width).select(
        F.col(by).alias("_by"), F.col("seq").alias("_seq"), "lon", "lat", "alt", "_rel", F.col("heading").alias("_compass"), "still", rot.length(rot.parts(F.col("vel"), 3)).alias("speed")
    )
    now = pre.causal(found.where(F.col("anchor_seq").isNotNull()).select(by, "t", "seq"), states, k, by, width)
    now = now.select(F.col(by).alias("_nby"), F.col("seq").alias("_nseq"), rot.heading_of(F.col("state.r")).alias("_now"))
    met = found.join(chained, found[by].eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq")), "left").drop("_by", "_seq")
    met = met.join(now, met[by].eqNullSafe(F.col("_nby")) & (F.col("seq") == F.col("_nseq")), "left").drop("_nby", "_nseq")
    turned = wrap_to_two_pi(F.col("_compass") + wrap_to_pi(F.col("_now") - F.col("_rel")))
    met = met.withColumn("heading", F.when(F.col("lon").isNotNull(), F.when(F.col("still"), F.col("_compass")).otherwise(F.coalesce(turned, F.col("_compass")))))
    source = F.when(F.col("lon").isNotNull(), F.when(F.col("still"), "last_valid").when(turned.isNotNull(), "anchor+imu_delta").otherwise("anchor_only"))
    met = met.withColumn("heading_source", source).drop("_rel", "_compass", "_now", "still")
    if continuous is not None:
        other = continuous.select(F.col(by).alias("_by"), F.col("seq").alias("_seq"), *[F.col(c).alias(f"_{c}") for c in ("lon", "lat", "alt", "speed")])
        met = met.join(other, met[by].eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq")), "left").drop("_by", "_seq")
        fill = F.col("anchor_seq").isNull() & F.col("_lon").isNotNull()
        met = met.withColumns({c: F.when(fill, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lon", "lat", "alt", "speed")} | {"heading_source": F.when(fill, "continuous_filter_imu_only").otherwise(F.col("heading_source"))})
    reason = F.when(F.col("lon").isNull(), F.when(F.col("lost"), FAILED).otherwise(F.coalesce("reason", F.lit("no_visual_anchor"))))
    names = ["anchor_seq", "age", "rejected", "lon", "lat", "alt", "speed", "heading", "heading_source"]
    rows = met.select(by, "seq", "t", *names, reason.alias("failure_reason"))
    shut = opened.where(~F.col("is_open")).select(by, F.col("seq").cast("long").alias("seq"), "t", F.lit("fusion_not_open_height_not_reached").alias("failure_reason"))
    return rows.unionByName(shut.select(by, "seq", "t", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], "failure_reason"))
