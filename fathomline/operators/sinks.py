"""Rows as the files and topics of a run have them: fixed decimals, missing as nan, blank or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import vision
from fathomline.functions.decimals import fixed_text
from fathomline.functions.geo import finite

# The columns of the result row of a frame.
RESULT_COLUMNS = (
    "image_index,image_stamp_sec,map_feature_points,aerial_feature_points,lightglue_match_pairs,homography_used_pairs,homography_inlier_count,"
    "lightglue_geom_inlier_rate,pnp_input_points,localization_used_points,localization_inlier_points,pnp_inlier_rate,reproj_error,terrain_relief_m,"
    "terrain_alt_std_m,terrain_alt_median_m,pnp_f_eff_px,scale_h_m_per_px,point_spread_img_ratio,point_spread_map_xy_m2,depth_spread_m,obliqueness_deg,"
    "dual_geom_valid,dual_geom_pnp_rmse_px,dual_geom_disagree_rmse_px,dual_geom_px_var_u,dual_geom_px_cov_uv,dual_geom_px_var_v,"
    "dual_geom_local_scale_u_m_per_px,dual_geom_local_scale_v_m_per_px,dual_geom_local_scale_mean_m_per_px,dual_geom_var_x_m2,dual_geom_cov_xy_m2,"
    "dual_geom_var_y_m2,pred_x_sigma_m,pred_y_sigma_m,pred_z_sigma_m,pred_var_diag_m2,yaw_compass_deg,heading_east_weight,heading_north_weight,"
    "localization_success,failure_reason"
).split(",")
# The columns of the fused row of a fix.
FUSION_COLUMNS = (
    "fix_index,fix_stamp_sec,gt_lon,gt_lat,gt_alt,pred_available,pred_lon,pred_lat,pred_alt,visual_anchor_image_index,visual_anchor_stamp_sec,"
    "visual_anchor_lon,visual_anchor_lat,visual_anchor_alt,visual_anchor_heading_deg,imu_heading_delta_deg,heading_used_deg,speed_mps,propagate_dt_sec,"
    "visual_anchor_age_sec,visual_anchor_sync_wait_ms,visual_anchor_processing_ms,visual_anchor_topic_to_result_ms,estimated_staleness_ms,"
    "fix_compute_latency_ms,fix_topic_to_fusion_result_ms,anchor_reject_count,anchor_reject_reason,heading_source,failure_reason"
).split(",")
RESULT_COUNTS = {c for c in RESULT_COLUMNS[:10] if c.endswith(("points", "pairs", "count"))} | {"image_index", "localization_inlier_points"}
RESULT_FLAGS = {"dual_geom_valid", "localization_success"}
FUSION_COUNTS = {"fix_index", "visual_anchor_image_index", "anchor_reject_count"}
TEXTS = {"anchor_reject_reason", "heading_source", "failure_reason"}


def fixed(value: Column, digits: int, missing: str | None = "nan") -> Column:
    """Fixed decimals as text; null and NaN become `missing`."""
    return F.when(~finite(value), missing).otherwise(fixed_text(value, digits))


def csv_table(df: DataFrame, digits: dict[str, int], missing: str | None = "nan") -> DataFrame:
    """df with the given columns as fixed decimals, in the order of df."""
    return df.select(*[fixed(F.col(c), digits[c], missing).alias(c) if c in digits else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, digits: dict[str, int], missing: str | None = "nan") -> None:
    """One header in every part file; missing None writes blanks."""
    csv_table(df, digits, missing).write.csv(path, header=True, nullValue="", emptyValue="", mode="overwrite")


def json_rows(df: DataFrame) -> DataFrame:
    """value: each row as JSON with nulls kept and NaN as null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if kind in {"double", "float"} else F.col(c) for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def report(df: DataFrame, key: str) -> DataFrame:
    """key, value: one text of key=value lines per row, for the text writer."""
    lines = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in df.columns]
    return df.select(key, F.array_join(F.array(*lines), "\n").alias("value"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """frames and avg_* of the finite values of the columns, 0 where there are none."""
    finite_avg = lambda c: F.coalesce(F.avg(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("frames"), *[finite_avg(c).alias(f"avg_{c}") for c in columns])


def csv_text(value: Column) -> Column:
    """A text as a CSV field: quoted if it holds a comma, a quote or a line end; null is empty."""
    plain = F.coalesce(value, F.lit(""))
    return F.when(plain.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)


def csv_lines(df: DataFrame, digits: dict[str, int], missing: str = "nan") -> DataFrame:
    """line: the columns of df in order, joined by commas."""
    fields = [fixed(F.col(c), digits[c], missing) if c in digits else csv_text(F.col(c).cast("string")) for c in df.columns]
    return df.select(F.concat_ws(",", *fields).alias("line"))


def _given(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def result_lines(frames: DataFrame, var_x: Column, var_y: Column, var_z: Column, key: str = "image_index", digits: int = 9) -> DataFrame:
    """key and line: the result row of each frame; columns that frames lacks are missing, counts and flags then 0.

    Sigmas and their text come from the predicted variances, heading weights from yaw_compass_deg.
    """
    root = lambda v: F.when(v > 0, F.sqrt(v))
    east, north = vision.heading_weights(F.radians(_given(frames, "yaw_compass_deg", "double")))
    diagonal = F.concat(F.lit("["), F.concat_ws(",", *[fixed(v, digits) for v in (var_x, var_y, var_z)]), F.lit("]"))
    made = {
        "pred_x_sigma_m": fixed(root(var_x), digits), "pred_y_sigma_m": fixed(root(var_y), digits), "pred_z_sigma_m": fixed(root(var_z), digits),
        "pred_var_diag_m2": csv_text(diagonal), "heading_east_weight": fixed(east, digits), "heading_north_weight": fixed(north, digits),
    }

    def field(name: str) -> Column:
        if name in made:
            return made[name]
        if name in TEXTS:
            return csv_text(_given(frames, name, "string"))
        if name in RESULT_COUNTS or name in RESULT_FLAGS:
            return F.coalesce(_given(frames, name, "long"), F.lit(0)).cast("string")
        return fixed(_given(frames, name, "double"), digits)

    return frames.select(key, F.concat_ws(",", *map(field, RESULT_COLUMNS)).alias("line"))


def fusion_fields(df: DataFrame, missing: str, text: Callable[[Column], Column], flag: tuple[str, str], digits: int = 9) -> list[Column]:
    """The fused row's values as text, in order."""

    def field(name: str) -> Column:
        if name in TEXTS:
            return text(F.coalesce(_given(df, name, "string"), F.lit("")))
        if name in FUSION_COUNTS:
            return F.coalesce(_given(df, name, "long"), F.lit(0)).cast("string")
        if name == "pred_available":
            return F.when(_given(df, name, "boolean"), flag[1]).otherwise(flag[0])
        return fixed(_given(df, name, "double"), digits, missing)

    return [field(c) for c in FUSION_COLUMNS]


def fusion_lines(df: DataFrame) -> DataFrame:
    """fix_index and line: the fused row of each fix, missing numbers blank."""
    return df.select("fix_index", F.concat_ws(",", *fusion_fields(df, "", csv_text, ("0", "1"))).alias("line"))


def fusion_json(df: DataFrame) -> DataFrame:
    """fix_index and json: the same row as a JSON object, missing numbers null."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")
    values = fusion_fields(df, "null", quoted, ("false", "true"))
    pairs = [F.concat(F.lit(f'"{name}":'), value) for name, value in zip(FUSION_COLUMNS, values, strict=True)]
    return df.select("fix_index", F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("json"))


def publish(stream: DataFrame, path: str, key: str = "vehicle_id", order: str = "t", checkpoint: str | None = None):
    """Start a query that publishes each row of a stream as JSON once, and keeps every key's last row for readers that come late.

    A micro-batch has folders of its own, named by its number, which it overwrites whole: one that is run
    again after a failure changes nothing.  path/rows has every row (key, order, value), path/last one row a key
    as of each batch; `last_rows` reads the newest.  Rows with a null order are published and never the last if
    the key has another.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fields = batch.columns
        rows = batch.select(F.col(key), F.col(order), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        now = spark.read.parquet(f"{path}/rows/batch={number}")
        before = _newest(spark, path, number)
        every = now if before is None else now.unionByName(before)
        last = every.groupBy(key).agg(F.max(F.struct(F.col(order), F.col("value"))).alias("_l")).select(key, F.col(f"_l.{order}").alias(order), "_l.value")
        last.write.mode("overwrite").parquet(f"{path}/last/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start()


def _newest(spark, path: str, below: int | None = None) -> DataFrame | None:
    """The kept rows as of the last batch (with a number below the given one)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/last")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    done = [s.getPath() for s in files.listStatus(folder)]
    numbers = [int(p.getName().partition("=")[2]) for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    found = max((n for n in numbers if below is None or n < below), default=None)
    return None if found is None else spark.read.parquet(f"{path}/last/batch={found}")


def last_rows(spark, path: str) -> DataFrame | None:
    """The last row of every key that `publish` has seen; None before the first batch."""
    return _newest(spark, path)
