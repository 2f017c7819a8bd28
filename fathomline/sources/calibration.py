"""Camera and run files as rows: intrinsics, extrinsics and run configurations, one row a file with the reason why it can't be used.

Each reader takes a path, glob or folder of texts; the column functions below them take the text of a file from any table.  Nothing
stops a job over many files: what a file lacks is in its column `reason` (null if it is whole) and its values are null.  A file of no bytes gives no row, as Spark's readers pass it over; a null text lacks everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"

# Keys, texts and replacements of a run's files.
REQUIRED = {"input": ("image0", "image1"), "model": ("superpoint", "lightglue"), "output": ()}
#: Usual value, and the bounds that an own value lies between: (at least or above, whether the bound itself is allowed, below).
FALLBACKS = {
    "runtime.max_draw": (200, 0, False, None),
    "runtime.homography_ransac_reproj": (3.0, 0, False, None),
    "runtime.homography_max_pairs": (300, 4, True, None),
    "feature.max_features": (4000, 0, False, None),
    "feature.fast_threshold": (20, 0, False, None),
    "matching.ratio": (0.8, 0, False, 1),
    "matching.max_keep": (3000, 0, False, None),
}
SIBLINGS = {
    "matches_inlier": ("matches", "_inliers", None),
    "warp": ("matches", "_warp", None),
    "compare": ("matches", "_compare", None),
    "map2d_csv": ("matches", "_map2d", ".csv"),
    "map3d_csv": ("matches", "_map3d", ".csv"),
    "pnp_report": ("matches", "_pnp", ".txt"),
    "undistort": ("sp1_kpts", "_undistort", None),
}
BINARY = ("orb", "fast")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file and text of every file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})")), lambda x: x.cast("double"))


def _sequence(text: Column, key: str) -> Column:
    """Numbers of `key: [..]`, over lines or not, or of the dashed lines below `key:`; empty if there is no such key."""
    bracket = F.regexp_extract(text, rf"(?m)^[ \t]*{key}[ \t]*:[ \t\r\n]*\[([^\]]*)\]", 1)
    dashed = F.regexp_extract(text, rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*\r?\n((?:[ \t]*-[ \t]+[^\n]*\n?)+)", 1)
    return F.when(bracket != "", _numbers(bracket)).otherwise(F.transform(F.regexp_extract_all(dashed, F.lit(rf"(?m)-[ \t]+({NUMBER})")), lambda x: x.cast("double")))


def intrinsics(text: Column) -> Column:
    """Struct fx, fy, cx, cy, distortion (four), width, height, reason; of section cam0 if it has the values, else of the whole text.

    Sizes are 0 where a file has none.
    """
    section = F.regexp_extract(text, r"(?m)^cam0[ \t]*:[ \t]*\r?\n((?:[ \t]+[^\n]*\n?|\r?\n)*)", 1)
    whole = lambda t: (F.size(_sequence(t, "intrinsics")) >= 4) & (F.size(_sequence(t, "distortion_coeffs")) >= 4)
    chosen = F.when(whole(section), section).otherwise(text)
    values, bend, size = (_sequence(chosen, key) for key in ("intrinsics", "distortion_coeffs", "resolution"))
    reason = F.when(text.isNull() | (F.size(values) < 4), "intrinsics_missing").when(F.size(bend) < 4, "distortion_coeffs_missing")
    known = {name: F.when(reason.isNull(), F.get(values, F.lit(k))) for k, name in enumerate(("fx", "fy", "cx", "cy"))}
    sides = {name: F.when(reason.isNull(), F.when(F.size(size) >= 2, F.round(F.get(size, F.lit(k)))).otherwise(0.0).cast("int")) for k, name in enumerate(("width", "height"))}
    columns = known | {"distortion": F.when(reason.isNull(), F.slice(bend, 1, 4))} | sides | {"reason": reason}
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def extrinsics(text: Column, camera: str = "cam0") -> Column:
    """Struct rotation (nine, by row), translation (three), shift (seconds), reason; of the block `T_ic:  (camera to imu0):`.

    The matrix is the first four lines after its title with a bracket and four numbers; the shift is on the first line after its title that isn't empty.
    """
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    after = lambda title: F.filter(F.transform(lines, lambda x, k: F.when(F.instr(x, title) > 0, k + 2)), lambda k: k.isNotNull())
    below = lambda title: F.slice(lines, F.coalesce(F.get(after(title), F.lit(0)), F.size(lines) + 1), F.size(lines))
    matrix, shift = f"T_ic:  ({camera} to imu0):", f"timeshift {camera} to imu0:"
    leading = lambda x: F.regexp_extract(F.translate(x, "[],", "   "), rf"^\s*((?:{NUMBER}(?:\s+|$))*)", 1)
    rows = F.filter(F.transform(F.filter(below(matrix), lambda x: F.instr(x, "[") > 0), lambda x: _numbers(leading(x))), lambda r: F.size(r) >= 4)
    moved = F.regexp_extract(F.coalesce(F.get(F.filter(below(shift), lambda x: x != ""), F.lit(0)), F.lit("")), rf"^\s*({NUMBER})", 1)
    there = lambda title: F.size(after(title)) > 0
    reason = (
        F.when(there(matrix) & (F.size(rows) < 4), "T_ic_incomplete")
        .when(there(shift) & (moved == ""), "timeshift_incomplete")
        .when(~there(matrix), "T_ic_missing")
        .when(~there(shift), "timeshift_missing")
    )
    top = F.slice(rows, 1, 3)
    columns = {
        "rotation": F.when(reason.isNull(), F.flatten(F.transform(top, lambda r: F.slice(r, 1, 3)))),
        "translation": F.when(reason.isNull(), F.transform(top, lambda r: F.get(r, F.lit(3)))),
        "shift": F.when(reason.isNull(), moved.try_cast("double")),
        "reason": reason,
    }
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def settings(text: Column) -> Column:
    """Map of "section.key" to the value's text of two levels of `key: value`; the last of equal keys stands, quotes and remarks go."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"(^|\s)#.*$", ""))
    key = lambda x: F.regexp_extract(x, r"^\s*([\w.-]+)\s*:", 1).alias("key")
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s*[\w.-]+\s*:", "")), r"""^(["'])(.*)\1$""", "$2").alias("value")
    pairs = F.filter(F.transform(lines, lambda x: F.struct(key(x), value(x), x.rlike(r"^[ \t]").alias("inner"))), lambda p: p["key"] != "")
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<key:string,value:string>>").alias("found"))

    def take(state: Column, pair: Column) -> Column:
        name = F.when(pair["inner"], F.concat_ws(".", state["section"], pair["key"])).otherwise(pair["key"])
        section = F.when(pair["inner"], state["section"]).otherwise(pair["key"])
        entry = F.array(F.struct(name.alias("key"), pair["value"].alias("value")))
        return F.struct(section.alias("section"), F.concat(F.filter(state["found"], lambda e: e["key"] != name), entry).alias("found"))

    return F.map_from_entries(F.aggregate(pairs, start, take, lambda s: s["found"]))


def _sibling(path: Column, suffix: str, extension: str | None) -> Column:
    """a/b.png to a/b_suffix.png, or with another extension."""
    stem, end = F.regexp_extract(path, r"^(.*?[^/]?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"^(.*?[^/]?)(\.[^./]*)?$", 2)
    return F.concat(stem, F.lit(suffix), F.lit(extension) if extension else end)


def combination_reason(feature: Column, matcher: Column, distance: Column) -> Column:
    """Why features, matcher and distance don't go together; null if they do."""
    binary = feature.isin(*BINARY)
    chosen = F.when(distance == "auto", F.when(binary, "hamming").otherwise("l2")).otherwise(distance)
    return (
        F.when((matcher == "lightglue") & (feature != "superpoint"), "lightglue_needs_superpoint")
        .when(matcher == "lightglue", None)
        .when(binary & (chosen != "hamming"), "binary_needs_hamming")
        .when(~binary & (chosen != "l2"), "float_needs_l2")
    )


def run_configuration(text: Column, sizes: tuple[int, int] = (512, 512)) -> Column:
    """Struct values (map: settings with bad values replaced and outputs without a name named after their siblings) and reason.

    A number that isn't one counts as 0, so it is replaced too.  sizes: height and width where a text names none.
    """
    return _once(settings(text), lambda found: _checked(found, sizes))


def _checked(found: Column, sizes: tuple[int, int]) -> Column:
    get = lambda key: F.element_at(found, key)
    has = lambda key: F.coalesce(get(key), F.lit("")) != ""
    sections = F.transform(F.map_keys(found), lambda k: F.split(k, r"\.")[0])
    reason = F.when(~F.forall(F.array(*map(F.lit, REQUIRED)), lambda s: F.array_contains(sections, s)), "section_missing")
    for section, keys in REQUIRED.items():
        for key in keys:
            reason = reason.when(~has(f"{section}.{key}"), f"{section}.{key}_missing")
    number = lambda key: F.coalesce(F.regexp_extract(get(key), rf"^({NUMBER})$", 1).try_cast("double"), F.lit(0.0))
    for side, usual in zip("HW", sizes, strict=True):
        reason = reason.when(F.when(has(f"runtime.{side}"), number(f"runtime.{side}")).otherwise(float(usual)) <= 0, "size_not_positive")
    feature, matcher, distance = (F.lower(F.coalesce(get(k), F.lit(usual))) for k, usual in (("feature.method", "superpoint"), ("matching.method", "lightglue"), ("matching.distance", "auto")))
    reason = reason.otherwise(combination_reason(feature, matcher, distance))
    fixed = {}
    for key, (usual, least, allowed, below) in FALLBACKS.items():
        own = number(key)
        good = (own >= least if allowed else own > least) & (F.lit(True) if below is None else own < below)
        fixed[key] = F.when(has(key) & good, get(key)).otherwise(str(usual))
    for name, (source, suffix, extension) in SIBLINGS.items():
        fixed[f"output.{name}"] = F.when(has(f"output.{name}"), get(f"output.{name}")).when(has(f"output.{source}"), _sibling(get(f"output.{source}"), suffix, extension))
    fixed["input.dem_tif"] = F.when(has("input.dem_tif"), get("input.dem_tif")).otherwise(get("input.image0"))
    others = F.map_filter(found, lambda k, v: ~k.isin(*fixed))
    added = F.map_filter(F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return F.struct(F.when(reason.isNull(), F.map_concat(others, added)).alias("values"), reason.alias("reason"))


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    return texts(spark, path).select("file", intrinsics(F.col("text")).alias("c")).select("file", "c.*")


def read_extrinsics(spark: SparkSession, path: str, camera: str = "cam0") -> DataFrame:
    return texts(spark, path).select("file", extrinsics(F.col("text"), camera).alias("c")).select("file", "c.*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return texts(spark, path).select("file", run_configuration(F.col("text")).alias("c")).select("file", "c.*")
