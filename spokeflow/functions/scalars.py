"""Row-wise expressions of the sensor model, all of them Column functions inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pressure grid and the wheel.
COLUMNS = 96
ROWS = 20
RADIUS_MM = 254.5
BELT_MM = 1598.0
BIN_S = 0.1
# Codes of labels, names of sands and their grain in mm, and columns where two grid layers overlap.
TERRAINS = {
    "flatlvl": 0, "gullies": 1, "pebbles": 2, "sharpdunes": 3, "smoodunes": 4, "rock-above": 5,
    "bedrock": 6, "JPL": 7, "footprints": 8, "freeslip": 9, "rock-below": 10,
}
COMPOSITIONS = {"mmcrse": 0, "grc-01": 1, "mmintr": 2, "mins30": 3, "wed730": 4, "mm.2mm": 5, "bst110": 6}
GRAIN_MM = {
    "redgar": "1.55", "wed730": "0.14", "mmdust": "0.025", "mm.2mm": "0.04", "mmcrse": "1.0",
    "bst110": "0.08", "grc-01": "0.39", "mins30": "0.19", "mmintr": "0.22",
}
AMBIGUOUS = [*range(0, 5), *range(23, 27), *range(45, 51), *range(70, 75), 94, 95]
ROCKY = ["rock-below", "bedrock", "rock-above"]


def nan_to_null(x: Column) -> Column:
    """NaN marks a missing value in sensor files; aggregates skip NULL but carry NaN on."""
    return F.when(~F.isnan(x), x)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def parse_stamp(text: Column) -> Column:
    """Epoch seconds of `2019/10/31 12:30:00.250`, in the session's zone."""
    return epoch_seconds(F.to_timestamp(text, "yyyy/MM/dd HH:mm:ss[.SSSSSS][.SSS]"))


def parse_twelve_hour(text: Column) -> Column:
    """Epoch seconds of `10/31/2019 1:30:00 PM`."""
    return epoch_seconds(F.to_timestamp(text, "M/d/yyyy h:mm:ss a"))


RUN_NAME = (
    r"^(.+?)_(label_[^_]+|[^_]+)_terrain_([^_]+)_vel_([^_]+)_EISfreqsweep_([^_]+)_grousers_([^_]+)"
    r"_loading_([^_]+)_material_([^_]+)_hydra_([^_]+)_pretreat_([^_]+)_date_(\d{8})_rep_([^_/]+)$"
)
RUN_FIELDS = {"label": 2, "terrain": 3, "loading": 7, "material": 8, "hydration": 9, "date": 11, "rep": 12}


def run_fields(name: Column, strict: bool = False) -> dict[str, Column]:
    """The fields that a run's name encodes; a name that doesn't match is NULL, or an error if strict."""
    ok = name.rlike(RUN_NAME)
    bad = F.raise_error(F.concat(F.lit("not a run name: "), name)).cast("string") if strict else F.lit(None).cast("string")
    return {k: F.when(ok, F.regexp_extract(name, RUN_NAME, g)).otherwise(bad) for k, g in RUN_FIELDS.items()}


def run_type(fields: dict[str, Column]) -> Column:
    return F.concat_ws("_", F.lit("label"), F.lit("terrain"), *[fields[k] for k in ("terrain", "loading", "material", "hydration", "date", "rep")])


def path_token(path: Column, from_end: int, token: int, sep: str = "_") -> Column:
    """Token number `token` (from 0) of the path part `from_end` from the end (1 is the last); NULL if absent."""
    part = F.element_at(F.split(path, "/"), -from_end)
    return F.try_element_at(F.split(part, sep), F.lit(token + 1))


def wrap(i: Column, end: int) -> Column:
    """An index on a ring of `end` positions."""
    return F.pmod(i, F.lit(end))


def contact_column(angle: Column, columns: int = COLUMNS, top: int = 16) -> Column:
    """The ring column under the hub for an angle in degrees."""
    return F.pmod(F.lit(top) - F.ceil(angle * (columns - 1) / 360), F.lit(columns)).cast("int")


def signed_lag(column: Column, reference: Column, columns: int = COLUMNS) -> Column:
    """Distance on the ring from `reference`, from -columns/2 to columns/2 - 1."""
    half = columns // 2
    return F.pmod(column - reference + half, F.lit(columns)) - half


def amplitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def mean_angle(sin: Column, cos: Column) -> Column:
    """Degrees in [0, 360) of a mean sine and cosine."""
    return F.pmod(F.degrees(F.atan2(sin, cos)), F.lit(360.0))


def sinkage(front: Column, radius: float = RADIUS_MM, column_mm: float = BELT_MM / COLUMNS) -> Column:
    """Depth below ground, zero or less, for a number of contact columns ahead of the hub."""
    return F.when(front > 0, radius * (F.cos(front * column_mm / radius) - 1)).otherwise(0.0)


def spherical(x: Column, y: Column, z: Column) -> dict[str, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    return {"r": r, "theta": F.when(r > 0, F.acos(z / F.nullif(r, F.lit(0.0)))), "phi": F.atan2(y, x)}


#: What the accelerometer of the wheel shows at rest.
IMU_OFFSETS = (-0.4993, -0.0772, 1.4496)


def imu_angles(x: Column, y: Column, z: Column, offsets: Sequence[float] = IMU_OFFSETS) -> dict[str, Column]:
    """r, theta, phi and rot in degrees of raw accelerations: theta from the vertical, phi signed by y, rot in [0, 360) around y by its quadrant."""
    x, y, z = (c + F.lit(float(o)) for c, o in zip((x, y, z), offsets))
    r, flat = F.sqrt(x * x + y * y + z * z), F.sqrt(x * x + y * y)
    slope = F.degrees(F.atan(z / (x + F.lit(1e-11))))
    return {
        "r": r, "theta": F.degrees(F.acos(F.try_divide(z, r))), "phi": F.signum(y) * F.degrees(F.acos(F.try_divide(x, flat))),
        "rot": F.pmod(F.when(x >= 0, slope).otherwise(slope + 180.0), F.lit(360.0)),
    }


def transform(matrix: Sequence[Sequence[float]], vector: Sequence[Column]) -> list[Column]:
    """Rows of a constant matrix times a vector of columns."""
    return [reduce(lambda a, b: a + b, [F.lit(float(m)) * v for m, v in zip(row, vector)]) for row in matrix]


def scaled(x: Column, factor: float) -> Column:
    return x * F.lit(factor)


def encoded(x: Column, codes: dict[str, int]) -> Column:
    """The code of a label; NULL for a label without one."""
    return F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])[x]


def blind_spot(x: Column, angle: Column, low: float = 250.0, high: float = 290.0) -> Column:
    return F.when((angle > low) & (angle < high), F.lit(None)).otherwise(x)


def override_pattern(pattern: Column, rock: Column, with_rocks: Column) -> Column:
    """In runs over rocks, rows without one are flat."""
    return F.when(with_rocks & (rock == 0), F.lit("flatlvl")).otherwise(pattern)


def feature_name(family: str, subset: str, lag: int | None = None, number: int | None = None) -> str:
    if number is not None:
        return f"{family}{number}_lag{lag}_mean_{subset}"
    return f"{family}{lag}_{subset}" if lag is not None else f"{family}_{subset}"
