"""Column functions: units, boxes, class rules, guarded arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PX_PER_UM, FPS = 1.422, 50
MIN_LENGTH, STATE_WINDOW, TEMPORAL_SECONDS = 10, 25, 5
VCL_IMMOTILE, VCL_PROGRESSIVE, STR_PROGRESSIVE = 5.0, 25.0, 0.5
CLASSES = ["progressive", "non_progressive", "immotile"]
STATES = ["Progressive", "Non-progressive", "Immotile"]


def px_to_um(px: Column, ppm: float = PX_PER_UM) -> Column:
    """Pixels to micrometres."""
    return px / F.lit(ppm)


def frame_interval(fps: float = FPS) -> float:
    """Seconds between frames."""
    return 1.0 / fps


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def centroid(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size of a box."""
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def denormalise(cx: Column, cy: Column, w: Column, h: Column, width: float, height: float) -> tuple[Column, Column, Column, Column]:
    """Corner pixels of a box given as centre and size in fractions of the image."""
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def normalise(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> tuple[Column, Column, Column, Column]:
    """Centre and size in fractions of the image, clamped to [0, 1]."""
    parts = ((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) for p in parts)


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b where b is above 0, else ``empty``."""
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def motility(vcl: Column, straightness: Column) -> Column:
    """P5: class of a track from its rounded VCL and STR."""
    progressive = (vcl >= VCL_PROGRESSIVE) & (straightness >= STR_PROGRESSIVE)
    return F.when(vcl <= VCL_IMMOTILE, "immotile").when(progressive, "progressive").otherwise("non_progressive")


def state_code(vcl: Column, straightness: Column, v_imm=VCL_IMMOTILE, v_prog=VCL_PROGRESSIVE, s_prog=STR_PROGRESSIVE) -> Column:
    """0 progressive, 1 non-progressive, 2 immotile; thresholds may be columns."""
    return F.when(vcl <= v_imm, 2).when((vcl >= v_prog) & (straightness >= s_prog), 0).otherwise(1).cast("int")


def state_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), code + 1)


def standard_label(label: Column) -> Column:
    """Display label of a class however it is spelled; null if it is unknown."""
    key = F.lower(F.regexp_replace(F.trim(label), "[ _]", "-"))
    return F.element_at(F.create_map(*[F.lit(x) for pair in zip([s.lower() for s in STATES], STATES, strict=True) for x in pair]), key)


def who_flags(total_motile_pct: Column, progressive_pct: Column) -> tuple[Column, Column]:
    """Reference limits for total (42 %) and progressive (30 %) motility."""
    return total_motile_pct >= 42.0, progressive_pct >= 30.0


def half_even(x: Column | str, digits: int) -> Column:
    """Rounding to ``digits`` decimals, halves to even, on the binary value (as NumPy rounds)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.rint(c * 10.0**digits) / 10.0**digits


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson's r; null where either does not vary (``corr`` divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
