"""Boxes: features, overlaps, directions, crops, visual token costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(c: Column) -> dict[str, Column]:
    """Corner columns of a bbox array (null where the box is null or short)."""
    return {k: F.try_element_at(c, F.lit(i)) for i, k in enumerate(("x1", "y1", "x2", "y2"), 1)}


def features(x1, y1, x2, y2) -> dict[str, Column]:
    """Width, height, centre, area and aspect ratio (0 for a box without height)."""
    w, h = x2 - x1, y2 - y1
    return {"width": w, "height": h, "cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2, "area": w * h,
            "aspect_ratio": F.when(h == 0, 0.0).otherwise(w / h)}


def overlap(a1, a2, b1, b2) -> Column:
    """Length two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def overlap_ratio(a1, a2, b1, b2) -> Column:
    """Shared length over the smaller interval (0 where that is empty)."""
    small = F.least(a2 - a1, b2 - b1)
    return F.when(small > 0, overlap(a1, a2, b1, b2) / small).otherwise(0.0)


def iou(a: dict, b: dict) -> Column:
    inter = overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def centre_distance(a: dict, b: dict) -> Column:
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def vertically_close(a: dict, b: dict, most: float = 200.0) -> Column:
    return F.least(F.abs(a["y1"] - b["y2"]), F.abs(b["y1"] - a["y2"])) < most


def direction(a: dict, b: dict) -> Column:
    """Where b lies as seen from a: right, below, left, above within 30 degrees, else near."""
    dx = (b["x1"] + b["x2"] - a["x1"] - a["x2"]) / 2
    dy = (b["y1"] + b["y2"] - a["y1"] - a["y2"]) / 2
    angle = F.degrees(F.atan2(dy, dx))
    return (F.when(F.abs(angle) <= 30, "right").when(F.abs(angle) >= 150, "left").when((angle >= 60) & (angle <= 120), "below")
            .when((angle >= -120) & (angle <= -60), "above").otherwise("near"))


def arc_weight(distance, overlap_iou, scale: float = 300.0, gain: float = 1.0, least: float = 1e-8) -> Column:
    return F.greatest(1.0 / (1.0 + distance / scale) + gain * overlap_iou, F.lit(least))


def crop(x1, y1, x2, y2, width: float, height: float, margin: float = 0.1) -> dict[str, Column]:
    """Crop window with a margin, clamped to the page."""
    dx, dy = (x2 - x1) * margin, (y2 - y1) * margin
    return {"left": F.greatest(F.lit(0.0), x1 - dx), "top": F.greatest(F.lit(0.0), y1 - dy),
            "right": F.least(F.lit(width), x2 + dx), "bottom": F.least(F.lit(height), y2 + dy)}


def box_tokens(x1, y1, x2, y2, width: float, height: float, pad: float = 10.0, patch: int = 14, merge: int = 2,
               least: int = 3136, most: int = 1_003_520) -> Column:
    """Visual tokens of a padded crop rescaled into the pixel bounds; 0 for null boxes."""
    w = F.greatest(F.least(F.lit(width), x2 + pad) - F.greatest(F.lit(0.0), x1 - pad), F.lit(1.0))
    h = F.greatest(F.least(F.lit(height), y2 + pad) - F.greatest(F.lit(0.0), y1 - pad), F.lit(1.0))
    area = w * h
    f = F.when(area > most, F.sqrt(F.lit(float(most)) / area)).when(area < least, F.sqrt(F.lit(float(least)) / area)).otherwise(1.0)
    return F.coalesce(F.ceil(F.ceil(w * f / patch) * F.ceil(h * f / patch) / (merge * merge)), F.lit(0)).cast("bigint")


def reading_key(x1, y1) -> Column:
    """Sort key of the reading order: rows of eight points, half-even rounded, then from the left."""
    return F.struct(F.bround(y1 / 8), x1)


def location_score(cx, cy, width: Column, height: Column, hint: str) -> Column:
    """How well a centre fits a spatial hint such as "top left", 0 to 1."""
    nx, ny = cx / width, cy / height
    parts = []
    for word, penalty in (("top", ny), ("bottom", 1 - ny), ("left", nx), ("right", 1 - nx)):
        if word in hint.lower():
            parts.append(penalty)
    if "center" in hint.lower() or "centre" in hint.lower() or "middle" in hint.lower():
        parts.append((F.abs(nx - 0.5) + F.abs(ny - 0.5)))
    total = parts[0] if parts else F.lit(0.0)
    for p in parts[1:]:
        total = total + p
    return 1.0 - total / max(len(parts), 1)
