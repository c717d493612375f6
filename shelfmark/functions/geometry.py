"""Box expressions: reading, scaling and clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def zero_box() -> Column:
    return F.array(*[F.lit(0.0) for _ in range(4)])


def norm_box(raw: Column) -> Column:
    """First four numbers of a JSON box; anything shorter is the zero box."""
    nums = F.from_json(raw, "array<double>")
    return F.when(F.size(nums) >= 4, F.slice(nums, 1, 4)).otherwise(zero_box())


def page_box(box: Column, width: Column, height: Column) -> Column:
    """Scale a 0-1000 box to page units."""
    return F.array(
        box[0] / 1000 * width, box[1] / 1000 * height, box[2] / 1000 * width, box[3] / 1000 * height
    )


def percent_box(box: Column) -> Column:
    """Clip to 0-1000 and return left/top/width/height in percent; NULL without area."""
    left, top, right, bottom = (
        F.greatest(F.lit(0.0), F.least(F.lit(1000.0), box[i])) for i in range(4)
    )
    shape = F.struct(
        (left / 10).alias("left"),
        (top / 10).alias("top"),
        ((right - left) / 10).alias("width"),
        ((bottom - top) / 10).alias("height"),
    )
    return F.when((F.size(box) >= 4) & (right > left) & (bottom > top), shape)


def box_list(raw: Column) -> Column:
    """Boxes out of JSON text; malformed text or short boxes are dropped."""
    boxes = F.from_json(raw, "array<array<double>>")
    good = F.filter(boxes, lambda b: (F.size(b) >= 4) & ~F.exists(F.slice(b, 1, 4), lambda v: v.isNull()))
    return F.coalesce(F.transform(good, lambda b: F.slice(b, 1, 4)), F.array().cast("array<array<double>>"))


def string_list(raw: Column) -> Column:
    """Strings out of JSON text; malformed text is an empty list, empty items are dropped."""
    items = F.from_json(raw, "array<string>")
    return F.coalesce(F.filter(items, lambda s: F.coalesce(s, F.lit("")) != ""), F.array().cast("array<string>"))
