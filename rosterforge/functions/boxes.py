"""Box arithmetic on structs ``x, y, width, height`` (pixels) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(value).cast("long")


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def clamp(b: Column, image_width: Column, image_height: Column) -> Column:
    """Rounded box inside the image, at least one pixel wide and high."""
    x = F.greatest(F.lit(0), F.least(half_even(b["x"]), image_width - 1))
    y = F.greatest(F.lit(0), F.least(half_even(b["y"]), image_height - 1))
    w = F.greatest(F.lit(1), F.least(half_even(b["width"]), image_width - x))
    h = F.greatest(F.lit(1), F.least(half_even(b["height"]), image_height - y))
    return box(x, y, w, h)


def expand(b: Column, pad_x: Column, pad_y: Column, image_width: Column, image_height: Column) -> Column:
    grown = box(b["x"] - pad_x, b["y"] - pad_y, b["width"] + pad_x * 2, b["height"] + pad_y * 2)
    return clamp(grown, image_width, image_height)


def expand_ratio(b: Column, ratio: float, image_width: Column, image_height: Column) -> Column:
    return expand(b, b["width"] * ratio, b["height"] * ratio, image_width, image_height)


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def centre_x(b: Column) -> Column:
    return b["x"] + b["width"] / 2


def centre_y(b: Column) -> Column:
    return b["y"] + b["height"] / 2


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def touching(a: Column, b: Column) -> Column:
    """Cheap first test: whether two boxes share any area."""
    return ((a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"])
            & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"]))


def iou(a: Column, b: Column) -> Column:
    both = shared_area(a, b)
    return both / F.greatest(F.lit(1), area(a) + area(b) - both)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller area."""
    return shared_area(a, b) / F.greatest(F.lit(1), F.least(area(a), area(b)))


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["width"], b["x"] + b["width"]) - x,
               F.greatest(a["y"] + a["height"], b["y"] + b["height"]) - y)


def from_relative(left: Column, top: Column, width: Column, height: Column,
                  image_width: Column, image_height: Column) -> Column:
    """Guided fractions of the image to a pixel box."""
    return clamp(box(left * image_width, top * image_height, width * image_width, height * image_height),
                 image_width, image_height)


def from_label(xc: Column, yc: Column, w: Column, h: Column, image_width: Column, image_height: Column) -> Column:
    """Normalised centre form to a pixel box."""
    pw, ph = w * image_width, h * image_height
    return clamp(box(xc * image_width - pw / 2, yc * image_height - ph / 2, pw, ph), image_width, image_height)


def to_label(b: Column, image_width: Column, image_height: Column) -> Column:
    """Pixel box to normalised centre form ``xc, yc, w, h``."""
    return F.struct((centre_x(b) / image_width).alias("xc"), (centre_y(b) / image_height).alias("yc"),
                    (b["width"] / image_width).alias("w"), (b["height"] / image_height).alias("h"))


def label_line(class_id: Column | int, label: Column) -> Column:
    class_col = class_id if isinstance(class_id, Column) else F.lit(class_id)
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_col, label["xc"], label["yc"], label["w"], label["h"])
