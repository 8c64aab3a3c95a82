"""Scalar and array expressions: colours, blending weights, intensity corrections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_rgb(h: Column) -> list[Column]:
    """Red, green and blue in 0..1 of a six-figure hex colour."""
    return [F.conv(F.substring(h, k, 2), 16, 10).cast("int") / 255.0 for k in (1, 3, 5)]


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(F.round(c * 255).cast("bigint")), 2, "0") for c in (r, g, b)])


def sigmoid_weights(n: int, steepness: float) -> Column:
    """Falling blending weights over ``n`` pixels of an overlap; the ends are 1 and 0."""
    middle = (n + 1) / 2
    return F.array(*[F.lit(1.0 if i == 1 else 0.0 if i == n else 1 - 1 / (1 + math.exp(steepness * (middle - i)))) for i in range(1, n + 1)])


def linear_weights(n: int) -> Column:
    return F.array(*[F.lit(1 - (i - 1) / max(1, n - 1)) for i in range(1, n + 1)])


def adjust_intensity(pixel: Column, gain: Column, flat: Column, dark: Column, lower: Column, upper: Column, gamma: float = 1.0) -> Column:
    """Gain of the tile, flat and dark field, then rescale to lower..upper on the 16-bit scale with gamma."""
    corrected = (pixel * gain - dark) / flat + dark
    unit = F.greatest(F.least((corrected / 65535.0 - lower) / (upper - lower), F.lit(1.0)), F.lit(0.0))
    return F.round(F.pow(unit, F.lit(gamma)) * 65535.0).cast("int")


def rescale16(pixel: Column, low: Column, high: Column) -> Column:
    """Minimum and maximum stretched to 0..65535."""
    return F.when(high == low, 0).otherwise(F.round((pixel - low) / (high - low) * 65535.0)).cast("int")


def before(text: Column, mark: str) -> Column:
    """What stands before the first mark; empty without one."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(F.when(text.isNotNull(), ""))


def after(text: Column, mark: str) -> Column:
    """What stands after the first mark; empty without one."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise(F.when(text.isNotNull(), ""))
