"""Sizes, offsets and boxes in points, pixels and percent, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the render and comparison policy.
RENDER_SCALE, RENDER_PIXELS, RENDER_EDGE = 2.0, 3_000_000, 2800
SENSITIVITY, MIN_PIXELS, CLASSIFY_LIMIT, ADDED_THRESHOLD = 28, 8, 1200, 0.08

# SQL that any engine reads; w and h are a page's points, scale the wished one
USED_SCALE = f"greatest(1e-2, least({RENDER_SCALE:e}, sqrt({RENDER_PIXELS} / (w * h)), {RENDER_EDGE} / greatest(w, h)))"
RENDER_WIDTH = f"cast(greatest(1, ceil(w * {USED_SCALE})) as int)"
RENDER_HEIGHT = f"cast(greatest(1, ceil(h * {USED_SCALE})) as int)"
THRESHOLD = "greatest(25e-3, 18e-2 - sensitivity * 145e-5)"
GAP_X = "cast(greatest(6, floor(h * 9e-3 + 5e-1)) as int)"
GAP_Y = "cast(greatest(2, floor(h * 25e-4 + 5e-1)) as int)"


def threshold(sensitivity: float) -> float:
    """The colour difference from which a pixel counts as changed."""
    return max(0.025, 0.18 - sensitivity * 0.00145)


def common_grid(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The pixel grid on which both pages of a pair are drawn, and where each begins in it.

    sizes: (keys, side, w, h) in points. The grid is that of a page as wide and as high as
    the larger of both; pages stand in its middle. Offsets of a missing side are null.
    """
    own = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    sides = [own(side, c) for side in ("earlier", "newer") for c in "wh"]
    both = sizes.groupBy(*keys).agg(F.max("w").alias("w"), F.max("h").alias("h"), *sides)
    both = both.select("*", *[F.expr(e).alias(n) for n, e in (("width", RENDER_WIDTH), ("height", RENDER_HEIGHT), ("scale", USED_SCALE))])
    offsets = [
        center_offset(F.col(canvas), F.col(f"{side}_{c}"), F.col("scale")).alias(f"{side}_{axis}")
        for side in ("earlier", "newer") for canvas, c, axis in (("width", "w", "x"), ("height", "h", "y"))
    ]
    return both.select(*keys, "width", "height", "scale", *offsets)


def center_offset(canvas: Column, points: Column, scale: Column) -> Column:
    return (canvas - points * scale) / 2


def item_quad(transform: Column, width: Column, height: Column) -> Column:
    """Corner points (top left, top right, bottom right, bottom left) of an item whose
    combined transform is [a, b, c, d, e, f]: baseline at (e, f), ascent 0.8."""
    at = lambda i: F.get(transform, F.lit(i))
    angle = F.atan2(at(1), at(0))
    cos, sin = F.cos(angle), F.sin(angle)
    size = font_size(transform)
    tall = F.greatest(size, F.coalesce(height, size))
    wide = F.greatest(F.lit(0.0), F.coalesce(width, F.lit(0.0)))
    x, y = at(4) + sin * size * 0.8, at(5) - cos * size * 0.8
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    return F.array(
        point(x, y), point(x + cos * wide, y + sin * wide),
        point(x - sin * tall + cos * wide, y + cos * tall + sin * wide), point(x - sin * tall, y + cos * tall),
    )


def font_size(transform: Column) -> Column:
    return F.greatest(F.lit(0.01), F.hypot(F.get(transform, F.lit(2)), F.get(transform, F.lit(3))))


def affine(first: Column, second: Column) -> Column:
    """The product of two affine transforms of six numbers."""
    a, b = (lambda i: F.get(first, F.lit(i))), (lambda i: F.get(second, F.lit(i)))
    return F.array(
        a(0) * b(0) + a(2) * b(1), a(1) * b(0) + a(3) * b(1), a(0) * b(2) + a(2) * b(3),
        a(1) * b(2) + a(3) * b(3), a(0) * b(4) + a(2) * b(5) + a(4), a(1) * b(4) + a(3) * b(5) + a(5),
    )


def bounds(quad: Column) -> Column:
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"),
    )


def is_horizontal(quad: Column) -> Column:
    """Whether a quad's text runs across the page rather than along it."""
    p = lambda i, c: F.get(quad, F.lit(i))[c]
    return F.abs(p(1, "x") - p(0, "x")) >= F.abs(p(1, "y") - p(0, "y"))


def sub_quad(quad: Column, start: Column, end: Column) -> Column:
    """The part of a quad between two shares of its length."""
    p = lambda i: F.get(quad, F.lit(i))
    mix = lambda a, b, t: F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
    return F.array(mix(p(0), p(1), start), mix(p(0), p(1), end), mix(p(3), p(2), end), mix(p(3), p(2), start))


def highlight(quad: Column, line: Column, text: Column) -> Column:
    """The part of a line's quad that `text` covers; the whole quad unless it is a proper part."""
    at = F.instr(line, text) - 1
    size = F.length(line)
    part = sub_quad(quad, at / size, (at + F.length(text)) / size)
    return F.when((F.length(text) > 0) & (text != line) & (at >= 0), part).otherwise(quad)
