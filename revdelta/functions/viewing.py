"""What a viewer of comparisons derives from a row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The text filters in their order, zoom bounds, and the drawing defaults.
FILTERS = ("all", "added", "removed", "changed")
LEAST_ZOOM, MOST_ZOOM = 25, 400
ADDED, REMOVED, MODIFIED, OPACITY = (16, 190, 190), (238, 72, 86), (184, 126, 220), 0.4


def next_filter(current: Column, step: Column) -> Column:
    """The text filter that many steps on, around the end."""
    ids = F.lit(list(FILTERS))
    at = F.array_position(ids, current) - 1
    return F.get(ids, F.pmod(at + step, F.lit(len(FILTERS))).cast("int"))


def clamp_zoom(zoom: Column) -> Column:
    return F.greatest(F.lit(LEAST_ZOOM), F.least(F.lit(MOST_ZOOM), F.floor(zoom + 0.5).cast("int")))


def clamp_page(index: Column, pages: Column) -> Column:
    return F.least(F.greatest(F.lit(0), index), F.greatest(F.lit(0), pages - 1))


def page_status(status: Column, before: Column, after: Column, diff: Column) -> Column:
    """The given status; else changed where all three images are there, processing where not."""
    made = before.isNotNull() & after.isNotNull() & diff.isNotNull()
    return F.coalesce(status, F.when(made, "changed").otherwise("processing"))


def workspace_headline(completed: Column, total: Column, headline: Column) -> Column:
    """How far a comparison is, or what it found."""
    running = F.concat(F.lit("Comparing "), completed, F.lit(" of "), total, F.lit(" pages…"))
    return F.when(completed.isNotNull(), running).otherwise(headline)


def shows(kind: Column, text_filter: Column) -> Column:
    return (text_filter == "all") | (kind == text_filter)


def shows_side(text_filter: Column, side: Column) -> Column:
    """Additions live on the newer page, removals on the earlier one, the rest on both."""
    return text_filter.isin("all", "changed") | (F.when(text_filter == "added", "newer").otherwise("earlier") == side)


def counted(n: Column, mode: Column) -> Column:
    """So many changes, in the unit that a view walks: text changes in text mode, else areas."""
    noun = F.when(mode == "semantic-text", "text change").otherwise("area")
    return F.concat(n, F.lit(" "), noun, F.when(n == 1, "").otherwise("s"))


def walker(n: Column, selected: Column, mode: Column) -> Column:
    """Where a reader stands among a page's changes; selected counts from 0, -1 is none."""
    name = F.when(mode == "semantic-text", "Text change").otherwise("Area")
    stands = F.concat(name, F.lit(" "), selected + 1, F.lit(" of "), n)
    return F.concat(F.when(selected < 0, counted(n, mode)).otherwise(stands), F.lit(" on this page"))


#: What a rail says of a page's state, and text mode of a page without changes.
STATES = {"same": "No changes", "added": "Added", "removed": "Removed", "changed": "Changed", "processing": "Comparing…", "error": "Error"}
NO_TEXT = {"all": "No semantic text changes", "added": "No added text on this page", "removed": "No removed text on this page", "changed": "No changed text on this page"}


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def rail_status(status: Column, n: Column, mode: Column) -> Column:
    """A changed page's count of changes, any other one's state."""
    return F.when((status == "changed") & (n > 0), counted(n, mode)).otherwise(_named(status, STATES))


def rail_summary(index: Column, pages: Column, changed: Column) -> Column:
    more = F.when(changed > 0, F.concat(F.lit(" · "), changed, F.lit(" changed"))).otherwise("")
    return F.concat(F.lit("Page "), index + 1, F.lit(" of "), pages, more)


def text_summary(unreadable: Column, n: Column, text_filter: Column) -> Column:
    return F.when(unreadable, "Text could not be read").when(n > 0, "").otherwise(_named(text_filter, NO_TEXT))


def rgb(hex_text: Column, fallback: tuple[int, int, int]) -> Column:
    """The channels of #rrggbb, with or without the mark; anything else is the fallback."""
    digits = F.regexp_extract(F.trim(hex_text), "(?i)^#?([0-9a-f]{6})$", 1)
    channel = lambda i: F.conv(F.substr(digits, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
    return F.when(F.length(digits) == 6, F.array(*[channel(i) for i in range(3)])).otherwise(F.lit(list(fallback)))


def valid_color(channels: Column, fallback: tuple[int, int, int]) -> Column:
    """Three finite numbers, rounded and clamped to 0 to 255; else the fallback."""
    finite = F.forall(channels, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    clamped = F.transform(channels, lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5).cast("int"))))
    return F.when((F.size(channels) == 3) & finite, clamped).otherwise(F.lit(list(fallback)))


def overlay_settings(stored: Column) -> Column:
    """Drawing settings from stored JSON, each field that cannot be used replaced by its
    default; so is everything where the text is no JSON."""
    whole = F.try_parse_json(stored)
    number = "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)"
    part = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    is_ = lambda name, kind: F.coalesce(F.schema_of_variant(part(name)).rlike(f"^{kind}$"), F.lit(False))

    def color(name: str, fallback: tuple[int, int, int]) -> Column:
        numbers = F.try_variant_get(whole, f"$.{name}", "array<double>")
        fits = is_(name, f"ARRAY<{number}>") & (F.size(numbers) == 3)
        return F.when(fits, numbers).otherwise(F.lit([float(c) for c in fallback]))

    opacity = F.when(is_("unchangedOpacity", number), F.try_variant_get(whole, "$.unchangedOpacity", "double"))
    return F.struct(
        color("addedColor", ADDED).alias("added_color"), color("removedColor", REMOVED).alias("removed_color"),
        color("modifiedColor", MODIFIED).alias("modified_color"),
        F.when(opacity.between(0, 1), opacity).otherwise(OPACITY).alias("opacity"),
    )


def percent_box(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """A box of pixels in percent of its page."""
    return {
        "x": box["x"] / width * 100, "y": box["y"] / height * 100,
        "width": box["width"] / width * 100, "height": box["height"] / height * 100,
    }


def percent_quad(quad: Column, scale: Column, offset_x: Column, offset_y: Column, width: Column, height: Column) -> Column:
    """A quad of points in percent of the rendered page; none where the page has no geometry."""
    none = F.array().cast("array<struct<x:double,y:double>>")
    placed = F.transform(quad, lambda p: F.struct(
        ((p["x"] * scale + offset_x) / width * 100).alias("x"), ((p["y"] * scale + offset_y) / height * 100).alias("y")
    ))
    return F.when(scale.isNotNull(), placed).otherwise(none)
