"""Queries of pixels, rasters, regions and their classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from revdelta.functions import geometry as G
from revdelta.operators import alignment, classify, pixels, rasters
from revdelta.plans import sql
from revdelta.sources.revisions import revision_pages

THRESHOLD = G.threshold(G.SENSITIVITY)


def changed_mask(spark, sf_dir):
    return rasters.mask_lines(_raster_pairs(spark, sf_dir), THRESHOLD, include_smoothing=True)


def smoothed_pixels(spark, sf_dir):
    """Pixels over the threshold and those that anti-aliasing explains, for each page pair."""
    return rasters.smoothing_counts(_raster_pairs(spark, sf_dir), THRESHOLD)


def pixel_counts(spark, sf_dir):
    """Counts of one pass over both rasters of a pair; no pixel becomes a row."""
    found = rasters.compare(_raster_pairs(spark, sf_dir), THRESHOLD, include_smoothing=True, align=False)
    return found.where("changed_pixels > 0").select("pair_id", "idx", "changed_pixels", "added_pixels", "removed_pixels", "modified_pixels")


def pixel_direction(spark, sf_dir):
    found = rasters.tint_sums(_raster_pairs(spark, sf_dir), THRESHOLD, include_smoothing=True)
    return found.groupBy("direction").agg(F.sum("n").alias("n"))


def overlay_pixels(spark, sf_dir):
    return rasters.tint_sums(_raster_pairs(spark, sf_dir), THRESHOLD, include_smoothing=True).drop("n")


def translation_score(spark, sf_dir):
    scores = rasters.ink_shift_totals(_raster_pairs(spark, sf_dir), 1, 5, 2)
    return scores.withColumn("total", F.round("total", 3))


def raster_pairs(pages, pairs):
    """Both pages of each pair (pair_id, idx, earlier_page, newer_page) as texts, with the size of
    one canvas for their grids, which are drawn where they are compared; a page without a
    partner has a blank one."""
    side = lambda s: pages.where(F.col("side") == s).select("pair_id", F.col("page_number").alias(f"{s}_page"), F.col("text").alias(s))
    both = pairs.select("pair_id", "idx", "earlier_page", "newer_page")
    for s in ("earlier", "newer"):
        both = both.join(side(s), ["pair_id", f"{s}_page"], "left")
    both = both.select("pair_id", F.col("idx").cast("int").alias("idx"), "earlier", "newer").fillna("", ["earlier", "newer"])
    both = both.repartition(4 * pages.sparkSession.sparkContext.defaultParallelism)
    grids = [F.split(s, "\n") for s in ("earlier", "newer")]
    width = F.greatest(F.lit(1), *[F.array_max(F.transform(g, F.length)) for g in grids])
    return both.select("pair_id", "idx", width.alias("width"), F.greatest(*[F.size(g) for g in grids]).alias("height"), "earlier", "newer")


def _raster_pairs(spark, sf_dir):
    pages = revision_pages(spark, sf_dir)
    return raster_pairs(pages, alignment.by_position(alignment.fingerprints(pages)))


def overlay_layers(spark, sf_dir):
    """How much of each layer shows and what they come to when composed, for shifted pages too:
    the newer page is moved a column to the right on every third one."""
    pairs = _raster_pairs(spark, sf_dir).withColumn("dx", F.expr("cast(idx % 3 = 1 as int)"))
    return rasters.layer_sums(pairs, THRESHOLD, True).drop("dx")


def visual_diff(spark, sf_dir):
    found = rasters.compare(_raster_pairs(spark, sf_dir), THRESHOLD)
    return found.select(*[c for c in found.columns if c not in ("regions", "overlay")], F.size("regions").alias("n_regions"))


def regions(spark, sf_dir):
    found = rasters.compare(_raster_pairs(spark, sf_dir), THRESHOLD)
    return found.select("pair_id", "idx", F.posexplode("regions").alias("place", "r")).select("pair_id", "idx", "place", "r.*")


def overlay_png(spark, sf_dir):
    found = rasters.compare(_raster_pairs(spark, sf_dir), THRESHOLD, overlays=True)
    return found.select("pair_id", "idx", F.length("overlay").alias("bytes"), F.md5("overlay").alias("png_md5"))


def _line_boxes(spark, sf_dir, side):
    """A box for each text line of a page: 6 pixels for a character, 14 for a line."""
    lines = revision_pages(spark, sf_dir).where(F.col("side") == side).select(
        "pair_id", F.col("page_number").alias("idx"), F.posexplode(F.split("text", "\n")).alias("r", "t")
    ).where("length(t) > 0")
    return lines.select("pair_id", "idx", (F.col("r") + 1).alias("id"), *[F.expr(e).alias(n) for n, e in BOX.items()])


BOX = {
    "x": "cast((r * 37) % 300 as int)", "y": "cast(r * 14 as int)", "width": "cast(6 * (length(t) % 90) as int)", "height": "cast(4 + r % 9 as int)",
    "pixel_count": "cast(length(t) * (1 + r % 3) as bigint)",
}
ROLE = "case id % 3 when 0 then 'changed' when 1 then 'moved' else 'static' end"


def _classified(spark, sf_dir):
    boxes = _line_boxes(spark, sf_dir, "newer").where("id % 4 != 2").withColumn("role", F.expr(ROLE))
    return classify.classify(_line_boxes(spark, sf_dir, "earlier"), boxes)


def classify_regions(spark, sf_dir):
    return _classified(spark, sf_dir).select("pair_id", "idx", "id", "change_class")


def class_counts(spark, sf_dir):
    return classify.class_counts(_classified(spark, sf_dir))


def regions_display(spark, sf_dir):
    return classify.shown(_classified(spark, sf_dir), 3).select("pair_id", "idx", "id", "change_class")


def regions_topk(spark, sf_dir):
    return classify.largest(_line_boxes(spark, sf_dir, "earlier"), 5).select("pair_id", "idx", "id", "pixel_count", "rank")


def reading_order(spark, sf_dir):
    boxes = _line_boxes(spark, sf_dir, "earlier").withColumn("page_height", F.lit(2800))
    return classify.reading_order(boxes, "page_height").select("pair_id", "idx", "id", "place")


def merge_edges(spark, sf_dir):
    return classify.merge_edges(_line_boxes(spark, sf_dir, "earlier"), 6, 2)


def regions_merged(spark, sf_dir):
    return classify.merge_nearby(_line_boxes(spark, sf_dir, "earlier"), 40, 5)


def regions_grown(spark, sf_dir):
    return classify.merge_nearby(_line_boxes(spark, sf_dir, "earlier"), 40, 5, grow=True)


def _sizes(spark, sf_dir):
    """Page sizes in points by rule."""
    pages = revision_pages(spark, sf_dir)
    return pages.select("pair_id", "side", "page_number", *[F.expr(e).alias(n) for n, e in SIZES.items()])


SIZES = {"w": "2e2 + (page_number * 97) % 3000", "h": "3e2 + length(text) % 2500", "sensitivity": "page_number % 120"}
GEOMETRY = {
    "used_scale": G.USED_SCALE, "render_width": G.RENDER_WIDTH, "render_height": G.RENDER_HEIGHT,
    "offset_x": f"({G.RENDER_WIDTH} - w * {G.USED_SCALE}) / 2", "offset_y": f"({G.RENDER_HEIGHT} - h * {G.USED_SCALE}) / 2",
    "threshold": G.THRESHOLD, "gap_x": G.GAP_X, "gap_y": G.GAP_Y,
}


def render_size(spark, sf_dir):
    return _sizes(spark, sf_dir).select("pair_id", "side", "page_number", *[F.expr(e).alias(n) for n, e in GEOMETRY.items()])


def page_grids(spark, sf_dir):
    """The grid of both pages at one place, whatever their sizes."""
    return G.common_grid(_sizes(spark, sf_dir).withColumnRenamed("page_number", "idx"), ["pair_id", "idx"])


def item_geometry(spark, sf_dir):
    """Quads and bounds of one item a page, turned by its page number, under the page's flip."""
    d = F.col("page_number") * 0.1
    own = F.array(F.cos(d) * 10, F.sin(d) * 10, -F.sin(d) * 10, F.cos(d) * 10, F.col("page_number") * 3.0, F.lit(40.0))
    page = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 792.0)])
    pages = revision_pages(spark, sf_dir).withColumn("t", G.affine(page, own))
    quad = G.item_quad(F.col("t"), (F.length("text") % 50 + 1).cast("double"), F.lit(12.0))
    boxed = pages.withColumn("quad", quad).withColumn("box", G.bounds(F.col("quad")))
    half = G.sub_quad(F.col("quad"), F.lit(0.25), F.lit(0.5))
    corner = lambda q, i, a, n: F.round(F.get(q, F.lit(i))[a], 6).alias(n)
    return boxed.select(
        "pair_id", "side", "page_number", F.round(G.font_size(F.col("t")), 6).alias("font_size"),
        *[F.round(f"box.{c}", 6).alias(f"box_{c}") for c in ("x", "y", "width", "height")],
        corner(F.col("quad"), 0, "x", "left_x"), corner(F.col("quad"), 2, "y", "right_y"), corner(half, 1, "x", "part_x"),
    )


QUERIES = {f.__name__: f for f in (
    changed_mask, smoothed_pixels, pixel_counts, pixel_direction, overlay_pixels, translation_score, visual_diff, overlay_layers, regions, overlay_png,
    classify_regions, class_counts, regions_display, regions_topk, reading_order, merge_edges, regions_merged, regions_grown, render_size, page_grids,
    item_geometry,
)}

_PIXELS = """
px as (
  select pair_id, side, idx, y, x, ascii(c) % 200 as v from (
    select pair_id, side, idx, y, unnest(range(len(cs))) as x, unnest(cs) as c from (
      select pair_id, side, page_number as idx, y, string_split(words, '') as cs from (
        select pair_id, side, page_number, unnest(range(len(l))) as y, unnest(l) as words
        from (select *, string_split(text, chr(10)) as l from pages_rev)) where words != '')) where c not in (' ', '')
),
two as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.idx, b.idx) as idx, coalesce(a.x, b.x) as x, coalesce(a.y, b.y) as y,
    coalesce(a.v, 255) as ar, coalesce(a.v, 255) as ag, coalesce(a.v, 255) as ab, coalesce(b.v, 255) as br, coalesce(b.v, 255) as bg, coalesce(b.v, 255) as bb
  from (select * from px where side = 'earlier') a full join (select * from px where side = 'newer') b
  on a.pair_id = b.pair_id and a.idx = b.idx and a.x = b.x and a.y = b.y
)"""
_CHANGED = _PIXELS + f""",
chg as (select *, {pixels.DIRECTION} as direction, {pixels.STRENGTH} as strength from two where {pixels.DELTA} > 35215 * {THRESHOLD} * {THRESHOLD})"""
_tint = lambda i: f"floor(255 - (255 - case direction when 'added' then {pixels.ADDED[i]} when 'removed' then {pixels.REMOVED[i]} else {pixels.MODIFIED[i]} end) * strength + 0.5)::bigint"  # noqa: E731, E501
#: A pixel of the composed layers: unchanged ones faint on white, changed ones in their colour.
_LAYER = lambda i: (
    f"floor(case when not is_changed then 255 * (1 - {pixels.OPACITY}::double) + ar * {pixels.OPACITY}::double else 255 * (1 - alpha / 255) + "
    f"case direction when 'added' then {pixels.ADDED[i]} when 'removed' then {pixels.REMOVED[i]} else {pixels.MODIFIED[i]} end * (alpha / 255) end + 0.5)"
)
_SIZES = """
sizes_c as (select pair_id, page_number as idx, max(len(l)) as h, greatest(1, max(list_max(list_transform(l, lambda t: length(t))))) as w
  from (select *, string_split(text, chr(10)) as l from pages_rev) group by pair_id, page_number)"""
#: Of pixels over the threshold: their neighbours on either side, the darkest and the lightest
#: (the first of equals by column, then line), and whether these stand in flat areas of both.
_SMOOTHING = """
cand as (select chg.pair_id, chg.idx, x, y, w, h from chg join sizes_c using (pair_id, idx)),
side as (select * from (values ('earlier'), ('newer')) t(side)),
step as (select dx, dy from (select unnest([-1, 0, 1]) as dx) a, (select unnest([-1, 0, 1]) as dy) b where dx != 0 or dy != 0),
own as (select c.*, s.side, coalesce(p.v, 255) as v from cand c cross join side s
  left join px p on p.pair_id = c.pair_id and p.idx = c.idx and p.side = s.side and p.x = c.x and p.y = c.y),
near as (select o.pair_id, o.idx, o.side, o.x, o.y, o.w, o.h, dx, dy, coalesce(p.v, 255) - o.v as gap from own o cross join step
  left join px p on p.pair_id = o.pair_id and p.idx = o.idx and p.side = o.side and p.x = o.x + dx and p.y = o.y + dy
  where o.x + dx between 0 and o.w - 1 and o.y + dy between 0 and o.h - 1),
ends as (select pair_id, idx, side, x, y, w, h, min({'g': gap, 'dx': dx, 'dy': dy}) as low, min({'g': -gap, 'dx': dx, 'dy': dy}) as high
  from near group by all having count(*) filter (gap = 0) + (count(*) < 8)::int <= 2 and min(gap) < 0 and max(gap) > 0),
spots as (select distinct pair_id, idx, w, h, ex, ey from (select *, x + low.dx as ex, y + low.dy as ey from ends
  union all select *, x + high.dx, y + high.dy from ends)),
spot_v as (select c.*, s.side, coalesce(p.v, 255) as v from spots c cross join side s
  left join px p on p.pair_id = c.pair_id and p.idx = c.idx and p.side = s.side and p.x = c.ex and p.y = c.ey),
flat_one as (select o.pair_id, o.idx, o.ex, o.ey, o.side from spot_v o cross join step
  left join px p on p.pair_id = o.pair_id and p.idx = o.idx and p.side = o.side and p.x = o.ex + dx and p.y = o.ey + dy
  where o.ex + dx between 0 and o.w - 1 and o.ey + dy between 0 and o.h - 1
  group by all having count(*) filter (coalesce(p.v, 255) = o.v) + (count(*) < 8)::int > 2),
flat as (select pair_id, idx, ex, ey from flat_one group by all having count(*) = 2),
smooth as (select distinct e.pair_id, e.idx, e.side, e.x, e.y from ends e join flat f on f.pair_id = e.pair_id and f.idx = e.idx
  and (f.ex = e.x + low.dx and f.ey = e.y + low.dy or f.ex = e.x + high.dx and f.ey = e.y + high.dy))"""
_BOXES = f"""
boxes as (select pair_id, side, page_number as idx, r + 1 as id, {", ".join(f"{e} as {n}" for n, e in BOX.items())} from (
  select pair_id, side, page_number, unnest(range(len(l))) as r, unnest(l) as t from (select *, string_split(text, chr(10)) as l from pages_rev))
  where length(t) > 0),
regs as (select * from boxes where side = 'earlier'),
classed as (
  select r.pair_id, r.idx, r.id, r.pixel_count, case min(case role when 'changed' then 1 when 'moved' then 2 when 'static' then 3 end)
    when 1 then 'content' when 2 then 'reflow' when 3 then 'formatting' else 'graphic' end as change_class
  from regs r left join (select *, {ROLE} as role from boxes where side = 'newer' and id % 4 != 2) b
  on r.pair_id = b.pair_id and r.idx = b.idx and r.x - 2 < b.x + b.width and b.x < r.x + r.width + 2 and r.y - 2 < b.y + b.height and b.y < r.y + r.height + 2
  group by all
)"""

ORACLES = {
    "overlay_layers": sql.over(
        f"""select pair_id, idx, w as width, h as height, w * h - changed as base_pixels, 255 * (w * h - changed - inked) + grey as base_grey, added_alpha, removed_alpha, modified_alpha,
          red + 255 * (w * h - changed - inked) as red, green + 255 * (w * h - changed - inked) as green, blue + 255 * (w * h - changed - inked) as blue
        from (select pair_id, idx, w, h, count(*) filter (is_changed) as changed, count(*) filter (not is_changed) as inked, coalesce(sum(ar) filter (not is_changed), 0)::bigint as grey,
            {', '.join(f"coalesce(sum(alpha) filter (is_changed and direction = '{d}'), 0)::bigint as {d}_alpha" for d in ("added", "removed", "modified"))},
            {', '.join(f"coalesce(sum({_LAYER(i)}), 0)::bigint as {c}" for i, c in enumerate(("red", "green", "blue")))}
          from (select *, floor(strength * 255 + 0.5) as alpha from (select *, {pixels.DIRECTION} as direction, {pixels.STRENGTH} as strength, {pixels.DELTA} > 35215 * {THRESHOLD} * {THRESHOLD} as is_changed from canvas
            where x is not null)) right join sizes_c using (pair_id, idx, w, h) group by all)""",
        _PIXELS, _SIZES, """
canvas as (
  select c.pair_id, c.idx, c.w, c.h, t.x, coalesce(a.v, 255) as ar, coalesce(a.v, 255) as ag, coalesce(a.v, 255) as ab, coalesce(b.v, 255) as br, coalesce(b.v, 255) as bg, coalesce(b.v, 255) as bb
  from sizes_c c join (select pair_id, idx, x + if(side = 'newer' and idx % 3 = 1, 1, 0) as x, y from px group by all) t on t.pair_id = c.pair_id and t.idx = c.idx and t.x < c.w
  left join px a on a.side = 'earlier' and a.pair_id = t.pair_id and a.idx = t.idx and a.x = t.x and a.y = t.y
  left join px b on b.side = 'newer' and b.pair_id = t.pair_id and b.idx = t.idx and b.x + if(b.idx % 3 = 1, 1, 0) = t.x and b.y = t.y
)""", upto=sql.PAGES,
    ),
    "changed_mask": sql.over("select pair_id, idx, y, count(*) as n, min(x) as first_x, max(x) as last_x from chg group by all", _CHANGED, upto=sql.PAGES),
    "smoothed_pixels": sql.over(
        """select pair_id, idx, over, coalesce(e, 0) as smooth_earlier, coalesce(n, 0) as smooth_newer, coalesce(t, 0) as smooth
        from (select pair_id, idx, count(*) as over from cand group by all) left join (
          select pair_id, idx, count(*) filter (side = 'earlier') as e, count(*) filter (side = 'newer') as n, count(distinct (x, y)) as t
          from smooth group by all) using (pair_id, idx)""",
        _CHANGED, _SIZES, _SMOOTHING, upto=sql.PAGES,
    ),
    "pixel_counts": sql.over(
        "select pair_id, idx, count(*) as changed_pixels, " + ", ".join(f"count(*) filter (direction = '{d}') as {d}_pixels" for d in ("added", "removed", "modified"))
        + " from chg group by all", _CHANGED, upto=sql.PAGES,
    ),
    "pixel_direction": sql.over("select direction, count(*) as n from chg group by all", _CHANGED, upto=sql.PAGES),
    "overlay_pixels": sql.over(
        "select pair_id, idx, direction, " + ", ".join(f"sum({_tint(i)})::bigint as sum_{c}" for i, c in enumerate("rgb")) + " from chg group by all",
        _CHANGED, upto=sql.PAGES,
    ),
    "translation_score": sql.over(
        """select a.pair_id, a.idx, dx, dy, round(sum(abs(a.v - b.v))::double, 3) as total, count(*) as samples
        from px a, (select unnest([-1, 0, 1])::int as dx) u, (select unnest([-1, 0, 1])::int as dy) v, px b
        where a.side = 'earlier' and b.side = 'newer' and a.pair_id = b.pair_id and a.idx = b.idx and b.x = a.x - dx and b.y = a.y - dy
          and a.x >= 2 and a.y >= 2 and (a.x - 2) % 5 = 0 and (a.y - 2) % 5 = 0 group by all""", _PIXELS, upto=sql.PAGES,
    ),
    "classify_regions": sql.over("select pair_id, idx, id, change_class from classed", _BOXES, upto=sql.PAGES),
    "class_counts": sql.over(
        "select pair_id, idx, " + ", ".join(f"count(*) filter (change_class = '{c}') as {c}" for c in classify.CLASSES)
        + ", count(*) filter (change_class in ('content', 'graphic')) > 0 as noticeable from classed group by all", _BOXES, upto=sql.PAGES,
    ),
    "regions_display": sql.over(
        """select pair_id, idx, id, change_class from classed qualify row_number() over (partition by pair_id, idx
        order by case when change_class in ('content', 'graphic') then 0 else 1 end, pixel_count desc, id) <= 3""", _BOXES, upto=sql.PAGES,
    ),
    "regions_topk": sql.over(
        """select pair_id, idx, id, pixel_count, row_number() over (partition by pair_id, idx order by pixel_count desc, id) as rank
        from regs qualify rank <= 5""", _BOXES, upto=sql.PAGES,
    ),
    "reading_order": sql.over(
        "select pair_id, idx, id, row_number() over (partition by pair_id, idx order by floor(y / 28), x, y, id) as place from regs",
        _BOXES, upto=sql.PAGES,
    ),
    "merge_edges": sql.over(
        """select a.pair_id, a.idx, a.id, b.id as other from regs a join regs b on a.pair_id = b.pair_id and a.idx = b.idx and a.id < b.id
        where greatest(a.x - (b.x + b.width), b.x - (a.x + a.width)) <= 6 and greatest(a.y - (b.y + b.height), b.y - (a.y + a.height)) <= 2""",
        _BOXES, upto=sql.PAGES,
    ),
    "regions_merged": sql.over(
        """select r.pair_id, r.idx, root as id, min(x) as x, min(y) as y, max(x + width) - min(x) as width, max(y + height) - min(y) as height,
          sum(pixel_count)::bigint as pixel_count from regs r
          join (select pair_id, idx, id, min(root) as root from reach group by all) c on c.pair_id = r.pair_id and c.idx = r.idx and c.id = r.id group by all""",
        _BOXES, """near as (select a.pair_id, a.idx, a.id, b.id as other from regs a join regs b on a.pair_id = b.pair_id and a.idx = b.idx and a.id != b.id
          where greatest(a.x - (b.x + b.width), b.x - (a.x + a.width)) <= 40 and greatest(a.y - (b.y + b.height), b.y - (a.y + a.height)) <= 5),
        reach as (select pair_id, idx, id, id as root from regs
          union select n.pair_id, n.idx, n.other, r.root from reach r join near n on n.pair_id = r.pair_id and n.idx = r.idx and n.id = r.id)""",
        upto=sql.PAGES,
    ),
    "render_size": sql.over(
        f"select pair_id, side, page_number, {', '.join(f'{e} as {n}' for n, e in GEOMETRY.items())} from"
        f" (select *, {', '.join(f'{e} as {n}' for n, e in SIZES.items())} from pages_rev)", upto=sql.PAGES,
    ),
    "page_grids": sql.over(
        f"""select pair_id, idx, {G.RENDER_WIDTH} as width, {G.RENDER_HEIGHT} as height, {G.USED_SCALE} as scale,
          ({G.RENDER_WIDTH} - aw * {G.USED_SCALE}) / 2 as earlier_x, ({G.RENDER_HEIGHT} - ah * {G.USED_SCALE}) / 2 as earlier_y,
          ({G.RENDER_WIDTH} - bw * {G.USED_SCALE}) / 2 as newer_x, ({G.RENDER_HEIGHT} - bh * {G.USED_SCALE}) / 2 as newer_y
        from (select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.page_number, b.page_number) as idx, a.w as aw, a.h as ah, b.w as bw, b.h as bh,
            greatest(a.w, b.w) as w, greatest(a.h, b.h) as h
          from (select * from sized where side = 'earlier') a full join (select * from sized where side = 'newer') b
          on a.pair_id = b.pair_id and a.page_number = b.page_number)""",
        f"sized as (select pair_id, side, page_number, {', '.join(f'{e} as {n}' for n, e in SIZES.items())} from pages_rev)", upto=sql.PAGES,
    ),
    "item_geometry": sql.over(
        """select pair_id, side, page_number, 10.0::double as font_size,
          round(least(x0, x1, x2, x3), 6) as box_x, round(least(y0, y1, y2, y3), 6) as box_y,
          round(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3), 6) as box_width, round(greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3), 6) as box_height,
          round(x0, 6) as left_x, round(y2, 6) as right_y, round(x0 + (x1 - x0) * 0.5, 6) as part_x
        from (select *, x0 + cos(a) * w as x1, y0 + sin(a) * w as y1, x0 - sin(a) * 12 as x3, y0 + cos(a) * 12 as y3,
            x0 - sin(a) * 12 + cos(a) * w as x2, y0 + cos(a) * 12 + sin(a) * w as y2 from (
          select *, page_number * 3.0 + sin(a) * 8 as x0, 752 - cos(a) * 8 as y0 from (
            select pair_id, side, page_number, atan2(-sin(page_number * 0.1), cos(page_number * 0.1)) as a, (length(text) % 50 + 1)::double as w from pages_rev)))""",
        upto=sql.PAGES,
    ),
}
