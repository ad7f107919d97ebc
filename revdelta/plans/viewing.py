"""Queries of what a viewer derives: labelled regions, settings, colours and its state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from revdelta.functions import viewing as V
from revdelta.operators import labels
from revdelta.plans import sql
from revdelta.plans.visual import BOX
from revdelta.sources.comparisons import change_rows, comparison_rows
from revdelta.sources.revisions import revision_pages, table

PAGE_PIXELS = (900, 2800)
#: Rules for regions and overlays, in SQL that any engine reads: r is a line's number, t its text.
REGION_RULES = {"place": "r + 1", "id": "'area-' || r", "change_class": "case r % 3 when 0 then 'content' when 1 then 'reflow' else 'graphic' end"}
OVERLAY_RULES = {
    "place": "r + 1", "kind": "case r % 4 when 0 then 'added' when 1 then 'removed' else 'changed' end",
    "text": "case when r % 5 = 3 then ' ' else 'Line  ' || r || ' of ' || length(t) || ' characters, ' || repeat('long ', r % 17) end",
}


def _percent_boxes(spark, sf_dir, side, rules):
    rows = revision_pages(spark, sf_dir).where(F.col("side") == side).select(
        "pair_id", F.col("page_number").alias("idx"), F.posexplode(F.split("text", "\n")).alias("r", "t")
    ).where("length(t) > 0")
    rows = rows.select("pair_id", "idx", *[F.expr(e).alias(n) for n, e in rules.items()], *[F.expr(BOX[c]).alias(c) for c in ("x", "y", "width", "height")])
    percent = V.percent_box({c: F.col(c) for c in ("x", "y", "width", "height")}, *map(F.lit, PAGE_PIXELS))
    return rows.withColumns(percent)


def described_regions(spark, sf_dir):
    """Regions of the earlier page named after overlays of the newer one."""
    overlays = _percent_boxes(spark, sf_dir, "newer", OVERLAY_RULES).where("place % 4 != 2").withColumn("side", F.lit("newer"))
    found = labels.describe(_percent_boxes(spark, sf_dir, "earlier", REGION_RULES), labels.first_overlays(overlays))
    return found.select(
        "pair_id", "idx", "place", "id", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")], "kind", "label", "change_class"
    )


def percent_quads(spark, sf_dir):
    """The corners of a rendered item in percent of its page; pages without geometry have none."""
    rows = revision_pages(spark, sf_dir).select("pair_id", "side", F.col("page_number").alias("p"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    quad = F.array(point(F.col("p"), F.lit(10)), point(F.col("p") + 50, F.lit(10)), point(F.col("p") + 50, F.lit(22)), point(F.col("p"), F.lit(22)))
    scale = F.when(F.col("p") % 5 != 4, 1.5)
    made = V.percent_quad(quad, scale, F.col("p") % 3 / 2, F.lit(0.25), F.lit(918), F.lit(1188))
    return rows.select("pair_id", "side", F.col("p").alias("page_number"), F.posexplode(made).alias("corner", "q")).select(
        "pair_id", "side", "page_number", "corner", F.round("q.x", 6).alias("x"), F.round("q.y", 6).alias("y")
    )


def page_walker(spark, sf_dir):
    """What a reader of each page is told: its changes in the view's mode and filter, and where
    the selection stands. Modes, filters, areas and selections follow from the page's number."""
    rows = comparison_rows(spark, sf_dir)
    changes = change_rows(rows).select("pair_id", "idx", F.concat(F.lit("semantic-"), F.col("seq")).alias("id"), "kind")
    areas = rows.where("idx % 5 > 0").select("pair_id", "idx", F.explode(F.expr("sequence(1, idx % 5)")).alias("seq"))
    areas = areas.select("pair_id", "idx", F.concat(F.lit("area-"), F.col("seq")).alias("id"), F.lit("changed").alias("kind"))
    state = rows.withColumns({n: F.expr(e) for n, e in WALK_RULES.items()})
    listed = labels.page_changes(changes, areas, state.select("pair_id", "idx", "mode", "text_filter"))
    order = Window.partitionBy("pair_id", "idx").orderBy(F.regexp_extract("id", r"(\d+)$", 1).cast("int"))
    numbered = listed.select("pair_id", "idx", "id", (F.row_number().over(order) - 1).alias("at"))
    kept = labels.still_selected(state.select("pair_id", "idx", "selected"), listed).withColumnRenamed("selected", "kept")
    counts = listed.groupBy("pair_id", "idx").agg(F.count("*").alias("n"))
    whole = rows.groupBy("pair_id").agg(F.count("*").alias("pages"), F.count_if((F.col("status") != "same") | (F.col("alignment") == "moved")).alias("changed"))
    told = state.join(kept, ["pair_id", "idx"]).join(counts, ["pair_id", "idx"], "left").join(whole, "pair_id")
    told = told.join(numbered.withColumnRenamed("id", "kept"), ["pair_id", "idx", "kept"], "left")
    n, at = F.coalesce("n", F.lit(0)), F.coalesce("at", F.lit(-1))
    n_text = F.when(F.col("mode") == "semantic-text", n).otherwise(F.lit(0))
    return told.select(
        "pair_id", "idx", F.col("kept").alias("selected"), V.walker(n, at, F.col("mode")).alias("walker"),
        V.rail_status(F.col("status"), n, F.col("mode")).alias("status_text"), V.rail_summary(F.col("idx") - 1, F.col("pages"), F.col("changed")).alias("rail"),
        V.text_summary(F.col("text_unreadable"), n_text, F.col("text_filter")).alias("text_summary"),
    )


#: Rules for a page's view, in SQL that any engine reads.
WALK_RULES = {
    "mode": "case idx % 3 when 0 then 'overlay' when 1 then 'semantic-text' else 'split' end",
    "text_filter": "case idx % 4 when 0 then 'all' when 1 then 'added' when 2 then 'removed' else 'changed' end",
    "selected": "case idx % 6 when 1 then 'semantic-' || (1 + idx % 2) when 3 then 'area-2' when 5 then 'area-1' end",
}


def viewer_state(spark, sf_dir):
    """Filters, zoom, page and status of viewer states that the events stand for."""
    e = F.col("event_id")
    choice = F.get(F.lit(list(V.FILTERS)), (e % 4).cast("int"))
    some = lambda k: F.when(e % k != 0, F.lit("src"))
    kind = F.get(F.lit(["added", "removed", "changed"]), (e % 3).cast("int"))
    running = F.when(e % 7 == 3, e % 50)
    return table(spark, sf_dir, "events").select(
        "event_id", choice.alias("text_filter"), V.next_filter(choice, (e % 3 - 1).cast("int")).alias("next_filter"),
        V.clamp_zoom(e % 600 - 50 + e % 10 / 10).alias("zoom"), V.clamp_page(e % 40 - 5, e % 23).alias("page"),
        V.page_status(F.when(e % 11 == 2, "same"), some(2), some(3), some(5)).alias("status"),
        V.shows(kind, choice).alias("shown"), V.shows_side(choice, F.when(e % 2 == 0, "newer").otherwise("earlier")).alias("side_shown"),
        V.workspace_headline(running, e % 50 + 7, F.lit("No differences detected at current settings")).alias("headline"),
    )


#: Stored settings by rule: usable fields, fields of the wrong kind or size, and no JSON at all.
STORED = """case event_id % 8
 when 0 then '{"addedColor":[' || (event_id % 256) || ',2,3],"unchangedOpacity":0.25}'
 when 1 then '{"addedColor":[1,2],"removedColor":[7,8.5,' || (event_id % 9) || ']}'
 when 2 then 'null' when 3 then '{"addedColor":[1,2,' when 4 then '{"modifiedColor":[9,1,2],"unchangedOpacity":1.5}'
 when 5 then '{"unchangedOpacity":"0.3","removedColor":["1","2","3"]}' when 6 then '{"unchangedOpacity":1,"modifiedColor":{"r":1}}'
 else '[1,2,3]' end"""


def overlay_settings(spark, sf_dir):
    got = table(spark, sf_dir, "events").select("event_id", V.overlay_settings(F.expr(STORED)).alias("s"))
    numbers = [F.get(f"s.{c}_color", F.lit(i)).alias(f"{c}_{i}") for c in ("added", "removed", "modified") for i in range(3)]
    return got.select("event_id", *numbers, F.col("s.opacity").alias("opacity"))


#: Written colours by rule.
WRITTEN = """case page_id % 6 when 0 then '#00fF7f' when 1 then ' a1B2c3 ' when 2 then '#12345' when 3 then 'red' when 4 then null else '#0102030' end"""


def color_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    p = F.col("page_id")
    given = F.array((p % 700 - 200).cast("double"), p / 4, F.when(p % 9 == 4, float("nan")).otherwise(F.lit(99.5)))
    given = F.when(p % 7 == 1, F.slice(given, 1, 2)).otherwise(given)
    parsed, valid = V.rgb(F.expr(WRITTEN), V.ADDED), V.valid_color(given, V.REMOVED)
    return pages.select("page_id", *[F.get(parsed, F.lit(i)).alias(f"hex_{i}") for i in range(3)], *[F.get(valid, F.lit(i)).alias(f"valid_{i}") for i in range(3)])


QUERIES = {f.__name__: f for f in (page_walker, described_regions, percent_quads, viewer_state, overlay_settings, color_parse)}

_SIDE = """(select pair_id, page_number as idx, {rules}, {x} / 9e2 * 100 as x, {y} / 28e2 * 100 as y, {width} / 9e2 * 100 as width, {height} / 28e2 * 100 as height
  from (select pair_id, page_number, unnest(range(len(l))) as r, unnest(l) as t from (
    select *, string_split(text, chr(10)) as l from pages_rev where side = '{side}')) where length(t) > 0)"""
_side = lambda side, rules: _SIDE.format(side=side, rules=", ".join(f"{e} as {n}" for n, e in rules.items()), **{c: BOX[c] for c in ("x", "y", "width", "height")})  # noqa: E731, E501

ORACLES = {
    "page_walker": sql.over(
        f"""select pair_id, idx, sel as selected,
          case when pos is null then n || ' ' || unit || if(n = 1, '', 's') else upper(left(unit, 1)) || unit[2:] || ' ' || pos || ' of ' || n end || ' on this page' as walker,
          case when status = 'changed' and n > 0 then n || ' ' || unit || if(n = 1, '', 's') else
            map {{'same': 'No changes', 'added': 'Added', 'removed': 'Removed', 'changed': 'Changed'}}[status] end as status_text,
          format('Page {{}} of {{}}', idx, pages) || if(changed > 0, ' · ' || changed || ' changed', '') as rail,
          case when text_unreadable then 'Text could not be read' when mode = 'semantic-text' and n > 0 then ''
            when text_filter = 'all' then 'No semantic text changes' else 'No ' || text_filter || ' text on this page' end as text_summary
        from (select s.*, len(ids) as n, nullif(list_position(ids, selected), 0) as pos, if(list_contains(ids, selected), selected, null) as sel,
            if(mode = 'semantic-text', 'text change', 'area') as unit, count(*) over (partition by pair_id) as pages,
            count(*) filter (status != 'same' or alignment = 'moved') over (partition by pair_id) as changed
          from (select r.*, {', '.join(f'{e} as {n}' for n, e in WALK_RULES.items())}, if(idx % 3 = 1,
              coalesce((select list('semantic-' || c.seq order by c.seq) from changes c where c.pair_id = r.pair_id and c.idx = r.idx
                and (r.idx % 4 = 0 or c.kind = ['added', 'removed', 'changed'][(r.idx % 4)::int])), []),
              list_transform(range(1, r.idx % 5 + 1), lambda k: 'area-' || k)) as ids from rows_cmp r) s)""",
        upto=sql.CHANGES,
    ),
    "described_regions": sql.over(
        """select pair_id, idx, row_number() over (partition by pair_id, idx order by place) as place, id, round(x, 6) as x, round(y, 6) as y,
          round(r - x, 6) as width, round(b - y, 6) as height, case when told is null then 'changed' else mk end as kind,
          coalesce(told, 'Changed area ' || count(*) filter (told is null) over (partition by pair_id, idx order by place)) as label, change_class
        from (select *, case when short != '' then case mk when 'added' then 'Added' when 'removed' then 'Removed' else 'Changed' end || ' “' || short || '”' end as told
          from (select *, case when length(clean) > 60 then clean[:59] || '…' else clean end as short from (
            select pair_id, idx, min(place) as place, arg_min(id, place) as id, min(x) as x, min(y) as y, max(x + width) as r, max(y + height) as b,
              arg_min(kind, place) as mk, trim(regexp_replace(arg_min(text, place), '\\s+', ' ', 'g')) as clean, arg_min(change_class, place) as change_class
            from best group by pair_id, idx, case when op is null then 'r' || place else 'o' || op end)))""",
        f"regs as {_side('earlier', REGION_RULES)}",
        f"overs as (select * from {_side('newer', OVERLAY_RULES)} where place % 4 != 2 qualify row_number() over (partition by pair_id, idx order by place) <= 160)",
        """met as (
          select r.pair_id, r.idx, r.place, o.place as op, o.kind, o.text,
            (least(r.x + r.width + 4e-1, o.x + o.width) - greatest(r.x - 4e-1, o.x)) * (least(r.y + r.height + 4e-1, o.y + o.height) - greatest(r.y - 4e-1, o.y)) as area
          from regs r join overs o on r.pair_id = o.pair_id and r.idx = o.idx and r.x - 4e-1 < o.x + o.width and o.x < r.x + r.width + 4e-1
            and r.y - 4e-1 < o.y + o.height and o.y < r.y + r.height + 4e-1
          qualify row_number() over (partition by r.pair_id, r.idx, r.place order by area desc, op) = 1)""",
        "best as (select r.*, m.op, m.kind, m.text from regs r left join met m using (pair_id, idx, place))", upto=sql.PAGES,
    ),
    "percent_quads": sql.over(
        """select pair_id, side, page_number, corner, round(((page_number + dx) * 15e-1 + page_number % 3 / 2e0) / 918 * 100, 6) as x,
          round((y * 15e-1 + 25e-2) / 1188 * 100, 6) as y
        from pages_rev, (values (0, 0, 10), (1, 50, 10), (2, 50, 22), (3, 0, 22)) c(corner, dx, y) where page_number % 5 != 4""", upto=sql.PAGES,
    ),
    "viewer_state": """
        select event_id, f as text_filter, case when step = 0 then f when step = 1 then
            case f when 'all' then 'added' when 'added' then 'removed' when 'removed' then 'changed' else 'all' end
          else case f when 'all' then 'changed' when 'changed' then 'removed' when 'removed' then 'added' else 'all' end end as next_filter,
          case when z < 25 then 25 when z > 400 then 400 else z end as zoom,
          case when event_id % 40 < 5 or event_id % 23 = 0 then 0 when event_id % 40 - 5 >= event_id % 23 then event_id % 23 - 1 else event_id % 40 - 5 end as page,
          case when event_id % 11 = 2 then 'same' when event_id % 2 != 0 and event_id % 3 != 0 and event_id % 5 != 0 then 'changed' else 'processing' end as status,
          f = 'all' or f = k as shown,
          case f when 'added' then event_id % 2 = 0 when 'removed' then event_id % 2 = 1 else true end as side_shown,
          case when event_id % 7 = 3 then 'Comparing ' || event_id % 50 || ' of ' || (event_id % 50 + 7) || ' pages…'
            else 'No differences detected at current settings' end as headline
        from (select event_id, ['all', 'added', 'removed', 'changed'][event_id % 4 + 1] as f, ['added', 'removed', 'changed'][event_id % 3 + 1] as k,
          event_id % 3 - 1 as step, floor(event_id % 600 - 50 + event_id % 10 / 10 + 5e-1)::int as z from events)""",
    "overlay_settings": f"""
        with raw as (select event_id, case when json_valid(s) then s end as s from (select event_id, {STORED} as s from events)),
        parts as (select event_id, c, case when json_array_length(s, '$.' || c) = 3 and (
            select bool_and(json_type(s, '$.' || c || '[' || i || ']') in ('UBIGINT', 'BIGINT', 'DOUBLE')) from range(3) t(i))
            then [json_extract(s, '$.' || c || '[0]')::double, json_extract(s, '$.' || c || '[1]')::double, json_extract(s, '$.' || c || '[2]')::double] end as v
          from raw, (values ('addedColor'), ('removedColor'), ('modifiedColor')) n(c)),
        wide as (select event_id, max(v) filter (c = 'addedColor') as a, max(v) filter (c = 'removedColor') as r, max(v) filter (c = 'modifiedColor') as m
          from parts group by event_id)
        select event_id, {", ".join(f"coalesce({k}[{i + 1}], {color[i]}::double) as {n}_{i}"
                                    for k, n, color in (("a", "added", V.ADDED), ("r", "removed", V.REMOVED), ("m", "modified", V.MODIFIED)) for i in range(3))},
          case when json_type(s, '$.unchangedOpacity') in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_extract(s, '$.unchangedOpacity')::double between 0 and 1
            then json_extract(s, '$.unchangedOpacity')::double else 4e-1 end as opacity
        from raw join wide using (event_id)""",
    "color_parse": f"""
        with p as (select page_id, nullif(regexp_extract(trim({WRITTEN}), '(?i)^#?([0-9a-f]{{6}})$', 1), '') as h from pages)
        select page_id, {", ".join(f"coalesce(('0x' || h[{2 * i + 1}:{2 * i + 2}])::int, {V.ADDED[i]}) as hex_{i}" for i in range(3))},
          case when page_id % 9 = 4 or page_id % 7 = 1 then {V.REMOVED[0]} else greatest(0, least(255, page_id % 700 - 200))::int end as valid_0,
          case when page_id % 9 = 4 or page_id % 7 = 1 then {V.REMOVED[1]} else greatest(0, least(255, floor(page_id / 4 + 5e-1)))::int end as valid_1,
          case when page_id % 9 = 4 or page_id % 7 = 1 then {V.REMOVED[2]} else 100 end as valid_2 from p""",
}
