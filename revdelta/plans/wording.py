"""Queries of word differences and of lines of positioned text."""

from __future__ import annotations

from pyspark.sql import functions as F

from revdelta.functions import geometry as G
from revdelta.functions import text as X
from revdelta.operators import alignment, edits, lines, spans
from revdelta.plans import sql
from revdelta.sources.scratch import stored
from revdelta.sources.revisions import CHAR_WIDTH, FONT_SIZE, LINE_HEIGHT, PAGE_HEIGHT, PAGE_WIDTH, PHRASE, revision_pages, text_items

KEYS = ["pair_id", "idx"]


def _positions(spark, sf_dir):
    pages = revision_pages(spark, sf_dir)
    paired = alignment.by_position(alignment.fingerprints(pages)).select("pair_id", "idx", "earlier_page", "newer_page")
    return pages, paired


def _texts(spark, sf_dir):
    """Both texts of every pair that the alignment makes; an absent side is empty."""
    pages = revision_pages(spark, sf_dir)
    paired = alignment.align(alignment.fingerprints(pages)).select("pair_id", "idx", "earlier_page", "newer_page")
    side = lambda s, page, name: pages.where(F.col("side") == s).select(
        "pair_id", F.col("page_number").alias(page), F.col("text").alias(name)
    )
    both = paired.join(side("earlier", "earlier_page", "before"), ["pair_id", "earlier_page"], "left")
    both = both.join(side("newer", "newer_page", "after"), ["pair_id", "newer_page"], "left")
    return both.select(*KEYS, F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def _edited(spark, sf_dir):
    return edits.token_edits(_texts(spark, sf_dir)).drop("before", "after")


def token_edits(spark, sf_dir):
    count = lambda e: F.size(F.filter("edits", lambda x: x == e))
    return _edited(spark, sf_dir).select(
        *KEYS, "exact", count("=").alias("n_same"), count("-").alias("n_removed"), count("+").alias("n_added")
    )


def segments(spark, sf_dir):
    """Segments of a fixed edit rule over both texts' tokens, so that SQL can follow."""
    return edits.segments(_ruled(spark, sf_dir), KEYS).select(
        *KEYS, "segment", "kind", F.size("before_tokens").alias("n_before"), F.size("after_tokens").alias("n_after"),
        F.md5(F.array_join("before_tokens", "|")).alias("before_md5"), F.md5(F.array_join("after_tokens", "|")).alias("after_md5"),
    )


def _ruled(spark, sf_dir):
    words = X.tokens(F.col("text"))
    return _marked(revision_pages(spark, sf_dir).where("side = 'earlier'").select("pair_id", F.col("page_number").alias("idx"), words.alias("a")))


def _marked(docs):
    """Token i of n is removed at i % 7 = 3, then an addition follows at i % 5 = 1; idx % 4 = 0 is inexact."""
    marks = F.flatten(F.transform("a", lambda t, i: F.concat(
        F.when(i % 7 == 3, F.array(F.lit("-"))).otherwise(F.array(F.lit("="))),
        F.when(i % 5 == 1, F.array(F.lit("+"))).otherwise(F.array().cast("array<string>")),
    )))
    kept = F.flatten(F.transform("a", lambda t, i: F.concat(
        F.when(i % 7 != 3, F.array(t)).otherwise(F.array().cast("array<string>")),
        F.when(i % 5 == 1, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")),
    )))
    return docs.select("pair_id", "idx", "a", kept.alias("b"), marks.alias("edits"), (F.col("idx") % 4 != 0).alias("exact"))


def text_runs(spark, sf_dir):
    runs = edits.text_runs(edits.segments(_ruled(spark, sf_dir), KEYS), KEYS)
    return runs.select(*KEYS, "segment", "side", "id", "kind", F.md5("text").alias("text_md5"))


def _ruled_pages(spark, sf_dir):
    """Both sides of the ruled edits as texts: the earlier page, and its changed tokens by spaces."""
    ruled = _ruled(spark, sf_dir)
    before = revision_pages(spark, sf_dir).where("side = 'earlier'").select("pair_id", F.col("page_number").alias("idx"), "text")
    return ruled, before, ruled.select(*KEYS, F.array_join("b", "  ").alias("text"))


def token_offsets(spark, sf_dir):
    pages = revision_pages(spark, sf_dir)
    return spans.token_offsets(pages, lines.PAGE).select(*lines.PAGE, "at", F.md5("token").alias("token_md5"), "start", "end")


def change_ranges(spark, sf_dir):
    ruled, before, after = _ruled_pages(spark, sf_dir)
    return spans.change_ranges(edits.segments(ruled, KEYS), before, after, KEYS)


def highlight_quads(spark, sf_dir):
    """Quads of removed and replaced tokens on the items that the earlier page is stitched from."""
    items = stored(text_items(revision_pages(spark, sf_dir)).where("side = 'earlier'"))
    texts = stored(lines.stitched(items))
    whole = texts.select("pair_id", F.col("page_number").alias("idx"), "text")
    ruled = _marked(whole.select(*KEYS, X.tokens(F.col("text")).alias("a")))
    told = spans.change_ranges(edits.segments(ruled, KEYS), whole, ruled.select(*KEYS, F.array_join("b", " ").alias("text")), KEYS)
    ranges = told.select("pair_id", F.lit("earlier").alias("side"), F.col("idx").alias("page_number"), "segment", F.col("before_start").alias("start"), F.col("before_end").alias("end"))
    corner = lambda i, c: F.round(F.get("quad", F.lit(i))[c], 6)
    return spans.highlights(ranges, items).select(
        "pair_id", "page_number", "segment", "item_index", corner(0, "x").alias("x0"), corner(0, "y").alias("y0"),
        corner(2, "x").alias("x2"), corner(2, "y").alias("y2"),
    )


def diff_text(spark, sf_dir):
    return edits.text_changes(edits.segments(_edited(spark, sf_dir), KEYS), KEYS)


def _items(spark, sf_dir):
    return text_items(revision_pages(spark, sf_dir))


ITEM = ["pair_id", "side", "page_number", "item_index"]


def page_items(spark, sf_dir):
    return _items(spark, sf_dir).select(*ITEM, F.md5("str").alias("str_md5"), "x", "y", "width", "height")


def item_orientation(spark, sf_dir):
    across = G.is_horizontal(spans.box_quad(F.col("rotated")))
    return _items(spark, sf_dir).groupBy("pair_id", "side", "page_number").agg(
        F.count_if(across).alias("n_horizontal"), F.count_if(~across).alias("n_rotated")
    )


def item_order(spark, sf_dir):
    return lines.ordered(_items(spark, sf_dir)).select(*ITEM, "place")


def text_columns(spark, sf_dir):
    """Columns of the items of one text row, rows given by their height on the page."""
    rows = _items(spark, sf_dir).where("not rotated").withColumn("row", F.col("y")).withColumn("place", F.col("item_index"))
    return lines.columns_of(rows, [*lines.PAGE, "row"], PAGE_WIDTH).select(*ITEM, F.col("col").cast("int").alias("col"))


def _lines(spark, sf_dir):
    return lines.text_lines(_items(spark, sf_dir), PAGE_WIDTH)


def text_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select(*lines.PAGE, "line", F.md5("text").alias("text_md5"), "x", "y", "width", "height", "n_items")


def _matched(spark, sf_dir):
    pages, paired = _positions(spark, sf_dir)
    return lines.match(lines.text_lines(text_items(pages), PAGE_WIDTH), paired, PAGE_WIDTH, PAGE_HEIGHT)


def match_lines(spark, sf_dir):
    return _matched(spark, sf_dir).select(*KEYS, "kind", "a_line", "b_line")


def diff_pages(spark, sf_dir):
    return lines.changes(_matched(spark, sf_dir))


def unchanged_lines(spark, sf_dir):
    return lines.unchanged(_matched(spark, sf_dir)).select(*KEYS, "a_line", "b_line", "shifted")


def _plain_lines(spark, sf_dir):
    """The text lines of pages as lines with a place each, without the item rules."""
    split = revision_pages(spark, sf_dir).select("pair_id", "side", "page_number", F.posexplode(F.split("text", "\n")).alias("r", "text"))
    return split.where("length(text) > 0").select(
        "pair_id", "side", "page_number", (F.col("r") + 1).alias("line"), "text", F.lower("text").alias("identity"),
        F.lower("text").alias("canonical"), F.lit(0.0).alias("x"), (F.col("r") * LINE_HEIGHT).alias("y"),
        (F.length("text") * CHAR_WIDTH).alias("width"), F.lit(FONT_SIZE).alias("height"),
    )


def _plain_sides(spark, sf_dir):
    _, paired = _positions(spark, sf_dir)
    return lines.sided(_plain_lines(spark, sf_dir), paired)


def _plain_rest(spark, sf_dir):
    """The plain lines of both sides that no equal line takes."""
    a, b = (stored(side) for side in _plain_sides(spark, sf_dir))
    same = stored(lines.exact_matches(a, b, PAGE_WIDTH, PAGE_HEIGHT))
    out = []
    for side, line in ((a, "a_line"), (b, "b_line")):
        out.append(side.join(same.select(*KEYS, line), [*KEYS, line], "left_anti"))
    return out


def exact_lines(spark, sf_dir):
    """Equal lines of page pairs, one to one; repeated ones take the nearest that is free."""
    return lines.exact_matches(*_plain_sides(spark, sf_dir), PAGE_WIDTH, PAGE_HEIGHT)


def similarity_ceiling(spark, sf_dir):
    """The bound, where it is high enough, over all lines that no equal line takes."""
    return lines.ceilings(*_plain_rest(spark, sf_dir)).select(*KEYS, "a_line", "b_line", F.round("ceiling", 9).alias("ceiling"))


def plain_candidates(spark, sf_dir):
    """Changed lines that may be each other's revision, lines as they stand in the text."""
    found = lines.candidates(*_plain_rest(spark, sf_dir), PAGE_WIDTH, PAGE_HEIGHT)
    return found.select(*KEYS, "a_line", "b_line", F.round("similarity", 9).alias("similarity"), F.round("score", 9).alias("score"))


def plain_matches(spark, sf_dir):
    """Every line of both sides once, lines as they stand in the text."""
    _, paired = _positions(spark, sf_dir)
    return lines.match(_plain_lines(spark, sf_dir), paired, PAGE_WIDTH, PAGE_HEIGHT).select(*KEYS, "kind", "a_line", "b_line")


def line_candidates(spark, sf_dir):
    """Changed lines that may be each other's revision, over all lines of all page pairs."""
    pages, paired = _positions(spark, sf_dir)
    a, b = (stored(side) for side in lines.sided(stored(lines.text_lines(text_items(pages), PAGE_WIDTH)), paired))
    same = lines.exact_matches(a, b, PAGE_WIDTH, PAGE_HEIGHT)
    a = a.join(same.select(*KEYS, "a_line"), [*KEYS, "a_line"], "left_anti")
    b = b.join(same.select(*KEYS, "b_line"), [*KEYS, "b_line"], "left_anti")
    found = lines.candidates(a, b, PAGE_WIDTH, PAGE_HEIGHT)
    return found.select(*KEYS, "a_line", "b_line", F.round("similarity", 9).alias("similarity"), F.round("score", 9).alias("score"))


QUERIES = {
    "line_candidates": line_candidates,
    "token_edits": token_edits,
    "segments": segments,
    "text_runs": text_runs,
    "token_offsets": token_offsets,
    "change_ranges": change_ranges,
    "highlight_quads": highlight_quads,
    "diff_text": diff_text,
    "page_items": page_items,
    "item_orientation": item_orientation,
    "item_order": item_order,
    "text_columns": text_columns,
    "text_lines": text_lines,
    "match_lines": match_lines,
    "diff_pages": diff_pages,
    "unchanged_lines": unchanged_lines,
    "exact_lines": exact_lines,
    "similarity_ceiling": similarity_ceiling,
    "plain_candidates": plain_candidates,
    "plain_matches": plain_matches,
}

ITEMS = rf"""
item_words as (
  select pair_id, side, page_number, line, unnest(range(len(w))) as k, unnest(w) as w, lead from (
    select *, regexp_extract_all(words, '{PHRASE}') as w, length(words) - length(ltrim(words, ' ')) as lead from (
      select pair_id, side, page_number, unnest(range(len(l))) as line, unnest(l) as words
      from (select *, string_split(text, chr(10)) as l from pages_rev)))
),
items as (
  select pair_id, side, page_number, line,
    row_number() over (partition by pair_id, side, page_number order by line, k) - 1 as item_index,
    rtrim(w, ' ') as str,
    {CHAR_WIDTH} * (lead + coalesce(sum(length(w)) over (partition by pair_id, side, page_number, line order by k
      rows between unbounded preceding and 1 preceding), 0))::double as x, {LINE_HEIGHT} * line::double as y
  from item_words
),
boxes as (
  select *, item_index % 31 = 7 as rotated,
    case when item_index % 31 = 7 then {FONT_SIZE} else length(str) * {CHAR_WIDTH} end::double as width,
    case when item_index % 31 = 7 then length(str) * {CHAR_WIDTH} else {FONT_SIZE} end::double as height
  from items
)"""
_PLAIN = """
plain as (
  select pair_id, side, page_number, line, text, lower(text) as low from (
    select pair_id, side, page_number, unnest(range(1, len(l) + 1)) as line, unnest(l) as text
    from (select *, string_split(text, chr(10)) as l from pages_rev)) where length(text) > 0
),
side_a as (select p.pair_id, p.idx, l.line, l.text, l.low from paired p join plain l
  on l.side = 'earlier' and l.pair_id = p.pair_id and l.page_number = p.earlier_page),
side_b as (select p.pair_id, p.idx, l.line, l.text, l.low from paired p join plain l
  on l.side = 'newer' and l.pair_id = p.pair_id and l.page_number = p.newer_page)"""
_RULED = f"""
ruled as (
  select pair_id, page_number as idx, regexp_extract_all(text, {sql.quoted(sql.TOKEN_RE2)}) as a from pages_rev where side = 'earlier'
),
marks as (
  select pair_id, idx, i * 2 + half as pos, case when half = 1 then '+' when i % 7 = 3 then '-' else '=' end as edit,
    case when half = 1 then 'new' else tok end as tok
  from (select pair_id, idx, unnest(range(len(a))) as i, unnest(a) as tok from ruled), (values (0), (1)) v(half)
  where half = 0 or i % 5 = 1
),
sorts as (select *, case when edit = '=' then '=' when idx % 4 != 0 then '~' else edit end as sort from marks),
islands as (
  select *, sum(fresh) over (partition by pair_id, idx order by pos) as segment from (
    select *, case when sort = lag(sort) over (partition by pair_id, idx order by pos) then 0 else 1 end as fresh from sorts)
),
segs as (
  select pair_id, idx, segment, count(*) filter (edit != '+') as n_before, count(*) filter (edit != '-') as n_after,
    coalesce(list(tok order by pos) filter (edit != '+'), []) as ta, coalesce(list(tok order by pos) filter (edit != '-'), []) as tb,
    case when min(sort) = '=' then 'same' when count(*) filter (edit != '+') > 0 and count(*) filter (edit != '-') > 0 then 'changed'
      when count(*) filter (edit != '+') > 0 then 'removed' else 'added' end as kind
  from islands group by pair_id, idx, segment
)"""
_GRAMS = """(case when len(c) < 3 then list_filter(c, lambda g: g != '') else
  list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) end)"""

#: Equal lines in turn: the next earlier one takes the nearest newer one that is free.
_SAME = f"""
equal_b as (select pair_id, idx, low, list(line order by line) as bs from side_b group by all),
equal_a as (select a.*, row_number() over (partition by a.pair_id, a.idx, a.low order by a.line) as k from side_a a),
taking as (
  select pair_id, idx, low, bs, 0::bigint as k, []::bigint[] as taken, null::bigint as a_line from equal_b
  union all
  select t.pair_id, t.idx, t.low, t.bs, a.k, list_append(t.taken, list_sort(list_transform(list_filter(t.bs, lambda b: not list_contains(t.taken, b)),
    lambda b: struct_pack(d := abs(((b - 1) * {LINE_HEIGHT}::double + 5) / {PAGE_HEIGHT} - ((a.line - 1) * {LINE_HEIGHT}::double + 5) / {PAGE_HEIGHT}), b := b)))[1].b), a.line
  from taking t join equal_a a on a.pair_id = t.pair_id and a.idx = t.idx and a.low = t.low and a.k = t.k + 1 where t.k < len(t.bs)
),
same as (select pair_id, idx, a_line, taken[-1] as b_line from taking where k > 0),
left_a as (select * from side_a l where not exists (select 1 from same s where s.pair_id = l.pair_id and s.idx = l.idx and s.a_line = l.line)),
left_b as (select * from side_b l where not exists (select 1 from same s where s.pair_id = l.pair_id and s.idx = l.idx and s.b_line = l.line))"""
#: Shared tokens and trigrams of all lines that are left.
_BOUNDED = "grams as (" + " union all ".join(f"""
select '{x}' as part, pair_id, idx, line, sort, gram, count(*) as n from (
  select pair_id, idx, line, 't' as sort, unnest(regexp_extract_all(low, {sql.quoted(sql.TOKEN_RE2)})) as gram from left_{x}
  union all select pair_id, idx, line, 'g', unnest({_GRAMS}) from (select *, string_split(regexp_replace(low, '[{sql.SPACE_RE2}]+', ' ', 'g'), '') as c from left_{x})) group by all"""
    for x in "ab") + """),
shares as (
  select a.pair_id, a.idx, a.line as a_line, b.line as b_line, sum(least(a.n, b.n)) filter (a.sort = 't') as t, sum(least(a.n, b.n)) filter (a.sort = 'g') as g
  from grams a join grams b on a.part = 'a' and b.part = 'b' and a.pair_id = b.pair_id and a.idx = b.idx and a.sort = b.sort and a.gram = b.gram group by all
),
gram_sizes as (select part, pair_id, idx, line, sum(n) filter (sort = 't') as nt, sum(n) filter (sort = 'g') as ng from grams group by all),
bounded as (
  select s.pair_id, s.idx, a_line, b_line, coalesce(2 * g / (x.ng + y.ng)::double, 0) as gram_dice,
    greatest(coalesce(2 * t / (x.nt + y.nt)::double, 0), coalesce(2 * g / (x.ng + y.ng)::double, 0) * 0.94::double) as ceiling
  from shares s join gram_sizes x on x.part = 'a' and x.pair_id = s.pair_id and x.idx = s.idx and x.line = a_line
  join gram_sizes y on y.part = 'b' and y.pair_id = s.pair_id and y.idx = s.idx and y.line = b_line
)"""
#: Longest common subsequences of tokens, row by row, then the score of each pair.
_SCORED = f"""
scored as (
  select * from (
    select *, similarity * 0.82::double + least(la, lb) / greatest(la, lb)::double * 0.18::double - sqrt(dx * dx + dy * dy) * 0.3::double as score from (
      select *, greatest(2 * lcs / (len(ta) + len(tb))::double, gram_dice * 0.94::double) as similarity,
        (wa / 2 - wb / 2) / {PAGE_WIDTH} as dx, (ya + 5) / {PAGE_HEIGHT} - (yb + 5) / {PAGE_HEIGHT} as dy from (
        select *, list_reduce(list_transform(ta, lambda x: list_transform(tb, lambda y: (x = y)::int)), lambda acc, f: list_reduce(
            list_transform(range(1, len(f) + 1), lambda j: [j::int]),
            lambda r, j: list_append(r, case when f[j[1]] = 1 then acc[j[1]] + 1 else greatest(acc[j[1] + 1], r[-1]) end), [0::int]),
          list_transform(range(0, len(tb) + 1), lambda z: 0::int))[-1] as lcs from (
          select c.*, regexp_extract_all(a.low, {sql.quoted(sql.TOKEN_RE2)}) as ta, regexp_extract_all(b.low, {sql.quoted(sql.TOKEN_RE2)}) as tb,
            length(a.low) as la, length(b.low) as lb, length(a.text) * {CHAR_WIDTH}::double as wa, length(b.text) * {CHAR_WIDTH}::double as wb,
            (a.line - 1) * {LINE_HEIGHT}::double as ya, (b.line - 1) * {LINE_HEIGHT}::double as yb,
            case when least(len(string_split(a.low, ' ')), len(string_split(b.low, ' '))) <= 2 then {lines.FLOOR_SHORT}::double else {lines.FLOOR}::double end as floor_at
          from bounded c join left_a a on a.pair_id = c.pair_id and a.idx = c.idx and a.line = a_line join left_b b on b.pair_id = c.pair_id and b.idx = c.idx and b.line = b_line)
        where ceiling >= floor_at)))
  where similarity >= floor_at and not (abs(wa / 2 - wb / 2) / {PAGE_WIDTH} > 0.24::double and similarity < 0.9::double)
)"""
_ACCEPTED = """
ranked as (select *, row_number() over (partition by pair_id, idx order by score desc, a_line, b_line) as k from scored),
accepting as (
  select distinct pair_id, idx, 0::bigint as k, []::bigint[] as used_a, []::bigint[] as used_b, false as taken, 0::bigint as a_line, 0::bigint as b_line from ranked
  union all
  select pair_id, idx, k, case when ok then list_append(used_a, a_line) else used_a end, case when ok then list_append(used_b, b_line) else used_b end, ok, a_line, b_line from (
    select t.pair_id, t.idx, r.k, t.used_a, t.used_b, r.a_line, r.b_line, not list_contains(t.used_a, r.a_line) and not list_contains(t.used_b, r.b_line) as ok
    from accepting t join ranked r on r.pair_id = t.pair_id and r.idx = t.idx and r.k = t.k + 1)
),
changed as (select pair_id, idx, a_line, b_line from accepting where taken)"""

#: Lines of pages: items of mostly short ones, and rotated ones, stand alone; else the items of
#: one height are cut into columns at wide gaps.
_LINES = f"""
sorted as (
  select *, row_number() over (partition by pair_id, side, page_number order by floor(y / 3.5 + 0.5), x, item_index) as place,
    avg(case when length(trim(str)) <= {lines.ATOMIC_CHARS} then 1.0 else 0.0 end) over (partition by pair_id, side, page_number) >= {lines.ATOMIC_SHARE}
      or rotated as alone
  from boxes where trim(str) != ''
),
columned as (
  select *, case when alone then 'i' || item_index else y || ':' || sum(fresh) over (partition by pair_id, side, page_number, alone, y order by x, place) end as grp
  from (select *, case when lx is null or x - (lx + lw) > greatest({PAGE_WIDTH} * 0.018, (lw / greatest(1, length(ls)) + width / greatest(1, length(str))) * 1.15)
      then 1 else 0 end as fresh, case when ls is null then ''
      when x - (lx + lw) > greatest(1, (lw / greatest(1, length(ls)) + width / greatest(1, length(str))) * 0.09) then ' ' else '' end as gap
    from (select *, lag(str) over w as ls, lag(x) over w as lx, lag(width) over w as lw from sorted
      window w as (partition by pair_id, side, page_number, alone, case when alone then item_index else y end order by x, place)))
),
lined as (
  select pair_id, side, page_number, trim(regexp_replace(string_agg(case when fresh = 1 then str else gap || str end, '' order by x, place), '[{sql.SPACE_RE2}]+', ' ', 'g')) as text,
    min(x) as x, min(y) as y, max(x + width) - min(x) as width, max(y + height) - min(y) as height, count(*) as n_items, min(place) as first_place
  from columned group by pair_id, side, page_number, grp
)"""

#: What parts an item from the last one in running text.
STITCHED = """
gapped as (
  select *, case when ls is null or ls = '' or str = '' then ''
      when regexp_matches(ls, '\\s$') or regexp_matches(str, '^\\s') then ''
      when least(ly + lh, y + height) - greatest(ly, y) < greatest(0.01, least(lh, height)) * 0.25
        and abs(ly + lh / 2 - y - height / 2) > 5.5 then chr(10)
      when x + greatest(1, (lw / greatest(1, length(ls)) + width / greatest(1, length(str))) / 2) < lx then chr(10)
      when x - (lx + lw) > greatest(1, (lw / greatest(1, length(ls)) + width / greatest(1, length(str))) / 2) * 0.18 then ' ' else '' end as gap
  from (select *, lag(str) over w as ls, lag(x) over w as lx, lag(y) over w as ly, lag(width) over w as lw, lag(height) over w as lh
    from boxes window w as (partition by pair_id, side, page_number order by item_index))
)"""
#: Characters of each segment's tokens on both sides; the newer side's are parted by two spaces.
_RANGED = """
ranged as (
  select i.pair_id, i.idx, i.segment, min(o.start_at) filter (edit != '+') as a1, max(o.end_at) filter (edit != '+') as a2,
    min(upto - length(tok)) filter (edit != '-') as b1, max(upto) filter (edit != '-') as b2
  from (select *, sum(case when edit != '-' then length(tok) + 2 else 0 end) over (partition by pair_id, idx order by pos)::bigint - 2 as upto from islands) i
  left join (select pair_id, page_number, pos, start_at, end_at from offs) o on o.pair_id = i.pair_id and o.page_number = i.idx and o.pos = i.pos // 2
  group by all
)"""
def _offsets(texts: str) -> str:
    """Tokens with the white space before them; their lengths add up to the places."""
    return f"""
offs as (
  select pair_id, side, page_number, k - 1 as pos, tok, ends - length(tok) as start_at, ends as end_at from (
    select *, sum(length(piece)) over (partition by pair_id, side, page_number order by k)::bigint as ends, regexp_replace(piece, '^[{sql.SPACE_RE2}]+', '') as tok from (
      select pair_id, side, page_number, unnest(range(1, len(ps) + 1)) as k, unnest(ps) as piece from (
        select *, regexp_extract_all(text, {sql.quoted(f"[{sql.SPACE_RE2}]*(?:{sql.TOKEN_RE2})")}) as ps from {texts})))
)"""


ORACLES = {
    "text_lines": sql.over(
        """select pair_id, side, page_number, row_number() over (partition by pair_id, side, page_number order by y, x, first_place) as line,
          md5(text) as text_md5, x, y, width, height, n_items from lined where regexp_matches(text, '[\\p{L}\\p{N}]')""",
        ITEMS, _LINES, upto=sql.PAGES,
    ),
    "segments": sql.over(
        "select pair_id, idx, segment, kind, n_before, n_after, md5(coalesce(array_to_string(ta, '|'), '')) as before_md5,"
        " md5(coalesce(array_to_string(tb, '|'), '')) as after_md5 from segs", _RULED, upto=sql.PAGES,
    ),
    "text_runs": sql.over(
        f"""select pair_id, idx, segment, side, 'semantic-' || segment || '-' || side as id, kind, md5(t) as text_md5 from (
          select *, 'before' as side, {sql.joined('ta')} as t from segs
          union all select *, 'after', {sql.joined('tb')} from segs) where t != ''""", _RULED, upto=sql.PAGES,
    ),
    "token_offsets": sql.over(
        'select pair_id, side, page_number, pos as "at", md5(tok) as token_md5, start_at as "start", end_at as "end" from offs',
        _offsets("pages_rev"), upto=sql.PAGES,
    ),
    "change_ranges": sql.over(
        """select i.pair_id, i.idx, segment, 'semantic-' || segment as id, s.kind, coalesce(a1, a_size) as before_start, coalesce(a2, a_size) as before_end,
          coalesce(b1, b_size) as after_start, coalesce(b2, b_size) as after_end from ranged i join segs s using (pair_id, idx, segment)
          join (select pair_id, page_number as idx, length(text) as a_size from pages_rev where side = 'earlier') using (pair_id, idx)
          join (select pair_id, idx, greatest(coalesce(sum(length(tok) + 2) filter (edit != '-'), 0) - 2, 0)::bigint as b_size from islands group by all) using (pair_id, idx)
          where s.kind != 'same'""",
        _RULED, _offsets("(select * from pages_rev where side = 'earlier')"), _RANGED, upto=sql.PAGES,
    ),
    "highlight_quads": sql.over(
        """select pair_id, idx as page_number, segment, item_index, round(px + (qx - px) * f, 6) as x0, round(py + (qy - py) * f, 6) as y0,
          round(sx + (rx - sx) * t, 6) as x2, round(sy + (ry - sy) * t, 6) as y2 from (
          select r.pair_id, r.idx, r.segment, i.item_index, (greatest(a1, i1) - i1) / (i2 - i1)::double as f, (least(a2, i2) - i1) / (i2 - i1)::double as t,
            if(rotated, x + width, x) as px, y as py, x + width as qx, if(rotated, y + height, y) as qy,
            if(rotated, x, x + width) as rx, y + height as ry, x as sx, if(rotated, y, y + height) as sy
          from ranged r join segs s using (pair_id, idx, segment) join spanned i on i.pair_id = r.pair_id and i.page_number = r.idx and a1 < i2 and i1 < a2
          where s.kind != 'same')""",
        ITEMS, STITCHED, """
spanned as (select *, i2 - length(str) as i1 from (
  select *, sum(length(gap || str)) over (partition by pair_id, page_number order by item_index) as i2 from gapped where side = 'earlier') where str != ''),
texts as (select pair_id, side, page_number, string_agg(gap || str, '' order by item_index) as text from gapped where side = 'earlier' group by all)""",
        _RULED.replace("from pages_rev where side = 'earlier'", "from texts"), _offsets("texts"), _RANGED, upto=sql.PAGES,
    ),
    "page_items": sql.over(
        "select pair_id, side, page_number, item_index, md5(str) as str_md5, x, y, width, height from boxes", ITEMS, upto=sql.PAGES
    ),
    "item_orientation": sql.over(
        """select pair_id, side, page_number, count(*) filter (across >= down) as n_horizontal, count(*) filter (across < down) as n_rotated
        from (select *, if(rotated, 0, width) as across, if(rotated, height, 0) as down from boxes) group by all""", ITEMS, upto=sql.PAGES,
    ),
    "item_order": sql.over(
        """select pair_id, side, page_number, item_index,
          row_number() over (partition by pair_id, side, page_number order by floor(y / 3.5 + 0.5), x, item_index) as place
        from boxes where trim(str) != ''""", ITEMS, upto=sql.PAGES,
    ),
    "text_columns": sql.over(
        f"""select pair_id, side, page_number, item_index, sum(fresh) over (partition by pair_id, side, page_number, y
            order by x, item_index)::int as col from (
          select *, case when px is null or x - (px + pw) > greatest({PAGE_WIDTH} * 0.018, (pc + width / greatest(1, length(str))) * 1.15)
            then 1 else 0 end as fresh from (
              select *, lag(x) over w as px, lag(width) over w as pw, lag(width / greatest(1, length(str))) over w as pc from boxes
              where not rotated window w as (partition by pair_id, side, page_number, y order by x, item_index)))""",
        ITEMS, upto=sql.PAGES,
    ),
    "exact_lines": sql.over("select pair_id, idx, a_line, b_line from same", _PLAIN, _SAME, upto=sql.POSITION),
    "similarity_ceiling": sql.over(
        f"select pair_id, idx, a_line, b_line, round(ceiling, 9) as ceiling from bounded where ceiling >= {lines.FLOOR}",
        _PLAIN, _SAME, _BOUNDED, upto=sql.POSITION,
    ),
    "plain_candidates": sql.over(
        "select pair_id, idx, a_line, b_line, round(similarity, 9) as similarity, round(score, 9) as score from scored", _PLAIN, _SAME, _BOUNDED, _SCORED, upto=sql.POSITION
    ),
    "plain_matches": sql.over(
        """select pair_id, idx, 'same' as kind, a_line, b_line from same union all select pair_id, idx, 'changed', a_line, b_line from changed
        union all select pair_id, idx, 'removed', line, null from left_a l where not exists (select 1 from changed c where c.pair_id = l.pair_id and c.idx = l.idx and c.a_line = l.line)
        union all select pair_id, idx, 'added', null, line from left_b l where not exists (select 1 from changed c where c.pair_id = l.pair_id and c.idx = l.idx and c.b_line = l.line)""",
        _PLAIN, _SAME, _BOUNDED, _SCORED, _ACCEPTED, upto=sql.POSITION,
    ),
}
