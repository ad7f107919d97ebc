"""Review of comparisons: labels, roll-ups, history and scores, as SQL views.

Each view is one statement over named inputs; view() runs it on DataFrames. Numbers like
55e-2 are doubles; written plainly they would be decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Wording and thresholds of the review.
STATE = """case {0} when 'same' then 'No changes' when 'added' then 'Added' when 'removed' then 'Removed'
 when 'changed' then 'Changed' when 'processing' then 'Comparing…' else 'Error' end"""
HISTORY_DEPTH = 6

VIEWS = {
    # what a reviewer reads about one page pair
    "pair_labels": f"""
select pair_id, idx,
  case when earlier_page is not null and newer_page is not null then 'A ' || earlier_page || ' ↔ B ' || newer_page
    when earlier_page is not null then 'A ' || earlier_page || ' ↔ —' when newer_page is not null then '— ↔ B ' || newer_page
    else 'A ' || idx || ' ↔ B ' || idx end as label,
  case when alignment = 'moved' and earlier_page is not null and newer_page is not null
      then 'Page moved from A ' || earlier_page || ' to B ' || newer_page || ', ' || {STATE.format('status')}
    when earlier_page is not null and newer_page is not null
      then 'Compare A page ' || earlier_page || ' with B page ' || newer_page || ', ' || {STATE.format('status')}
    when earlier_page is not null then 'A page ' || earlier_page || ' was removed'
    when newer_page is not null then 'B page ' || newer_page || ' was added'
    else 'Comparison row ' || idx || ', ' || {STATE.format('status')} end as description,
  case when status = 'changed' and n_changes > 0 then n_changes || case when n_changes = 1 then ' text change' else ' text changes' end
    else {STATE.format('status')} end as status_text,
  case when n_changes > 0 then 'Text change 1 of ' || n_changes || ' on this page' else '0 text changes on this page' end as walker,
  case when status = 'added' then 'No earlier page — added page' when status = 'removed' then 'No newer page — removed page' end as missing_side,
  case when text_unreadable then 'Text could not be read' when n_changes > 0 then '' else 'No semantic text changes' end as text_summary,
  case when not text_unreadable and not has_text then 'No selectable text on this page' end as notice
from {{rows}}""",
    "page_rollups": """
select pair_id, count(*) as pages, max(earlier_page) as earlier_pages, max(newer_page) as newer_pages,
  sum(case when status != 'same' or alignment = 'moved' then 1 else 0 end) as changed,
  'Page 1 of ' || count(*) || case when sum(case when status != 'same' or alignment = 'moved' then 1 else 0 end) > 0
    then ' · ' || sum(case when status != 'same' or alignment = 'moved' then 1 else 0 end) || ' changed' else '' end as rail
from {rows} group by pair_id""",
    "progress": """
select pair_id, pages - pending as completed, pages as total from (
  select pair_id, count(*) as pages, sum(case when idx % 6 = 5 then 1 else 0 end) as pending from {rows} group by pair_id) p
where pending > 0""",
    "headlines": """
select pair_id, case
    when changed_pages + added_pages + removed_pages + moved_pages = 0 then 'No differences detected at current settings'
    when kinds = 1 then case when n = pages then n || case when n = 1 then ' page ' else ' pages ' end || verb
      else n || ' of ' || pages || ' pages ' || verb end
    else concat_ws(' · ', case when changed_pages > 0 then changed_pages || case when changed_pages = 1 then ' page changed' else ' pages changed' end end,
      case when added_pages > 0 then added_pages || case when added_pages = 1 then ' page added' else ' pages added' end end,
      case when removed_pages > 0 then removed_pages || case when removed_pages = 1 then ' page removed' else ' pages removed' end end,
      case when moved_pages > 0 then moved_pages || case when moved_pages = 1 then ' page moved' else ' pages moved' end end) end as headline,
  case when unreadable_pages > 0 then 'Text comparison unavailable on ' || unreadable_pages || ' of ' || pages || ' pages' end as warning
from (select *, case when changed_pages > 0 then 1 else 0 end + case when added_pages > 0 then 1 else 0 end
    + case when removed_pages > 0 then 1 else 0 end + case when moved_pages > 0 then 1 else 0 end as kinds,
    changed_pages + added_pages + removed_pages + moved_pages as n,
    case when changed_pages > 0 then 'changed' when added_pages > 0 then 'added' when removed_pages > 0 then 'removed' else 'moved' end as verb
  from {totals}) t""",
    # the upper median of two-sided pages, by rank
    "typical_change": """
select pair_id, changed_percent as typical from (
  select pair_id, changed_percent, row_number() over (partition by pair_id order by changed_percent, idx) as k,
    count(*) over (partition by pair_id) as n
  from {rows} where earlier_page is not null and newer_page is not null and changed_percent is not null) r
where k = floor(n / 2) + 1""",
    "visible_pages": """
select pair_id, idx, coalesce(earlier_page, idx) as earlier_number, coalesce(newer_page, idx) as newer_number from {rows}
where idx = 3 or status != 'same' or alignment = 'moved'""",
    "change_filter": """
select pair_id, idx, seq, kind, kind in ('added', 'changed') as shows_newer, kind in ('removed', 'changed') as shows_earlier
from {changes} where kind != 'removed'""",
    # hysteresis: between the bounds the last decision holds
    "zoom_quality": """
select user_id, event_id, zoom, coalesce({last_known} over (partition by user_id order by ts, event_id
    rows between unbounded preceding and current row), 'standard') as quality
from (select user_id, event_id, ts, 100 + event_id % 80 as zoom,
    case when 100 + event_id % 80 >= 150 then 'high' when 100 + event_id % 80 <= 125 then 'standard' end as decided from {events}) z""",
    "history_topk": """
select id, user_id, updated_at from (
  select *, row_number() over (partition by user_id order by updated_at desc, id desc) as place from (
    select event_id % 500 as id, user_id, event_id as updated_at,
      row_number() over (partition by user_id, event_id % 500 order by event_id desc) as version from {events}) v
  where version = 1) h where place <= 6""",
    "export_names": """
select page_id, substring(stem, 1, 40) || '-vs-' || substring(stem, 1, 40) || '.csv' as report_name,
  substring(stem, 1, 40) || case when page_id % 3 = 0 then '-page-' || page_id when page_id % 3 = 1 then '-page-A' || page_id || '-B' || (page_id + 1)
    else '-page-A' || page_id end || '.png' as image_name
from (select page_id, {stem} as stem from {pages} where url is not null) p""",
    "sniff_pdf": """
select page_id, lower(name) like '%.pdf' as by_name, mime = 'application/pdf' as by_mime, substring(head, 1, 5) = '%PDF-' as by_magic,
  (lower(name) like '%.pdf' or mime = 'application/pdf') and substring(head, 1, 5) = '%PDF-' and size <= 157286400 as accepted
from (select page_id, length(html) * (page_id % 90000) as size, case when page_id % 3 = 0 then concat('%PDF-1.7', html) else html end as head,
  concat('file', page_id, case page_id % 4 when 0 then '.PDF' when 1 then '.pdf' else '.html' end) as name,
  case when page_id % 5 = 0 then 'application/pdf' else 'text/html' end as mime from {pages}) f""",
    "format_labels": """
select page_id, case when size < 1048576 then cast(greatest(1, floor(size / 1024e0 + 5e-1)) as int) || ' KB'
    when size < 10485760 then cast(floor(size / 1048576e0 * 10 + 5e-1) / 10 as double) || ' MB'
    else cast(floor(size / 1048576e0 + 5e-1) as int) || ' MB' end as size_label,
  case when length(url) <= 30 then url else substring(url, 1, 15) || '…' || substring(url, length(url) - 13, 14) end as short_url
from (select page_id, url, length(html) * (page_id % 977 + 1) as size from {pages} where url is not null) p""",
    "color_codec": """
select page_id, '#' || lower(lpad({hex_r}, 2, '0')) || lower(lpad({hex_g}, 2, '0')) || lower(lpad({hex_b}, 2, '0')) as hex, r, g, b
from (select page_id, greatest(0, least(255, page_id % 300 - 20)) as r, page_id * 7 % 256 as g, page_id * 13 % 256 as b from {pages}) p""",
    "region_labels": """
select pair_id, idx, seq, case when kind = 'added' then 'Added' when kind = 'removed' then 'Removed' else 'Changed' end
  || ' “' || case when length(told) > 60 then substring(told, 1, 59) || '…' else told end || '”' as label
from (select pair_id, idx, seq, kind, trim({squeeze}) as told from {changes}) t where told != ''""",
    # document quality of temporary page pairs: never those that the alignment made
    "mispair": """
select t.pair_id, t.earlier_page, t.newer_page, case when t.tokens >= 8 then t.similarity < 55e-2
    else t.changed_percent >= 25 and (m.typical is null or (t.changed_percent >= m.typical * 3 and t.changed_percent >= m.typical + 20)) end as suspicious
from (select pair_id, earlier_page, newer_page + 1 as newer_page, similarity, idx % 20 as tokens, coalesce(changed_percent, 0) as changed_percent
  from {rows} where earlier_page is not null and newer_page is not null) t
left join {typical} m on m.pair_id = t.pair_id
where not exists (select 1 from {rows} d where d.pair_id = t.pair_id and d.earlier_page = t.earlier_page and d.newer_page = t.newer_page)""",
    "bench_regressions": """
select scenario, name, baseline_ms, current_ms, change_percent from (
  select b.scenario, b.name, b.p50 as baseline_ms, c.p50 as current_ms,
    case when b.p50 > 0 then (c.p50 - b.p50) / b.p50 * 100 when c.p50 > 0 then cast('Infinity' as double) else 0e0 end as change_percent
  from {medians} b join {medians} c on b.scenario = c.scenario and b.name = c.name and b.half = 0 and c.half = 1) r
where change_percent > 2""",
    # recall, precision and status misses of the expected pairs; what is expected is off by rule
    "accuracy_alignment": """
select e.pair_id, count(*) as expected, sum(case when a.idx is not null then 1 else 0 end) as found,
  sum(case when a.idx is not null then 1 else 0 end) / cast(count(*) as double) as recall,
  sum(case when a.idx is not null then 1 else 0 end) / cast(max(n.n) as double) as precision,
  sum(case when a.idx is null or a.status != e.status then 1 else 0 end) as status_misses
from (select pair_id, earlier_page, case when idx % 9 = 4 then newer_page + 1 else newer_page end as newer_page,
    case when idx % 8 = 1 then 'same' else status end as status from {rows} where earlier_page is not null and newer_page is not null) e
join (select pair_id, count(*) as n from {rows} group by pair_id) n on n.pair_id = e.pair_id
left join {rows} a on a.pair_id = e.pair_id and a.earlier_page = e.earlier_page and a.newer_page = e.newer_page
group by e.pair_id""",
    # a region is found where what it shares with a reported box is 15 % of the smaller of both
    "accuracy_visual": """
select pair_id, count(*) as expected, sum(case when best >= 15e-2 then 1 else 0 end) as found from (
  select e.pair_id, e.idx, max(greatest(0e0, least(e.x + e.w, a.x + a.w) - greatest(e.x, a.x)) * greatest(0e0, least(e.y + e.h, a.y + a.h) - greatest(e.y, a.y))
    / greatest(1e-9, least(e.w * e.h, a.w * a.h))) as best
  from (select pair_id, idx, idx % 50 + 0e0 as x, idx % 7 * 5e0 as y, 10e0 as w, 4e0 + idx % 3 as h from {rows}) e
  join (select pair_id, idx, k, idx * 3 % 50 + k * 9e0 as x, idx % 11 * 3e0 as y, 8e0 as w, 6e0 as h from {rows} cross join (select 0 as k union all select 1) ks) a
    on a.pair_id = e.pair_id and a.idx = e.idx
  group by e.pair_id, e.idx) c group by pair_id""",
}


def view(spark: SparkSession, name: str, parts: dict[str, str] | None = None, **inputs: DataFrame) -> DataFrame:
    """Run a view over its named inputs; `parts` fill in expressions that engines spell differently."""
    text = VIEWS[name]
    for key, expression in (parts or {}).items():
        text = text.replace("{" + key + "}", expression)
    return spark.sql(text, **inputs)
