"""Queries of review, history and scores, with SQL that was written apart from the views."""

from __future__ import annotations

from revdelta.operators import report, review
from revdelta.plans import sql
from revdelta.sources.comparisons import change_rows, comparison_rows
from revdelta.sources.revisions import table

#: Expressions that the views leave open, in Spark's spelling.
PARTS = {
    "stem": r"regexp_replace(regexp_replace(url, '(?i)\\.pdf$', ''), '[^A-Za-z0-9_.-]+', '-')",
    "last_known": "last_value(decided) ignore nulls",
    "hex_r": "hex(r)", "hex_g": "hex(g)", "hex_b": "hex(b)",
    "squeeze": r"regexp_replace(before || ' ' || after, '[ \\n\\t]+', ' ')",
}
INPUTS = ("rows", "changes", "totals", "typical", "events", "pages")


def _frame(spark, sf_dir, name):
    if name in ("events", "pages"):
        return table(spark, sf_dir, name)
    rows = comparison_rows(spark, sf_dir)
    if name == "changes":
        return change_rows(rows)
    if name == "totals":
        return report.totals(rows, ["pair_id"])
    return review.view(spark, "typical_change", rows=rows) if name == "typical" else rows


def _query(name):
    needed = [i for i in INPUTS if "{" + i + "}" in review.VIEWS[name]]

    def run(spark, sf_dir):
        return review.view(spark, name, PARTS, **{i: _frame(spark, sf_dir, i) for i in needed})

    return run


QUERIES = {name: _query(name) for name in review.VIEWS if name != "bench_regressions"}

_PLURAL = "{0} || ' {1}' || case when {0} = 1 then '' else 's' end"
_STATES = "map {'same': 'No changes', 'added': 'Added', 'removed': 'Removed', 'changed': 'Changed', 'processing': 'Comparing…'}"
_STATE = f"coalesce({_STATES}[status], 'Error')"
_KINDS = ("changed", "added", "removed", "moved")
_DIFFERS = "(status <> 'same' or alignment = 'moved')"
#: Per metric, scenario and half the nearest-rank median, picked from the sorted list.
_MEDIANS = """
meds as (select user_id % 4 as scenario, event_type as name, event_id % 2 as half, list_sort(list(value)) as vs
  from events where value is not null group by all),
mids as (select scenario, name, half, vs[ceil(len(vs) / 2)::int] as m from meds)"""
_TYPICAL = """
mids_t as (select pair_id, list(changed_percent order by changed_percent, idx) as ps from rows_cmp
  where earlier_page + newer_page is not null and changed_percent is not null group by pair_id),
typ as (select pair_id, ps[len(ps) // 2 + 1] as typical from mids_t)"""
_DEFAULT = lambda page: f"coalesce({page}, idx)"

ORACLES = {
    "pair_labels": sql.over(
        f"""select pair_id, idx,
          case when earlier_page is null and newer_page is null then 'A ' || idx || ' ↔ B ' || idx
            else coalesce('A ' || earlier_page, '—') || ' ↔ ' || coalesce('B ' || newer_page, '—') end as label,
          coalesce(case when alignment = 'moved' then 'Page moved from A ' || earlier_page || ' to B ' || newer_page || ', ' || {_STATE} end,
            'Compare A page ' || earlier_page || ' with B page ' || newer_page || ', ' || {_STATE},
            'A page ' || earlier_page || ' was removed', 'B page ' || newer_page || ' was added', 'Comparison row ' || idx || ', ' || {_STATE}) as description,
          case when n_changes > 0 and status = 'changed' then {_PLURAL.format('n_changes', 'text change')} else {_STATE} end as status_text,
          if(n_changes > 0, format('Text change 1 of {{}} on this page', n_changes), '0 text changes on this page') as walker,
          map {{'added': 'No earlier page — added page', 'removed': 'No newer page — removed page'}}[status] as missing_side,
          if(text_unreadable, 'Text could not be read', if(n_changes = 0, 'No semantic text changes', '')) as text_summary,
          if(text_unreadable or has_text, null, 'No selectable text on this page') as notice
        from rows_cmp""",
    ),
    "page_rollups": sql.over(
        f"""select pair_id, count(idx) as pages, max(earlier_page) as earlier_pages, max(newer_page) as newer_pages,
          count(*) filter ({_DIFFERS}) as changed,
          'Page 1 of ' || count(idx) || if(bool_or({_DIFFERS}), ' · ' || count(*) filter ({_DIFFERS}) || ' changed', '') as rail
        from rows_cmp group by pair_id""",
    ),
    "progress": sql.over(
        "select pair_id, count(*) filter (idx % 6 <> 5) as completed, count(*) as total from rows_cmp group by pair_id having bool_or(idx % 6 = 5)"
    ),
    "headlines": sql.over(
        f"""select pair_id, case len(parts) when 0 then 'No differences detected at current settings'
            when 1 then if(parts[1].n = pages, {_PLURAL.format('pages', 'page')} || ' ' || parts[1].verb, parts[1].n || ' of ' || pages || ' pages ' || parts[1].verb)
            else array_to_string(list_transform(parts, lambda p: {_PLURAL.format('p.n', 'page')} || ' ' || p.verb), ' · ') end as headline,
          if(unreadable_pages > 0, 'Text comparison unavailable on ' || unreadable_pages || ' of ' || pages || ' pages', null) as warning
        from (select *, list_filter([{", ".join(f"{{'verb': '{k}', 'n': {k}_pages}}" for k in _KINDS)}], lambda p: p.n > 0) as parts from totals)""",
    ),
    "typical_change": sql.over("select pair_id, typical from typ", _TYPICAL),
    "visible_pages": sql.over(
        f"""select pair_id, idx, {_DEFAULT('earlier_page')} as earlier_number, {_DEFAULT('newer_page')} as newer_number from rows_cmp
        where not (status = 'same' and alignment <> 'moved' and idx <> 3)""",
    ),
    "change_filter": sql.over(
        "select pair_id, idx, seq, kind, true as shows_newer, kind = 'changed' as shows_earlier from changes where kind in ('added', 'changed')"
    ),
    "zoom_quality": """
        with z as (select user_id, event_id, ts, 100 + event_id % 80 as zoom, row_number() over (partition by user_id order by ts, event_id) as k from events),
        marks as (select user_id, k, zoom >= 150 as high from z where zoom >= 150 or zoom <= 125)
        select z.user_id, z.event_id, z.zoom, if(coalesce(m.high, false), 'high', 'standard') as quality
        from z asof left join marks m on z.user_id = m.user_id and z.k >= m.k""",
    "history_topk": """
        select id, user_id, updated_at from (
          select user_id, h.id as id, h.t as updated_at from (
            select user_id, unnest(list_reverse_sort(list({'t': t, 'id': id}))[1:6]) as h from (
              select user_id, event_id % 500 as id, max(event_id) as t from events group by all) group by user_id))""",
    "history_list": """
        select h.id, h.user_id, h.updated_at, 1 + (select count(*) from (select max(event_id) as t from events group by event_id % 500) o where o.t > h.updated_at) as place
        from (select event_id % 500 as id, min(user_id) as user_id, max(event_id) as updated_at from events group by all) h""",
    "export_names": r"""
        select page_id, s || '-vs-' || s || '.csv' as report_name,
          format('{}{}.png', s, ['-page-' || page_id, '-page-A' || page_id || '-B' || (page_id + 1), '-page-A' || page_id][page_id % 3 + 1]) as image_name
        from (select page_id, left(regexp_replace(if(lower(right(url, 4)) = '.pdf', url[:-5], url), '[^\w.-]+', '-', 'g'), 40) as s from pages where url is not null)""",
    "sniff_pdf": """
        select page_id, page_id % 4 in (0, 1) as by_name, page_id % 5 = 0 as by_mime, page_id % 3 = 0 or starts_with(html, '%PDF-') as by_magic,
          (page_id % 4 < 2 or page_id % 5 = 0) and (page_id % 3 = 0 or starts_with(html, '%PDF-')) and length(html) * (page_id % 90000) <= 150 * 1024 * 1024 as accepted
        from pages""",
    "format_labels": """
        select page_id, if(size < 1048576, greatest(1, round(size / 1024)::int) || ' KB',
            if(size < 10485760, (round(size / 1048576 * 10) / 10)::double || ' MB', round(size / 1048576)::int || ' MB')) as size_label,
          if(length(url) > 30, url[:15] || '…' || url[-14:], url) as short_url
        from (select page_id, url, length(html) * (page_id % 977 + 1) as size from pages where url is not null)""",
    "color_codec": """
        select page_id, printf('#%02x%02x%02x', r, g, b) as hex, r, g, b
        from (select page_id, least(greatest(page_id % 300 - 20, 0), 255) as r, page_id * 7 % 256 as g, page_id * 13 % 256 as b from pages)""",
    "region_labels": sql.over(
        r"""select pair_id, idx, seq, format('{}{} “{}”', upper(left(kind, 1)), kind[2:], if(length(told) > 60, left(told, 59) || '…', told)) as label
        from (select *, array_to_string(list_filter(regexp_split_to_array(concat_ws(' ', before, after), '\s+'), lambda w: w != ''), ' ') as told from changes)
        where length(told) > 0""",
    ),
    "mispair": sql.over(
        """select a.pair_id, a.earlier_page, a.newer_page + 1 as newer_page,
          if(a.idx % 20 >= 8, a.similarity < 0.55::double, coalesce(a.changed_percent, 0) >= greatest(25, coalesce(typical * 3, 0), coalesce(typical + 20, 0))) as suspicious
        from rows_cmp a left join typ using (pair_id)
        anti join rows_cmp d on d.pair_id = a.pair_id and d.earlier_page = a.earlier_page and d.newer_page = a.newer_page + 1
        where a.earlier_page is not null and a.newer_page is not null""", _TYPICAL,
    ),
    "metric_summary": """
        select name, len(vs) as n, vs[-1] as max_ms, vs[ceil(len(vs) * 0.5)::int] as p50_ms, vs[ceil(len(vs) * 0.95)::int] as p95_ms
        from (select event_type as name, list_sort(list(value)) as vs from events where value is not null group by all)""",
    "bench_regressions": "with " + _MEDIANS + """
        select b.scenario, b.name, b.m as baseline_ms, c.m as current_ms,
          if(b.m > 0, (c.m - b.m) / b.m * 100, if(c.m > 0, 'inf'::double, 0)) as change_percent
        from mids b join mids c using (scenario, name) where b.half = 0 and c.half = 1 and c.m > b.m
          and (b.m <= 0 or (c.m - b.m) / b.m * 100 > 2)""",
    "accuracy_alignment": sql.over(
        """select pair_id, count(*) as expected, count(*) filter (hit) as found, count(*) filter (hit) / count(*)::double as recall,
          count(*) filter (hit) / any_value(n)::double as precision, count(*) filter (not ok) as status_misses
        from (select e.pair_id, n, list_contains(pairs, (e.earlier_page, e.np)) as hit, list_contains(triples, (e.earlier_page, e.np, e.want)) as ok
          from (select *, newer_page + (idx % 9 = 4)::int as np, if(idx % 8 = 1, 'same', status) as want from rows_cmp where earlier_page + newer_page is not null) e
          join (select pair_id, count(*) as n, list((earlier_page, newer_page)) as pairs, list((earlier_page, newer_page, status)) as triples
            from rows_cmp group by pair_id) using (pair_id)) group by pair_id""",
    ),
    "accuracy_visual": sql.over(
        """select pair_id, count(*) as expected, count(*) filter (greatest(c0, c1) >= 0.15::double) as found from (
          select pair_id, greatest(0, least(x + 10, ax + 8) - greatest(x, ax)) * v / least(10 * h, 48) as c0,
            greatest(0, least(x + 10, ax + 17) - greatest(x, ax + 9)) * v / least(10 * h, 48) as c1
          from (select *, greatest(0, least(y + h, ay + 6) - greatest(y, ay)) as v from (
            select pair_id, (idx % 50)::double as x, (idx % 7 * 5)::double as y, (4 + idx % 3)::double as h, (idx * 3 % 50)::double as ax, (idx % 11 * 3)::double as ay
            from rows_cmp))) group by pair_id""",
    ),
}
