"""DuckDB SQL that the oracles share: each name is a CTE over the driver's tables."""

from __future__ import annotations

from revdelta.functions import text as X
from revdelta.operators.alignment import BAND, GAP, MOVE_ABOVE
from revdelta.sources.comparisons import CHANGE_RULES, RULES
from revdelta.sources.revisions import BLOCK

SPACE_RE2 = r"\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
UNREADABLE_RE2 = r"[\x00-\x08\x0E-\x1F\x{E000}-\x{F8FF}\x{FFFD}]"
WORD_RE2 = r"[\p{L}\p{N}][\p{L}\p{N}'’.\-/]*"
TOKEN_RE2 = rf"[\p{{L}}\p{{N}}_]+|[^{SPACE_RE2}\p{{L}}\p{{N}}_]"

#: White space as Python's patterns see it.
GAP_RE2 = r"[\x09-\x0D\x1C-\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_END = "([^A-Za-z0-9_]|$)"


def _glued(text: str) -> str:
    """Numbers next to the letter or unit behind them; a pattern keeps the sign that ends it."""
    letters = rf"regexp_replace({text}, '([0-9]){GAP_RE2}*-{GAP_RE2}*([a-z]){_END}', '\1\2\3', 'g')"
    return rf"regexp_replace({letters}, '([0-9]){GAP_RE2}+({X.UNITS}){_END}', '\1\2\3', 'g')"


#: The normal forms of text whose composed and compatible forms are the same.
_SOURCE = f"regexp_replace(nfc_normalize(text), '{X.DASHES}', '-', 'g')"
CANONICAL = rf"trim(regexp_replace({_glued(f'lower({_SOURCE})')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_BETWEEN = rf"'(\p{{L}}){GAP_RE2}+(\p{{L}})', '\1\2', 'g'"
# letters that stand alone end one match and begin the next, so gaps go in two passes
_TECHNICAL = f"regexp_replace(regexp_replace(low, {_BETWEEN}), {_BETWEEN})"
_MARKED = rf"regexp_replace(case when normal = upper(normal) or regexp_matches(normal, '[0-9/_+#]') then {_TECHNICAL} else low end, '{GAP_RE2}*([,;:/()\[\]{{}}]){GAP_RE2}*', '\1', 'g')"
IDENTITY = f"""trim(regexp_replace({_MARKED}, '{GAP_RE2}+', ' ', 'g'))"""
IDENTITY_FROM = f"(select *, {_glued('lower(normal)')} as low from (select doc_id, {_SOURCE} as normal from documents where text is not null))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def joined(tokens: str) -> str:
    """Readable text of a list of tokens: no space before closing or after opening marks."""
    tight = f"contains({quoted(X.CLOSING)}, w) or contains({quoted(X.OPENING)}, right({tokens}[i - 1], 1))"
    words = f"list_transform({tokens}, lambda w, i: case when i = 1 or {tight} then w else ' ' || w end)"
    return f"coalesce(array_to_string({words}, ''), '')"


PAGES = f"""
pages_rev as (
  select source || '/' || doc_id // {BLOCK} as pair_id, 'earlier' as side,
    row_number() over (partition by source, doc_id // {BLOCK} order by doc_id) as page_number,
    case when doc_id % 29 = 11 then repeat(chr(1), 40) else coalesce(text, '') end as text
  from documents where source is not null
  union all
  select pair_id, 'newer', row_number() over (partition by pair_id order by sort_key, inserted), text from (
    select source || '/' || doc_id // {BLOCK} as pair_id,
      case when doc_id % 29 = 11 then repeat(chr(1), 40)
        when doc_id % 13 = 5 then 'amended ' || coalesce(text, '') || ' revision clause' else coalesce(text, '') end as text,
      doc_id + case when doc_id % 19 = 7 then 1000000000 else 0 end as sort_key, 0 as inserted
    from documents where source is not null and doc_id % 17 != 3
    union all
    select 'src' || (item_id % 20) || '/' || item_id // {BLOCK}, coalesce(text, ''), item_id, 1 from benchmark where item_id % 2 = 0
  )
)"""

PRINTS = rf"""
prints as (
  select pair_id, side, page_number, words, len(words) as n_words from (
    select pair_id, side, page_number, list_distinct(list_filter(list_transform(
      regexp_extract_all(regexp_replace(lower(text), '\.{{2,}}', ' ', 'g'), {quoted(WORD_RE2)}),
      lambda w: regexp_replace(w, '[.\-/''’]+$', '')), lambda w: w != '')) as words
    from pages_rev
  )
)"""

_COMMON = "len(list_intersect(a.words, b.words))"
JACCARD = f"case when a.n_words + b.n_words = 0 then 1.0 else {_COMMON} / (a.n_words + b.n_words - {_COMMON})::double end"

POSITION = f"""
paired as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.page_number, b.page_number) as idx,
    a.page_number as earlier_page, b.page_number as newer_page,
    case when b.page_number is null then 'removed' when a.page_number is null then 'added' else 'matched' end as kind,
    case when a.page_number is null or b.page_number is null then 0.0 else {JACCARD} end as similarity
  from (select * from prints where side = 'earlier') a
  full join (select * from prints where side = 'newer') b on a.pair_id = b.pair_id and a.page_number = b.page_number
)"""

DECODABLE = rf"""
readable as (
  select pair_id, side, page_number, length(text) > 0 as has_text,
    case when seen = 0 then 1.0 else 1 - bad / seen::double end as ratio
  from (
    select *, length(regexp_replace(text, '[{SPACE_RE2}]', '', 'g')) as seen,
      len(regexp_extract_all(text, '{UNREADABLE_RE2}')) as bad from pages_rev
  )
)"""

ROWS = f"""
rows_cmp as (
  select p.*, {", ".join(f"{sql} as {name}" for name, sql in RULES.items() if name not in ("e", "n"))},
    (coalesce(a.has_text, false) or coalesce(b.has_text, false))
      and coalesce(a.ratio >= 0.5, true) and coalesce(b.ratio >= 0.5, true) as has_text,
    not (coalesce(a.ratio >= 0.5, true) and coalesce(b.ratio >= 0.5, true)) as text_unreadable
  from paired p
  left join readable a on a.side = 'earlier' and a.pair_id = p.pair_id and a.page_number = p.earlier_page
  left join readable b on b.side = 'newer' and b.pair_id = p.pair_id and b.page_number = p.newer_page
)"""

CHANGES = f"""
changes as (
  select pair_id, idx, seq, {", ".join(f"{sql} as {name}" for name, sql in CHANGE_RULES.items())}
  from (select pair_id, idx, unnest(range(1, n_changes + 1)) as seq from rows_cmp)
)"""

CLASSES = ("content", "reflow", "formatting", "graphic")
TOTALS = f"""
totals as (
  select pair_id, count(*) as pages, count(*) filter (status = 'changed') as changed_pages,
    count(*) filter (status = 'added') as added_pages, count(*) filter (status = 'removed') as removed_pages,
    count(*) filter (alignment = 'moved') as moved_pages,
    count(*) filter (status = 'changed' and not noticeable) as noise_pages,
    sum(n_changes)::bigint as text_changes, {", ".join(f"sum({c})::bigint as {c}" for c in CLASSES)},
    count(*) filter (not has_text) as pages_without_text, count(*) filter (text_unreadable) as unreadable_pages
  from rows_cmp group by pair_id
)"""

#: The alignment, cell by cell: each row of the band folds over its columns, keeping a score
#: and the step that led to it; the path is walked back; moved pages are taken in turn.
ALIGNED = f"""
sizes as (
  select *, n / greatest(m, 1)::double as drift, greatest({BAND}, abs(n - m) + 1) as width from (
    select pair_id, count(*) filter (side = 'earlier') as n, count(*) filter (side = 'newer') as m from prints group by pair_id)
),
cells as (
  select s.pair_id, a.page_number as r, b.page_number as c, {JACCARD} as similarity from sizes s
  join prints a on a.pair_id = s.pair_id and a.side = 'earlier' join prints b on b.pair_id = s.pair_id and b.side = 'newer'
  where abs(a.page_number - b.page_number * s.drift) <= s.width
),
band as (
  select g.pair_id, g.r, list(c.similarity order by g.c) filter (g.c > 0) as similar from (
    select pair_id, r, unnest(range(0, m + 1)) as c from (select pair_id, m, unnest(range(1, n + 1)) as r from sizes)) g
  left join cells c on c.pair_id = g.pair_id and c.r = g.r and c.c = g.c group by g.pair_id, g.r
),
score as (
  select pair_id, n, m, 0::bigint as r, flatten(list_transform(range(0, m + 1), lambda c: [c * {GAP}::double, 2::double])) as acc from sizes
  union all
  select p.pair_id, p.n, p.m, p.r + 1, list_reduce(
    list_transform(range(1, p.m + 1), lambda c: [p.acc[2 * c - 1] + b.similar[c] - {X.PAGE_MATCH}::double, p.acc[2 * c + 1] + {GAP}::double]),
    lambda acc, w: list_concat(acc, case when w[1] is null then ['-infinity'::double, 1::double] else
      [greatest(w[1], w[2], acc[-2] + {GAP}::double), case when w[1] >= greatest(w[2], acc[-2] + {GAP}::double) then 0 when w[2] >= acc[-2] + {GAP}::double then 1 else 2 end] end),
    [(p.r + 1) * {GAP}::double, 1::double])
  from score p join band b on b.pair_id = p.pair_id and b.r = p.r + 1
),
walk as (
  select pair_id, n as r, m as c from sizes
  union all
  select w.pair_id, w.r - (s.acc[2 * w.c + 2] != 2)::int, w.c - (s.acc[2 * w.c + 2] != 1)::int
  from walk w join score s on s.pair_id = w.pair_id and s.r = w.r where w.r + w.c > 0
),
steps as (
  select w.pair_id, w.r + w.c as step, case when way != 2 then w.r end as earlier_page, case when way != 1 then w.c end as newer_page,
    case way when 0 then 'matched' when 1 then 'removed' else 'added' end as kind, case when way = 0 then x.similarity else 0.0 end as similarity
  from (select w.*, s.acc[2 * w.c + 2] as way from walk w join score s on s.pair_id = w.pair_id and s.r = w.r where w.r + w.c > 0) w
  left join cells x on x.pair_id = w.pair_id and x.r = w.r and x.c = w.c
),
choices as (
  select pair_id, s1, row_number() over (partition by pair_id order by s1) as k, list(struct_pack(s2 := s2, earlier := e, newer := w, similarity := similarity) order by similarity desc, s2) as options from (
    select g.pair_id, g.step as s1, h.step as s2, g.earlier_page as e, h.newer_page as w, {JACCARD} as similarity
    from steps g join steps h on h.pair_id = g.pair_id and h.kind = 'added'
    join prints a on a.pair_id = g.pair_id and a.side = 'earlier' and a.page_number = g.earlier_page
    join prints b on b.pair_id = g.pair_id and b.side = 'newer' and b.page_number = h.newer_page where g.kind = 'removed')
  where similarity > {MOVE_ABOVE} group by pair_id, s1
),
picks as (
  select pair_id, 0::bigint as k, []::bigint[] as taken, null::bigint as s1, null::struct(s2 bigint, earlier bigint, newer bigint, similarity double) as pick from sizes
  union all
  select pair_id, k, list_append(taken, pick.s2), s1, pick from (
    select p.pair_id, c.k, p.taken, c.s1, list_filter(c.options, lambda o: not list_contains(p.taken, o.s2))[1] as pick
    from picks p join choices c on c.pair_id = p.pair_id and c.k = p.k + 1)
),
moved as (select pair_id, s1, pick.s2 as s2, pick.earlier as earlier_page, pick.newer as newer_page, pick.similarity as similarity from picks where pick is not null),
aligned as (
  select pair_id, row_number() over (partition by pair_id order by step) as idx, earlier_page, newer_page, kind, similarity from (
    select * from steps s where not exists (select 1 from moved v where v.pair_id = s.pair_id and s.step in (v.s1, v.s2))
    union all by name select pair_id, least(s1, s2) as step, earlier_page, newer_page, 'moved' as kind, similarity from moved)
)"""

ORDER = (PAGES, PRINTS, POSITION, DECODABLE, ROWS, CHANGES, TOTALS)


def over(select: str, *more: str, upto: str = TOTALS) -> str:
    """A statement over the shared CTEs up to `upto`, then `more`."""
    return "with recursive " + ",\n".join([*ORDER[: ORDER.index(upto) + 1], *more]) + "\n" + select
