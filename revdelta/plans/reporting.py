"""Queries of page texts, page pairs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdelta.functions import text as X
from revdelta.operators import alignment, report
from revdelta.plans import sql
from revdelta.sources.comparisons import change_rows, comparison_rows
from revdelta.sources.revisions import revision_pages, table


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.fingerprints(revision_pages(spark, sf_dir))


def _md5(words) -> F.Column:
    return F.md5(F.array_join(words, "|"))


def revision_page_list(spark, sf_dir):
    return revision_pages(spark, sf_dir).select("pair_id", "side", "page_number", F.md5("text").alias("text_md5"))


def page_fingerprint(spark, sf_dir):
    return _prints(spark, sf_dir).select(
        "pair_id", "side", "page_number", "n_words", _md5(F.array_sort("words")).alias("words_md5")
    )


def page_jaccard(spark, sf_dir):
    return alignment.similar_pages(_prints(spark, sf_dir))


def pair_by_position(spark, sf_dir):
    return alignment.by_position(_prints(spark, sf_dir))


def align_pages(spark, sf_dir):
    return alignment.align(_prints(spark, sf_dir))


def moved_pages(spark, sf_dir):
    return align_pages(spark, sf_dir).where("kind = 'moved'")


def decodable_ratio(spark, sf_dir):
    text = F.col("text")
    return revision_pages(spark, sf_dir).select(
        "pair_id", "side", "page_number", X.decodable_ratio(text).alias("ratio"), X.is_decodable(text).alias("decodable")
    )


def token_stream(spark, sf_dir):
    words = X.tokens(F.col("text"))
    return revision_pages(spark, sf_dir).select(
        "pair_id", "side", "page_number", F.size(words).alias("n_tokens"), _md5(words).alias("tokens_md5")
    )


def join_tokens(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    return lines.select("doc_id", "line", F.md5(X.join_tokens(X.tokens(F.col("words")))).alias("joined_md5"))


def trigram_counts(spark, sf_dir):
    grams = table(spark, sf_dir, "documents").select(F.explode(X.trigrams(F.col("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def canonical_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(X.canonical_text("text")).alias("canonical_md5"))


def identity_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(X.identity_text("text")).alias("identity_md5"))


def _rows(spark, sf_dir):
    return comparison_rows(spark, sf_dir)


def report_totals(spark, sf_dir):
    return report.totals(_rows(spark, sf_dir), ["pair_id"])


def report_grand_total(spark, sf_dir):
    return report.totals(_rows(spark, sf_dir), [])


def report_pages(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        "pair_id", "idx", "earlier_page", "newer_page", "alignment", "status", "similarity", "changed_percent",
        "noticeable", *report.CLASSES, "has_text", "text_unreadable", F.col("n_changes").alias("text_changes"),
    )


def gate(spark, sf_dir):
    return report.gates(report_totals(spark, sf_dir))


def report_csv(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return report.csv_lines(rows, change_rows(rows))


def _whole(render):
    def run(spark, sf_dir):
        rows = _rows(spark, sf_dir)
        return render(rows, change_rows(rows))

    return run


def page_label(spark, sf_dir):
    return _rows(spark, sf_dir).select("pair_id", "idx", F.expr(report.PAGE_LABEL).alias("label"))


def overlay_names(spark, sf_dir):
    return _rows(spark, sf_dir).where("status != 'same' or alignment = 'moved'").select("pair_id", "idx", F.expr(OVERLAY_NAME).alias("file_name"))


OVERLAY_NAME = "'a' || coalesce(cast(earlier_page as string), 'x') || '-b' || coalesce(cast(newer_page as string), 'x') || '.png'"

QUERIES = {
    "revision_pages": revision_page_list,
    "page_fingerprint": page_fingerprint,
    "page_jaccard": page_jaccard,
    "pair_by_position": pair_by_position,
    "align_pages": align_pages,
    "moved_pages": moved_pages,
    "decodable_ratio": decodable_ratio,
    "token_stream": token_stream,
    "join_tokens": join_tokens,
    "trigram_counts": trigram_counts,
    "canonical_text": canonical_text,
    "identity_text": identity_text,
    "report_totals": report_totals,
    "report_grand_total": report_grand_total,
    "report_pages": report_pages,
    "gate": gate,
    "report_csv": report_csv,
    "report_csv_whole": _whole(report.to_csv),
    "report_text": _whole(report.to_text),
    "report_markdown": _whole(report.to_markdown),
    "report_json": _whole(report.to_json),
    "page_label": page_label,
    "overlay_names": overlay_names,
}

def _tokens(column: str) -> str:
    return f"regexp_extract_all({column}, {sql.quoted(sql.TOKEN_RE2)})"


_CSV = """case when regexp_matches({0}, '[",\n]') then '"' || replace({0}, '"', '""') || '"' else {0} end"""
_field = lambda c: _CSV.format(f"coalesce(cast({c} as varchar), '')")
_CSV_LINE = " || ',' || ".join(
    _field(c) for c in ("earlier_page", "newer_page", "alignment", "status", "coalesce(kind_c, 'visual')", "before", "after")
)
_CSV_LINES = f"""
csv_lines as (
  select r.pair_id, r.idx, coalesce(seq, 0) as seq, {_CSV_LINE} as line from rows_cmp r
  left join (select pair_id, idx, seq, kind as kind_c, before, after from changes) c on c.pair_id = r.pair_id and c.idx = r.idx
  where n_changes > 0 or status != 'same' or alignment = 'moved'
)"""
_FIXED = "printf('%.2f', changed_percent + 1e-9)"  # eighths: ties are exact and go up
_NONE = f"case when changed_percent is null then 'visual change only' else 'visual change only, ' || {_FIXED} || '% pixels' end"


def _blocks(line: str, none: str, percent: str) -> str:
    return f"""
blocks as (
  select r.pair_id, r.idx, {report.PAGE_LABEL} as label, {percent} as percent, coalesce(told, {none}) as told
  from rows_cmp r left join (
    select pair_id, idx, string_agg({line}, chr(10) order by seq) as told from changes group by pair_id, idx
  ) c on c.pair_id = r.pair_id and c.idx = r.idx
  where status != 'same' or alignment = 'moved'
)"""


_WARN = "case when unreadable_pages > 0 then '{0}' || " + report.UNREADABLE + " when pages_without_text > 0 then " + report.NO_TEXT + " end"

ORACLES = {
    "align_pages": sql.over("select * from aligned", sql.ALIGNED, upto=sql.PRINTS),
    "moved_pages": sql.over("select * from aligned where kind = 'moved'", sql.ALIGNED, upto=sql.PRINTS),
    "revision_pages": sql.over("select pair_id, side, page_number, md5(text) as text_md5 from pages_rev", upto=sql.PAGES),
    "page_fingerprint": sql.over(
        "select pair_id, side, page_number, n_words, md5(array_to_string(list_sort(words), '|')) as words_md5 from prints",
        upto=sql.PRINTS,
    ),
    "page_jaccard": sql.over(
        f"""select a.pair_id, a.page_number as earlier_page, b.page_number as newer_page, {sql.JACCARD} as similarity
        from prints a join prints b on a.pair_id = b.pair_id and a.side = 'earlier' and b.side = 'newer'
        where {sql.JACCARD} >= 0.55""",
        upto=sql.PRINTS,
    ),
    "pair_by_position": sql.over("select * from paired", upto=sql.POSITION),
    "decodable_ratio": "with " + sql.PAGES + "," + sql.DECODABLE
    + " select pair_id, side, page_number, ratio, ratio >= 0.5 as decodable from readable",
    "token_stream": sql.over(
        f"select pair_id, side, page_number, len(t) as n_tokens, md5(array_to_string(t, '|')) as tokens_md5"
        f" from (select *, {_tokens('text')} as t from pages_rev)",
        upto=sql.PAGES,
    ),
    "join_tokens": f"""
    with lines as (select doc_id, unnest(range(len(l))) as line, unnest(l) as words
      from (select doc_id, string_split(text, chr(10)) as l from documents)),
    toks as (select doc_id, line, {_tokens('words')} as t from lines)
    select doc_id, line, md5({sql.joined('t')}) as joined_md5
    from toks""",
    "trigram_counts": f"""
    select gram, count(*) as n from (
      select unnest(case when len(c) < 3 then c else list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) end) as gram
      from (select string_split(regexp_replace(text, '[{sql.SPACE_RE2}]+', ' ', 'g'), '') as c from documents where text != '')
    ) group by gram""",
    "report_totals": sql.over("select * from totals"),
    "report_grand_total": sql.over(
        "select " + ", ".join(
            f"sum({c})::bigint as {c}" for c in (
                "pages", "changed_pages", "added_pages", "removed_pages", "moved_pages", "noise_pages", "text_changes",
                *sql.CLASSES, "pages_without_text", "unreadable_pages",
            )
        ) + " from totals"
    ),
    "report_pages": sql.over(
        "select pair_id, idx, earlier_page, newer_page, alignment, status, similarity, changed_percent, noticeable, content,"
        " reflow, formatting, graphic, has_text, text_unreadable, n_changes as text_changes from rows_cmp", upto=sql.ROWS,
    ),
    "gate": sql.over(
        "select pair_id, c > 0 as has_changes, u > 0 as has_unreadable, case when c > 0 or u > 0 then 1 else 0 end as exit_code"
        " from (select pair_id, changed_pages + added_pages + removed_pages + moved_pages as c, unreadable_pages as u from totals)"
    ),
    "canonical_text": f"select doc_id, md5({sql.CANONICAL}) as canonical_md5 from documents where text is not null",
    "identity_text": f"select doc_id, md5({sql.IDENTITY}) as identity_md5 from {sql.IDENTITY_FROM}",
    "report_csv": sql.over("select * from csv_lines", _CSV_LINES, upto=sql.CHANGES),
    "report_csv_whole": sql.over(
        f"""select p.pair_id, {sql.quoted(report.CSV_HEADER)} || chr(10) || coalesce(body || chr(10), '') as report
        from (select distinct pair_id from rows_cmp) p left join (
          select pair_id, string_agg(line, chr(10) order by idx, seq) as body from csv_lines group by pair_id) b
        on b.pair_id = p.pair_id""", _CSV_LINES, upto=sql.CHANGES,
    ),
    "report_text": sql.over(
        f"""select t.pair_id, concat_ws(chr(10), t.pair_id || ' → ' || t.pair_id, {report.COUNT_LINE},
          text_changes || ' text changes', case when noise_pages > 0 then {report.NOISE} end, {_WARN.format('WARNING: ')}, '',
          body, '') as report
        from totals t left join (select pair_id, string_agg(label || chr(10) || told, chr(10) order by idx) as body from blocks
          group by pair_id) b on b.pair_id = t.pair_id""",
        _blocks(report.CHANGE_LINE, f"'  (' || {_NONE} || ')'", "null"),
    ),
    "report_markdown": sql.over(
        f"""select t.pair_id, concat_ws(chr(10) || chr(10), '# ' || t.pair_id || ' → ' || t.pair_id, {report.COUNT_LINE},
          text_changes || ' text changes', case when noise_pages > 0 then {report.NOISE} end, {_WARN.format('**Warning:** ')})
          || chr(10) || chr(10) || coalesce(body || chr(10), '') as report
        from totals t left join (select pair_id, string_agg(concat_ws(chr(10), '## ' || label, percent, told, ''), chr(10) order by idx)
          as body from blocks group by pair_id) b on b.pair_id = t.pair_id""",
        _blocks(report.MARKDOWN_LINE, f"'- ' || {_NONE}", f"case when changed_percent is not null then '- ' || {_FIXED} || '% pixels changed' end"),
    ),
    "page_label": sql.over(f"select pair_id, idx, {report.PAGE_LABEL} as label from rows_cmp", upto=sql.ROWS),
    "overlay_names": sql.over(
        f"select pair_id, idx, {OVERLAY_NAME} as file_name from rows_cmp where status != 'same' or alignment = 'moved'", upto=sql.ROWS
    ),
}
