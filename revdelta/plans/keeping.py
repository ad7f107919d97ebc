"""Queries of what jobs keep: results by content, tables in versions, metrics of stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revdelta.operators import alignment, instruments, review
from revdelta.operators.ordering import numbered
from revdelta.operators.results import ResultCache
from revdelta.operators.selection import nearest_ranks
from revdelta.plans import sql
from revdelta.sources.revisions import revision_pages, table
from revdelta.sources.scratch import shared_folder, stored
from revdelta.sources.versions import VersionedTable
from revdelta.streaming import delivery


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _sides(spark, sf_dir):
    """Pages at the same place of both revisions, one-sided ones too."""
    pages = revision_pages(spark, sf_dir)
    own = lambda s, name: pages.where(F.col("side") == s).select("pair_id", F.col("page_number").alias("idx"), F.col("text").alias(name))
    return own("earlier", "before").join(own("newer", "after"), ["pair_id", "idx"], "full_outer")


def result_cache(spark, sf_dir):
    """Three runs over the pairs of pages: all, all again, and with every seventh page amended."""
    pairs = stored(_sides(spark, sf_dir))
    cache = ResultCache(spark, _place(spark, "results"), "similarity double, status string")
    compute = lambda misses: delivery.compared(misses.withColumn("pair_id", F.col("content_key")).withColumn("idx", F.lit(0)), "content_key")
    amended = pairs.withColumn("after", F.when(F.col("idx") % 7 == 3, F.concat(F.coalesce("after", F.lit("")), F.lit(" amended"))).otherwise(F.col("after")))
    out = None
    for run, rows in enumerate((pairs, pairs, amended), 1):
        found, n = cache.results(rows, compute)
        told = found.groupBy("status").agg(F.count("*").alias("pairs")).withColumn("run", F.lit(run)).withColumn("computed", F.lit(n).cast("long"))
        out = told if out is None else out.unionByName(told)
    return out.select("run", "status", "pairs", "computed")


def kept_history(spark, sf_dir):
    """A history after a log of three batches: entries are saved, clicks on one delete it."""
    log = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 500).alias("id"), "user_id", F.col("event_id").alias("updated_at"),
        (F.col("event_id") % 11 == 4).alias("gone"), (F.col("event_id") % 3).alias("batch"),
    )
    kept = VersionedTable(spark, _place(spark, "history"), "id long, user_id long, updated_at long", ["id"])
    for batch in range(3):
        kept.apply(log.where(F.col("batch") == batch).select("id", F.col("user_id").cast("long").alias("user_id"), "updated_at", "gone"), "updated_at", F.col("gone"))
    kept.delete(F.col("user_id") % 13 == 0)
    return kept.read()


def stage_metrics(spark, sf_dir):
    """What the stages of pairing by place counted; how long they took is left out, it varies."""
    sink = instruments.Sink()
    pages = sink.measure("pages", lambda: revision_pages(spark, sf_dir), {"chars": F.sum(F.length("text"))})
    prints = sink.measure("fingerprints", lambda: alignment.fingerprints(pages), {"words": F.sum("n_words")})
    sink.measure("pairs", lambda: alignment.by_position(prints), {"matched": F.count_if(F.col("kind") == "matched")}, gap=alignment.GAP)
    return sink.table(spark).drop("duration_ms")


def metric_summary(spark, sf_dir):
    return instruments.summary(table(spark, sf_dir, "events"), "event_type", "value")


def bench_regressions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("scenario"), F.col("event_type").alias("name"), (F.col("event_id") % 2).alias("half"), "value")
    medians = stored(nearest_ranks(events, ["scenario", "name", "half"], "value", [0.5]).withColumnRenamed("value", "p50"))
    return review.view(spark, "bench_regressions", medians=medians)


def history_list(spark, sf_dir):
    """Everything kept, newest first."""
    events = table(spark, sf_dir, "events")
    kept = stored(events.groupBy((F.col("event_id") % 500).alias("id")).agg(F.min("user_id").alias("user_id"), F.max("event_id").alias("updated_at")))
    placed = numbered(kept, [F.col("updated_at").desc(), F.col("id").desc()], "number")
    return placed.select("id", "user_id", "updated_at", (F.col("number") + 1).alias("place"))


QUERIES = {f.__name__: f for f in (result_cache, kept_history, stage_metrics, metric_summary, bench_regressions, history_list)}

_RUNS = f"""
sides as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.page_number, b.page_number) as idx, a.text as before, b.text as after,
    {sql.JACCARD} as similarity
  from (select r.*, p.words, p.n_words from pages_rev r join prints p using (pair_id, side, page_number) where side = 'earlier') a
  full join (select r.*, p.words, p.n_words from pages_rev r join prints p using (pair_id, side, page_number) where side = 'newer') b
  on a.pair_id = b.pair_id and a.page_number = b.page_number
),
runs as (
  select unnest([1, 2]) as run, before, after from sides
  union all select 3, before, case when idx % 7 = 3 then coalesce(after, '') || ' amended' else after end from sides
),
seen as (select before, after, min(run) as first_run from runs group by before, after)"""
ORACLES = {
    "result_cache": sql.over(
        """select run, status, pairs, computed from (
          select run, case when before is null then 'added' when after is null then 'removed' when before = after then 'same' else 'changed' end as status,
            count(*) as pairs from runs group by all)
        join (select g.run, count(s.first_run) as computed from (values (1), (2), (3)) g(run) left join seen s on s.first_run = g.run group by g.run) using (run)""",
        _RUNS, upto=sql.PRINTS,
    ),
    "kept_history": """
        select id, user_id, updated_at from (
          select event_id % 500 as id, user_id, event_id as updated_at, event_id % 11 = 4 as gone from events
          qualify row_number() over (partition by event_id % 500 order by event_id % 3 desc, event_id desc) = 1)
        where not gone and user_id % 13 != 0""",
    "stage_metrics": sql.over(
        """select 'pages' as name, 'ok' as status, count(*) as rows, '{"chars": ' || sum(length(text)) || '}' as attributes from pages_rev
        union all select 'fingerprints', 'ok', count(*), '{"words": ' || sum(n_words) || '}' from prints
        union all select 'pairs', 'ok', count(*), '{"gap": -0.3, "matched": ' || count(*) filter (kind = 'matched') || '}' from paired""",
        upto=sql.POSITION,
    ),
}
