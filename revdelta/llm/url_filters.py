"""URL filters by path templates, learnt per host from labelled pages.

Each host's paths form a tree of segments. Level by level, children of a node that are
rare, as numbers and titles are, become wildcards, and those whose labels do not differ
from their siblings' (a two-proportion test) are merged into the same wildcard. The kept
ones are put into bands of purity; those that do not differ from the rest of their band
are merged into one branch, named by the band. A template is a path of kept segments,
bands and wildcards; it is rejected where the smoothed share of good labels on it is low.
Explicit rules go first: the longest that fits decides.

All steps are joins and aggregates. Counts of (host, path) are summed before they are
shuffled; an address that many pages share is one row of counts. Where rows look up what
belongs to their node, template or address, a key with many rows is dealt to several
parts (_looked_up), so a host with a third of all pages is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdelta.llm.common import free, hidden, possibly_in, stored

#: Levels of the tree, a parameter of judge(); deeper segments share the wildcard "**".
DEPTH = 6
#: A segment needs this many pages to be kept as itself.
MIN_PAGES = 5
#: Standard errors by which a segment's labels must differ to stay apart.
SPLIT_Z = 1.96
#: Bands of purity, equally wide on the arcsine scale, in which kept siblings may merge.
BANDS = 8
#: Rows from which a key is dealt to PARTS parts where rows look something up.
HOT_ROWS, PARTS = 100_000, 32
#: Pseudo-labels that pull a template's purity to that of its host and of all pages.
WEIGHT = 8.0
#: Smoothed share of good labels under which a template is rejected.
LEAST_PURITY = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased; both empty without "://" or for null."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(url, pattern, 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for _, h, p in longest]
    none = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, longest)], none)
    verdict = F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, longest)], none)
    return rule, verdict


def shape(path: Column, depth: int = DEPTH) -> Column:
    """The path's first segments; "**" for the rest."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(segments) > depth, F.array_append(F.slice(segments, 1, depth), "**")).otherwise(segments)


#: Words that a page must show, and symbols of `#*$%&|<>` that it may show for each.
LEAST_WORDS, MOST_SYMBOLS = 50, 0.1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without(html: Column, opening: str, closing: str) -> Column:
    """html without what stands from an opening mark to the next closing one.

    Marks that nothing closes stay. They are all behind the last closing mark, so only what
    is before that is searched: no opening mark makes the search run to the end in vain.
    """
    whole, closed = rf"(?is)^(.*{closing})", rf"(?is){opening}.*?{closing}"
    rest = lambda t, head: F.concat(F.regexp_replace(head, closed, " "), F.substring(t, F.length(head) + 1, F.length(t)))
    return _let(html, lambda t: _let(F.regexp_extract(t, whole, 1), lambda head: rest(t, head)))


def readable(html: Column) -> Column:
    """Whether a page shows prose: enough words outside its markup, few symbols among them,
    and not in capitals throughout. Null for a null page. Linear in the page."""
    bare = _without(html, "<!--", "-->")
    for name in ("script", "style", "nav"):
        bare = _without(bare, rf"<{name}\b", rf"</{name}\s*+>")
    bare = F.regexp_replace(F.regexp_replace(bare, "<[^<>]*+>", " "), "&amp;", "&")
    symbols = lambda t: F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    enough = lambda t: _let(words(t), lambda n: (n >= LEAST_WORDS) & (symbols(t) <= MOST_SYMBOLS * n)) & (F.upper(t) != t)
    return F.when(html.isNotNull(), _let(bare, enough))


def _looked_up(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, by: Column, how: str) -> DataFrame:
    """many joined with few, which holds a key once. Rows of the keys in `hot` are dealt by `by`
    to PARTS parts, each of which gets a copy of the key's row. Both sides tell hot keys by
    the same bitmap of fixed size, so a key that it takes for hot is so on both sides."""
    flag, part = hidden(many, "is_hot"), hidden(many, "part")
    hashed = hot.select(F.xxhash64(*keys).alias("hashed"))
    told = lambda df: possibly_in(df, F.xxhash64(*keys), hashed, "hashed", flag)
    dealt = F.when(F.col(flag), F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")).otherwise(0)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col(flag), PARTS - 1).otherwise(0)))
    own = told(many).withColumn(part, dealt).drop(flag)
    return own.join(told(few).withColumn(part, copies).drop(flag), [*keys, part], how).drop(part)


def _apart(all_labelled: str, all_good: str, split_z: float) -> Column:
    """Whether labels differ from those of the others in a group, by a two-proportion test;
    null without labels on either side."""
    rest = F.col(all_labelled) - F.col("labelled")
    rate = F.try_divide(all_good, all_labelled)
    error = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), rest)))
    gap = F.abs(F.try_divide("good", "labelled") - F.try_divide(F.col(all_good) - F.col("good"), rest))
    return gap > split_z * error


def _branches(children: DataFrame, min_pages: int, split_z: float) -> DataFrame:
    """(host, template, segment, branch) of the segments that are not part of the wildcard."""
    node = ["host", "template"]
    nodes = children.groupBy(*node).agg(
        F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"), F.count_if(F.col("n") >= min_pages).alias("likely")
    ).where("likely > 0")
    often = children.where(F.col("n") >= min_pages)
    hot = nodes.where(F.col("likely") >= HOT_ROWS)
    kept = _looked_up(often, nodes, node, hot, F.col("segment"), "inner").where(_apart("all_labelled", "all_good", split_z))
    place = F.asin(F.sqrt(F.col("good") / F.col("labelled"))) * (2 / math.pi)
    band = F.least(F.floor(place * BANDS), F.lit(BANDS - 1)).cast("int")
    kept = stored(kept.select(*node, "segment", "labelled", "good", band.alias("band")))
    bands = kept.groupBy(*node, "band").agg(
        F.sum("labelled").alias("band_labelled"), F.sum("good").alias("band_good"), F.count("*").alias("members")
    )
    hot = bands.where(F.col("members") >= HOT_ROWS)
    both = _looked_up(kept, bands, [*node, "band"], hot, F.col("segment"), "inner")
    alone = F.coalesce(_apart("band_labelled", "band_good", split_z), F.lit(True))
    merged = F.concat(F.lit("{"), F.col("band"), F.lit("}"))
    return both.select(*node, "segment", F.when(alone, F.col("segment")).otherwise(merged).alias("branch"))


def templates(
    shapes: DataFrame, depth: int = DEPTH, min_pages: int = MIN_PAGES, split_z: float = SPLIT_Z
) -> DataFrame:
    """(host, shape, template) from (host, shape, n, labelled, good) counts.

    A level's keys are (host, template so far, segment): aggregates of counts, and joins of
    what they tell, for each level. A merged branch is named by its band, such as {3};
    braces don't stand in addresses as they are.
    """
    now = shapes.withColumn("template", F.array().cast("array<string>"))
    key = ["host", "template", "segment"]
    for level in range(depth):
        segment = F.get("shape", F.lit(level))
        now = now.withColumn("segment", segment)
        children = now.where("segment is not null").groupBy(*key)
        children = children.agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.count("*").alias("shapes")
        )
        hot = children.where(F.col("shapes") >= HOT_ROWS)
        now = _looked_up(now, _branches(children, min_pages, split_z), key, hot, F.col("shape"), "left")
        grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(
            F.array_append("template", F.coalesce("branch", F.lit("*")))
        )
        # each level reads the last one several times: written once, plans do not double
        now = stored(now.withColumn("template", grown).drop("segment", "branch"))
    return now.withColumn(
        "template", F.when(F.size("shape") > depth, F.array_append("template", "**")).otherwise(F.col("template"))
    )


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    good: Column,
    url: str = "url",
    least_purity: float = LEAST_PURITY,
    depth: int = DEPTH,
    min_pages: int = MIN_PAGES,
    split_z: float = SPLIT_Z,
    weight: float = WEIGHT,
) -> DataFrame:
    """pages plus host, path, rule, verdict, template and purity.

    good: each page's label as an expression over its columns; null is no label. Each page
    row is judged for itself, repeated rows count repeatedly. Null urls and urls without
    "://" have an empty host and path, and the verdict of that template. Without any labels
    everything outside the rules is allowed. Columns named like a result are replaced,
    others pass through. An empty table gives no rows.
    """
    results = ("host", "path", "rule", "verdict", "template", "purity")
    labelled = hidden(pages, "labelled_good")
    pages = free(pages.withColumn(labelled, good), *results)
    own = [F.col(f"`{c}`") for c in pages.columns if c != labelled]
    host, path = parts(F.col(f"`{url}`"))
    key = hidden(pages, "path_shape")
    parsed = pages.withColumn("host", host).withColumn("path", path).withColumn(key, shape(F.col("path"), depth))
    shapes = stored(parsed.groupBy("host", F.col(key).alias("shape")).agg(
        F.count("*").alias("n"), F.count(labelled).alias("labelled"), F.count_if(labelled).alias("good")
    ))
    named = templates(shapes, depth, min_pages, split_z)
    total = named.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("labelled")), F.lit(1.0)).alias("prior")).first()
    prior = F.lit(float(total["prior"]))
    hosts = named.groupBy("host").agg(
        ((F.sum("good") + weight * prior) / (F.sum("labelled") + weight)).alias("host_purity")
    )
    purity = (F.col("good") + weight * F.col("host_purity")) / (F.col("labelled") + weight)
    sums = named.groupBy("host", "template").agg(
        F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.count("*").alias("shapes")
    )
    pure = sums.join(hosts, "host").select("host", "template", purity.alias("purity"))
    hot = sums.where(F.col("shapes") >= HOT_ROWS)
    judged = _looked_up(named.select("host", "shape", "template"), pure, ["host", "template"], hot, F.col("shape"), "inner")
    judged = judged.select(
        "host", F.col("shape").alias(key), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"
    )
    address = ["host", key]
    hot = shapes.where(F.col("n") >= HOT_ROWS).select("host", F.col("shape").alias(key))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own_verdict = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    # pages of one address stand in many parts of the table, which keep their rows when read again
    return _looked_up(parsed.drop(labelled), judged, address, hot, F.spark_partition_id(), "left").select(
        *own, "host", "path", rule.alias("rule"), F.coalesce(verdict, own_verdict).alias("verdict"), "template", "purity"
    )
