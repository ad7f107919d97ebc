"""The queries that apply the corpus operators to the driver's tables, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdelta.llm import (
    bpe, collocations, grader, licenses, line_dedup, manifest, neighbours, packing, pii, quality_rules, simhash,
    substrings, url_filters,
)
from revdelta.llm.common import stored, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in pii.BASE]))
    return found.select(
        "doc_id",
        *[of(k.name).alias(f"n_{k.name}") for k in pii.BASE],
        F.size("pii").cast("long").alias("n_all"),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("pii")).alias("spans"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, check="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: (verdict, host, path) of the url query's rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is whether its own html shows readable prose."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", url_filters.readable(F.col("html")).alias("good"))
    return url_filters.judge(pages, URL_RULES, F.col("good")).drop("url", "good")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op7_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = grader.fit(docs, grader.ratings_of(table(spark, sf_dir, "labels")))
    return grader.grade(docs, model).select(
        "doc_id",
        "expected_grade",
        F.element_at("tails", 1).alias("p_not_toxic"),
        F.element_at("tails", -1).alias("p_good"),
        grader.kept().alias("kept"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base_places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.labels(F.col("base_places")).alias("base_labels"),
        licenses.labels(F.concat("base_places", "places")).alias("labels"),
        "score",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = quality_rules.passes(quality_rules.BASE_POLICY)
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), (base & quality_rules.passes(quality_rules.POLICY)).alias("kept"), "failed",
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(stored(neighbours.index(vectors)), vectors.where("vec_id % 100 = 0"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is verified against the root of its own table, lower-cased in a third of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", UPPER, UPPER.lower())
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest.verify(docs, fields, "lang", "doc_id", {"text": tampered})


def queries() -> dict:
    found = (
        op1_packing, op2_pii, op3_byte_bpe, op4_url_filters, op5_substrings, op6_simhash, op7_grades,
        op8_licenses, op9_quality_rules, op10_neighbours, op11_collocations, op12_line_dedup, op13_manifest,
    )
    return {f.__name__: f for f in found}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Every line with its key; keys of enough documents; lines that stay.
_LINES = rf"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select rid, doc_id, i, ls[i] as line, translate(trim(ls[i], e' \t\n\x0b\x0c\r'), '{UPPER}', '{UPPER.lower()}') as key from (select *, unnest(range(1, len(ls) + 1)) as i from d)),
k as (select key, max(doc_id) as top from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select l.*, k.key is not null and doc_id < top as lost from l left join k on k.key = l.key)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256 from m group by rid, doc_id"""

#: Every n-gram of every piece, counted as text; cuts of the candidates; what longer ones cover.
_PHRASES = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') as t from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws from d),
g as (select lang, 1 as k, unnest(ws) as phrase from p
  union all select lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from p
  union all select lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) from p),
f as (select lang, k, phrase, count(*) as a from g group by all),
c as (select *, string_split(phrase, ' ') as ws from f where k > 1 and a >= {collocations.LEAST}),
cut as (select *, unnest(range(1, k)) as pos from c),
s as (select cut.lang, cut.k, cut.phrase, cut.a, pos, x.a as l, y.a as r, (1000000::hugeint * cut.a * cut.a) // (x.a::hugeint * y.a) as score from cut
  join f x on x.lang = cut.lang and x.phrase = array_to_string(ws[:pos], ' ') and x.k = pos
  join f y on y.lang = cut.lang and y.phrase = array_to_string(ws[pos + 1:], ' ') and y.k = cut.k - pos),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, pos) = 1),
long as (select lang, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) as phrase, a from c where k = 3),
o as (select b.* from b left join (select lang, phrase, max(a) as most from long group by all) m on m.lang = b.lang and m.phrase = b.phrase and b.k = 2
  where m.most is null or 100 * m.most < {collocations.WITHIN} * b.a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
select z.lang, rank, phrase, a, l, r, n, score::bigint as score from z join (select lang, count(*) as n from g where k = 1 group by 1) t on t.lang = z.lang where rank <= {collocations.TOP}"""


def _tree_sql() -> str:
    """Levels of the trees written out one by one: 7 of a language's, 3 over the languages."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    row = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id::varchar', 'source', 'lang', 'n_chars::varchar', text))})"
    # crc32 bit by bit, over the digits of doc_id
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: {step}), 4294967295)"
    parts = [f"""d as (select *, dense_rank() over (order by lang nulls first) as tree, {row('text')} as leaf,
      {row(f"case when {crc} % 3 = 0 then translate(text, '{UPPER}', '{UPPER.lower()}') else text end")} as changed from documents),
      n0 as (select tree, row_number() over (partition by tree order by doc_id) - 1 as pos, leaf as h from d)"""]  # fmt: skip

    def level(before: str, after: str, tree: str) -> None:
        run = f"partition by {tree}, pos // 8 order by pos rows between"
        parts.append(f"""s{before} as (select *, count(*) over (partition by {tree}) as width,
          coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as lft,
          coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as rgt from n{before}),
          n{after} as (select {tree}, pos // 8 as pos, case when any_value(width) = 1 then any_value(h) else sha256(string_agg(h, '' order by pos)) end as h from s{before} group by {tree}, pos // 8)""")

    for k in range(7):
        level(str(k), str(k + 1), "tree")
    parts.append("nt0 as (select 0 as top, tree - 1 as pos, h from n7)")
    for k in range(3):
        level(f"t{k}", f"t{k + 1}", "top")
    parts.append("f0 as (select doc_id, tree, leaf, row_number() over (partition by tree order by doc_id) - 1 as pos, changed as folded, '' as proof from d)")
    last = 0
    for name, tree in [*((str(k), "tree") for k in range(7)), *((f"t{k}", "top") for k in range(3))]:
        at = "f.pos" if tree == "tree" else "f.tree - 1"
        over = 8 ** int(name[-1])
        on = "s.tree = f.tree and" if tree == "tree" else ""
        parts.append(f"""f{last + 1} as (select f.doc_id, f.tree, f.leaf, f.pos, case when s.width = 1 then f.folded else sha256(s.lft || f.folded || s.rgt) end as folded,
          f.proof || s.lft || s.rgt as proof from f{last} f join s{name} s on {on} s.pos = ({at}) // {over})""")
        last += 1
    return f"""with {', '.join(parts)} select doc_id, leaf, n7.h as subroot, nt3.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = nt3.h as verified
      from f{last} f join n7 on n7.tree = f.tree cross join nt3"""


#: The measures and verdicts of the rules, counted word by word and window by window.
_QUALITY = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
three as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
again as (select rid, i from three qualify count(*) over (partition by rid, k) > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from again) group by rid),
m as (select w.rid, doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
  len(ls) as n_lines, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper
  from w left join covered c on c.rid = w.rid),
f as (select *, n_words < 50 as r0, n_repeat_words > n_words / 2 as r1, n_symbols > n_words / 10 as r2, n_letters >= 20 and n_upper > n_letters / 2 as r3,
  n_lines >= 4 and n_dup_lines > n_lines * 3 / 5 as r4, n_words > 0 and word_chars > 20 * n_words as r5, n_words > 0 and word_chars * 5 < n_words * 9 as r6 from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 or r1 as base_failed, not (r0 or r1 or r2 or r3 or r4 or r5 or r6) as kept,
  (r0::int + 2 * r1::int + 4 * r2::int + 8 * r3::int + 16 * r4::int + 32 * r5::int + 64 * r6::int)::bigint as failed
from f"""


def oracle_sql() -> dict[str, str]:
    return {
        "op9_quality_rules": _QUALITY, "op11_collocations": _PHRASES, "op12_line_dedup": _LINES,
        "op13_manifest": _tree_sql(),
    }
