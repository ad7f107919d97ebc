"""The corpus operators against plain versions, on odd and empty inputs."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revdelta.llm import bpe, common, grader, licenses, neighbours, packing, pii, quality_rules, simhash, substrings, url_filters

TEXT = "doc_id long, text string"
ODD = ["", None, " \t\n", "A.", "Ünïcödé İstanbul ΣΑΣ 😀 don't 123 <|endoftext|> x", "náive\x85line\x1csep\xa0wide", "a " * 3000, "x" * 5000, "MƐ aƁb", "Ɛ, na ƏƁ Ⱥ"]
WORDS = "the of and ing tion under license model table 42 3.14 ñandú größe école".split()


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*ODD, *random_texts(30), "A.", "A."]
    rows = [*enumerate(texts), (3, "A."), (None, "no id at all")]
    return spark.createDataFrame(rows, TEXT).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], TEXT)


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("specials", [True, False])
def test_packing_equals_the_tokenizer(spark, docs, rows, specials):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = not specials
    clashing = docs.withColumn("start", F.lit("clash")).withColumn("piece", F.lit("own"))
    pieces = packing.pack(clashing, TOKENIZER, longest=64, specials=specials).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and {p.offset for p in pieces} == {0}
    assert all(p.length == 1 << p.bucket and p.piece == "own" for p in pieces)
    by = {}
    for p in pieces:
        by.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    want = Counter((d, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 1])) for d, t in rows)
    for (d, ids), copies in want.items():
        own = sorted(by[d, len(ids)], key=lambda p: p.start)
        found = b"".join(p.ids_le for p in own[::copies])
        assert tuple(np.frombuffer(found, "<u4").tolist()) == ids and len(own) % copies == 0
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_word_path_equals_the_tokenizer_for_every_letter():
    """All code points below U+3000, alone and beside letters and marks."""
    texts = [t for c in map(chr, range(0x3000)) for t in (c, f"M{c}", f"{c}, na", f"a{c}b ok's", f"1{c}-{c}", f"e\u0301{c}\u0300")]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    words = packing.WordIds(TOKENIZER)
    assert [t for t, got, w in zip(texts, words.encode(texts), want) if got != w] == []
    words.held = packing.CACHE_BYTES + 1  # a full cache starts anew
    assert words.encode(texts[:600]) == want[:600]


def test_byte_bpe_equals_tiktoken_and_decodes(spark, docs, rows):
    ranks = bpe.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, check="again")
    found = bpe.decode(encoded, RANKS).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((d, tuple(encoding.encode_ordinary(t))) for d, t in rows)
    assert all(bytes(r.decoded) == bytes(r.again) == (r.text or "").encode() for r in found)
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefix_table_appends_and_edits_exactly():
    table_of = bpe.vocabulary(RANKS)
    rng = random.Random(2)
    own = bpe.PrefixTable(table_of, b"hello world" * 30)
    for _ in range(60):
        at = rng.randrange(len(own.piece))
        own.edit(at, min(len(own.piece), at + rng.randrange(4)), bytes(rng.choice(b"ab lo") for _ in range(rng.randrange(4))))
        own.append(b"er")
        assert own.ids() == table_of.encode_piece(own.piece)
    merges = bpe.merged(own.piece[:40], table_of.ranks)
    assert own.ids(40) == [table_of.ranks[t] for t in merges]


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_probes_are_not_broadcast(spark):
    """Spark takes them to be as small as the fingerprints that they are made of."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp")).distinct()
    found = simhash._hits(fps)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    found.collect()
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_simhash_groups_equal_all_pairs(spark, docs, rows):
    rng = random.Random(3)
    base = [w for t in random_texts(4, 9) for w in t.split()]
    near = [" ".join(w if rng.random() > 0.004 else "changed" for w in base) for _ in range(25)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(near)], TEXT)
    found = simhash.groups(docs.unionByName(more)).collect()
    known = [*rows, *((100 + i, t) for i, t in enumerate(near))]
    prints = {}
    for d, t in known:
        prints.setdefault(plain_fingerprint(t), []).append(d)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    least = {}
    for p, ids in prints.items():
        for d in ids:
            if d is not None:
                least[root(p)] = min(d, least.get(root(p), d))
    want = Counter((d, f"{p:016x}", least.get(root(p))) for p, ids in prints.items() for d in ids)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    assert simhash.groups(empty(spark)).count() == 0
    stay = [r.doc_id for r in simhash.representatives(docs).collect()]
    assert len(stay) == len(set(stay)) and None in stay


def test_components_of_a_hub_and_chains(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, common.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {found[i] for i in range(400)} == {0} and {found[1000 + i] for i in range(41)} == {1000}


def test_membership_bitmap_never_misses(spark):
    keys = spark.range(0, 5000, 7).withColumn("k", F.col("id"))
    found = common.possibly_in(spark.range(5000).unionByName(spark.sql("select cast(null as bigint) id")), F.col("id"), keys, "k", "held")
    held = {r.id for r in found.where("held").collect()}
    assert set(range(0, 5000, 7)) <= held and None not in held and len(held) < 900


def plain_measures(text):
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(again),
    )


def test_quality_measures_policies_and_ablations(spark, docs, rows):
    ledger = quality_rules.ledger(docs.withColumn("n_words", F.lit("clash"))).cache()
    fields = quality_rules.MEASURES[:5]
    assert Counter((r.doc_id, *(r[f] for f in fields)) for r in ledger.collect()) == Counter((d, *plain_measures(t)) for d, t in rows)
    kept = ledger.where(quality_rules.passes(quality_rules.POLICY)).count()
    table = quality_rules.ablations(ledger, (quality_rules.BASE_POLICY, quality_rules.POLICY)).collect()
    assert {r.n_kept for r in table if r.policy == "prose"} == {kept} and all(r.n_kept_without == r.n_kept + r.n_failed_alone for r in table)
    assert quality_rules.ledger(empty(spark)).count() == 0


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_pii(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    bare = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(bare(m)) <= 19 and luhn(bare(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(bare(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


PRIVATE = [
    "a@b.com_c@d.org 1.2.3.4.5.6.7.8 256.1.1.1 001.0002.3.4", "card 4111 1111 1111 1111, 4111111111111112, 5500-0000-0000-0004",
    "+1 (017) 555-7713 +123 +49.89.123456-", "é😀x.y@ü z@z a@b.c.d..e@f.g 1.2.3.4 " * 90, "9" * 3000 + " +" * 50, None, "",
    "IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE88370400440532013000",
]


def test_personal_data(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PRIVATE)], TEXT + ", pii string")
    for r in pii.find(frame).select("doc_id", pii.joined(F.col("pii")).alias("s")).collect():
        base = ",".join(x for x in r.s.split(",") if not x.startswith("iban"))
        assert base == plain_pii(PRIVATE[r.doc_id] or "")
    scores = [s.score for s in pii.find(frame).where("doc_id = 1").first().pii]
    assert scores[0] > 0.8 > scores[1]  # only the first has a context word nearby
    ibans = [s for s in pii.find(frame).where("doc_id = 7").first().pii if s.kind == "iban"]
    assert [(s.start, s.end) for s in ibans] == [(5, 32), (33, 55)]
    masked = {r.doc_id: r.text for r in pii.mask(frame).collect()}
    assert masked[1] == "card <CARD>, 4111111111111112, <CARD>" and masked[5] is None and "<IP>" in masked[3]
    assert all(plain_pii(t or "") == "" for t in masked.values())


def test_url_rules_and_templates(spark):
    urls = ["http://a.com/x", "HTTP://WWW.Example.com/en/1", "http://example.com/en/2?q#f", "https://m.net/es/", "http://net/fr/1", "http://other.org", None, "no scheme", "http://a.com"]
    urls += [f"http://spam.org/buy/{i}" for i in range(40)] + [f"http://spam.org/read/{i}" for i in range(40)]
    urls += [f"http://spam.org/buy/now/a/b/c/d/{i}" for i in range(20)] + [f"http://spam.org/{i}/2024/x" for i in range(20)]
    rows = [(i, u, "/read/" in (u or "") if u and "spam" in u else None, "own") for i, u in enumerate(urls)]
    rows += [rows[9], rows[6], (None, None, True, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean, path_shape string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    judged = url_filters.judge(pages.withColumn("host", F.lit("clash")), rules, F.col("good")).collect()
    found = {r.page_id: r for r in judged}
    assert len(judged) == len(rows) and {r.path_shape for r in judged} == {"own", None} and found[None].host == ""
    assert [found[i].rule for i in range(9)] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/", "net/fr/", None, None, None, None]
    assert found[1].host == "www.example.com" and found[2].path == "/en/2" and (found[6].host, found[7].path) == ("", "")
    assert {found[i].verdict for i in range(9, 49)} == {"block"} and {found[i].verdict for i in range(49, 89)} == {"allow"}
    # numbers are one wildcard each, a year that many pages share is only told apart by its labels
    assert {found[i].template for i in range(109, 129)} == {"/*/*/*"} and found[20].template == "/buy/*"
    none = url_filters.judge(pages, [], F.lit(None).cast("boolean")).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}
    assert url_filters.judge(pages.limit(0), rules, F.col("good")).count() == 0


def plain_apart(one, group):
    """Whether a child's labels differ from the others' of its group; None if that can't be told."""
    labelled, all_labelled = one[1], sum(c[1] for c in group)
    rest = all_labelled - labelled
    if not labelled or not rest:
        return None
    good, all_good = one[2], sum(c[2] for c in group)
    rate = all_good / all_labelled
    error = (rate * (1 - rate) * (1 / labelled + 1 / rest)) ** 0.5
    return abs(good / labelled - (all_good - good) / rest) > url_filters.SPLIT_Z * error


def plain_branches(group):
    """Names of the segments of one node that stay out of the wildcard."""
    kept = {s: c for s, c in group.items() if c[0] >= url_filters.MIN_PAGES and plain_apart(c, group.values())}
    band = {s: min(int(math.asin((c[2] / c[1]) ** 0.5) * 2 / math.pi * url_filters.BANDS), url_filters.BANDS - 1) for s, c in kept.items()}
    names = {}
    for s, c in kept.items():
        alike = plain_apart(c, [kept[o] for o in kept if band[o] == band[s]]) is False
        names[s] = f"{{{band[s]}}}" if alike else s
    return names


def plain_templates(rows, depth):
    """(url -> template, purity) by the rules of the operator, over plain dictionaries."""
    shapes = Counter()
    for url, good in rows:
        host, path = re.match(r"https?://([^/]*)(.*)", url).groups()
        parts = [p for p in path.split("/") if p]
        shapes[host, (*parts[:depth], *(["**"] if len(parts) > depth else [])), good] += 1
    sums = {}
    for (host, parts, good), n in shapes.items():
        c = sums.setdefault((host, parts), [0, 0, 0])
        c[0] += n
        c[1] += n * (good is not None)
        c[2] += n * (good is True)
    now = {k: () for k in sums}
    for level in range(depth):
        children = {}
        for (host, parts), template in now.items():
            if len(parts) > level:
                child = children.setdefault((host, template), {}).setdefault(parts[level], [0, 0, 0])
                for i in range(3):
                    child[i] += sums[host, parts][i]
        names = {node: plain_branches(group) for node, group in children.items()}
        now = {
            (host, parts): (*template, names[host, template].get(parts[level], "*")) if len(parts) > level else template
            for (host, parts), template in now.items()
        }
    now = {k: (*t, "**") if len(k[1]) > depth else t for k, t in now.items()}
    prior = sum(c[2] for c in sums.values()) / sum(c[1] for c in sums.values())
    of = lambda keep: [sum(c[i] for k, c in sums.items() if keep(k)) for i in (1, 2)]
    out = {}
    for key, template in now.items():
        labelled, good = of(lambda k: k[0] == key[0])  # noqa: B023
        host_purity = (good + url_filters.WEIGHT * prior) / (labelled + url_filters.WEIGHT)
        labelled, good = of(lambda k: k[0] == key[0] and now[k] == template)  # noqa: B023
        out[key] = "/" + "/".join(template), (good + url_filters.WEIGHT * host_purity) / (labelled + url_filters.WEIGHT)
    return out


def test_url_templates_equal_plain_ones(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(900):
        host, section = rng.choice("ab"), rng.choice(["shop", "news", "tag", "v2"])
        path = [section, *rng.choices(["x", "y", str(rng.randrange(400))], k=rng.randrange(4))]
        rows.append((f"http://{host}.org/" + "/".join(path), rng.random() < {"shop": 0.1, "tag": 0.4}.get(section, 0.9) if rng.random() < 0.8 else None))
    frame = spark.createDataFrame(rows, "url string, good boolean")
    want = plain_templates(rows, 3)
    for r in url_filters.judge(frame, [], F.col("good"), depth=3).collect():
        parts = tuple(p for p in r.path.split("/") if p)
        template, purity = want[r.host, (*parts[:3], *(["**"] if len(parts) > 3 else []))]
        assert (r.template, r.verdict) == (template, "block" if purity < 0.5 else "allow") and abs(r.purity - purity) < 1e-9


def test_similar_branches_merge_and_hot_keys_are_spread(spark, monkeypatch):
    rng = random.Random(5)
    rates = {"ads": 0.0, "promo": 0.0, "deals": 0.05, "news": 0.95, "docs": 0.9, "misc": 0.5, "forum": 0.45}
    rows = [(f"http://a.org/{s}/{rng.randrange(10**6)}", rng.random() < rate) for s, rate in rates.items() for _ in range(60)]
    rows += [("http://a.org/ads/same", False)] * 50 + [("http://b.org/one", None)] * 9 + [("http://b.org/two", True)]
    rows += [("http://c.org/", False), ("http://c.org/x", None)]
    frame = spark.createDataFrame(rows, "url string, good boolean")
    want = plain_templates(rows, 3)
    key = lambda r: (r.host, tuple(p for p in r.path.split("/") if p))
    for few in (url_filters.HOT_ROWS, 2):
        monkeypatch.setattr(url_filters, "HOT_ROWS", few)
        found = url_filters.judge(frame, [], F.col("good"), depth=3).collect()
        assert len(found) == len(rows)
        assert all((r.template, round(r.purity, 9)) == (want[key(r)][0], round(want[key(r)][1], 9)) for r in found)
        names = {r.path.split("/")[1]: r.template for r in found if r.host == "a.org"}
        assert names["ads"] == names["promo"] != names["news"] and names["ads"].startswith("/{")
        assert {r.verdict for r in found if "/ads/" in r.path} == {"block"} and {r.verdict for r in found if "/news/" in r.path} == {"allow"}


def test_pages_that_show_prose(spark):
    prose = "<p>" + "some words here " * 30 + "</p>"
    pages = [prose, "<nav>" + prose + "</nav><p>short</p>", prose.replace("words", "###$$$"), prose.upper(), "<script>" + prose, "", None]
    frame = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in frame.select(url_filters.readable(F.col("html"))).collect()] == [True, False, False, False, True, False, None]


def test_licences(spark):
    texts = ["CC BY all rights reserved, All Rights-Reserved", "GENERAL PUBLIC LICENSE ümlaut cc by cc by", "Released under the MIT License.", " -- ", None, "Licensed under the Apache Software License", "Licensed under the Apache License, Version 2.0."]
    frame = spark.createDataFrame(list(enumerate(texts)), TEXT)
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    found = {r.doc_id: r for r in licenses.scan(frame).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        want = sorted((k, j) for k, p in phrases.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        assert found[i].n_words == len(words) and sorted((p.label, p.start) for p in found[i].base_places) == want
    assert [p.label for p in found[2].places] == ["mit"] and found[6].places[0].label == "apache-2.0" and not found[5].places


def paragraph(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_substrings(spark):
    p, q = paragraph(1), paragraph(2)
    near = p.replace(p.split()[30], "other", 1)
    texts = [p + "\n" + paragraph(3), paragraph(4) + "\n" + p, paragraph(5), near, paragraph(6) + " " + q + " " + paragraph(7), q, p, "short line\nshort line", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), TEXT)
    found = substrings.find(frame).collect()
    assert {r.doc_id for r in found} == {0, 1, 3, 4, 5, 6}
    assert {(r.doc_id, r.kept_doc_id) for r in found if r.kind == "paragraph" and r.removed} == {(1, 0), (3, 0), (6, 0)}
    left = {r.doc_id: r.text for r in substrings.dedup(frame).collect()}
    assert left[0] == texts[0] and left[1] == paragraph(4) and left[2] == texts[2] and 6 not in left and left[7] == texts[7]
    assert substrings.find(empty(spark)).count() == 0


def test_pasted_passages_are_removed_whole(spark):
    texts, want = [], []
    for k in range(40):
        passage, lead, tail = paragraph(1000 + k, 51 if k % 2 else 60), paragraph(2000 + k, 33), paragraph(3000 + k, 37)
        texts += [f"{paragraph(4000 + k, 30)} {passage} {paragraph(5000 + k, 30)}", f"{lead} before {passage} behind {tail}"]
        want += [texts[-2].split(), f"{lead} before behind {tail}".split()]
    # the keeper of the middle has less of the passage than a later document
    whole = paragraph(6000, 140).split()
    texts += [" ".join([paragraph(6001, 30), *whole[40:100], paragraph(6002, 30)])]
    texts += [" ".join([paragraph(6001 + 2 * k, 30), *whole, paragraph(6002 + 2 * k, 30)]) for k in (1, 2)]
    want += [texts[-3].split(), [*paragraph(6003, 30).split(), *whole[:40], *whole[100:], *paragraph(6004, 30).split()]]
    want += [[*paragraph(6005, 30).split(), *paragraph(6006, 30).split()]]
    frame = spark.createDataFrame(list(enumerate(texts)), TEXT)
    left = {r.doc_id: r.text.split() for r in substrings.dedup(frame).collect()}
    assert [left[i] for i in range(len(texts))] == want
    found = substrings.find(frame).where("kind = 'run' and doc_id < 80").collect()
    assert sorted((r.doc_id, r.kept_doc_id, r.n_words, r.removed) for r in found) == [
        (i, i - i % 2, 51 if i // 2 % 2 else 60, i % 2 == 1) for i in range(80)
    ]


def test_every_place_of_a_shared_passage_is_found(spark):
    passage, same = paragraph(7000, 55), "again " * 90
    piece = [paragraph(7001 + k, 30) for k in range(12)]
    texts = [
        f"{piece[0]} {passage} {piece[1]} {passage} {piece[2]}", f"{piece[3]} {passage} {piece[4]} {passage} {piece[5]}\n{piece[6]} {passage} end",
        f"{piece[7]} {same}{piece[8]}", f"{piece[9]} {same}{piece[10]} {same}{piece[11]}",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), TEXT)
    left = {r.doc_id: r.text.split() for r in substrings.dedup(frame).collect()}
    assert left[0] == texts[0].split() and left[2] == texts[2].split()
    assert left[1] == " ".join([*piece[3:7], "end"]).split() and left[3] == " ".join(piece[9:12]).split()


def test_copies_for_dealt_keys_are_not_broadcast(spark):
    """Spark takes SALTS copies of a table to be as small as one."""
    many = spark.range(100).selectExpr("id as doc", "id as row", "id % 7 as k")
    few = spark.range(7).selectExpr("id as k", "id * 2 as v")
    met = substrings._salted(many, few, ["k"])
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc, r.v) for r in met.collect()) == [(i, 2 * (i % 7)) for i in range(100)]


def test_similar_families_are_found_whole(spark):
    rng = random.Random(8)
    base = paragraph(11, 70).split()
    texts = [" ".join([f"x{i}y{k}" for k in range(rng.randrange(1, 30))] + base) for i in range(60)]
    texts += [" ".join(w if rng.random() > 0.03 else f"z{rng.random()}" for w in base) for _ in range(40)]
    found = substrings.find(spark.createDataFrame(list(enumerate(texts)), TEXT)).where("kind = 'paragraph'").collect()
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    sizes = Counter(root(i) for i in range(len(texts)))
    want = {(i, root(i)) for i in range(len(texts)) if sizes[root(i)] > 1}
    got = {(r.doc_id, r.kept_doc_id) for r in found}
    assert len(want & got) >= 0.98 * len(want) and {d for d, _ in got} <= {d for d, _ in want}


def test_grades_order_texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        grade = i % 3
        words = [rng.choice(WORDS) for _ in range(60)] + [["idiot", "scum"][i % 2]] * (grade == 0)
        rows.append((i, " ".join(w + ("###" if grade == 1 else "") for w in words), grade))
    frame = spark.createDataFrame(rows, TEXT + ", grade int")
    model = grader.fit(frame.where("doc_id < 600"), frame.where("doc_id < 600").select("doc_id", "grade"))
    found = grader.grade(frame.where("doc_id >= 600"), model).withColumn("kept", grader.kept()).collect()
    assert np.mean([r.kept == (r.grade == 2) for r in found]) > 0.97
    assert all(0 <= r.expected_grade <= 2 and r.tails[0] >= r.tails[1] - 1e-9 for r in found)
    none = grader.fit(empty(spark), frame.limit(0).select("doc_id", "grade"))
    assert grader.grade(frame.limit(3), none).count() == 3


def area_under_curve(scores, wanted):
    """The share of (wanted, other) pairs that the scores put in order, ties half."""
    ranks = {}
    for place, score in enumerate(sorted(scores)):
        ranks.setdefault(score, []).append(place + 1)
    total = sum(np.mean(ranks[s]) for s, w in zip(scores, wanted) if w)
    n, rest = sum(wanted), len(wanted) - sum(wanted)
    return (total - n * (n + 1) / 2) / (n * rest)


def test_grades_of_held_out_documents(spark):
    """Fitted on odd ids of the given ratings, judged on even ones; figures are in the README."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    ratings = grader.ratings_of(spark.read.parquet(f"{folder}/labels.parquet")).toDF("doc_id", "grade")
    model = grader.fit(docs, ratings.where("doc_id % 2 = 1"))
    held = docs.join(ratings.where("doc_id % 2 = 0"), "doc_id")
    found = grader.grade(held, model).withColumn("kept", grader.kept()).select("grade", "expected_grade", "tails", "kept").collect()
    good = area_under_curve([r.expected_grade for r in found], [r.grade == 2 for r in found])
    clean = area_under_curve([r.tails[0] for r in found], [r.grade > 0 for r in found])
    right, always = np.mean([r.kept == (r.grade == 2) for r in found]), np.mean([r.grade == 2 for r in found])
    print(f"held out {len(found)}: good {good:.3f}, not toxic {clean:.3f}, right {right:.3f} against {always:.3f}")
    assert len(found) > 1000 and good > 0.7 and clean > 0.6 and right > always


def test_grades_equal_plain_sums_and_take_odd_rows(spark, docs):
    rng = np.random.default_rng(3)
    model = grader.Model(rng.normal(size=grader.BUCKETS), np.array([-0.5, 0.25, 2.0]))
    single = model.weights.astype(np.float32)
    clashing = docs.withColumn("tails", F.lit("own")).withColumn("raw_text", F.lit(1))
    found = grader.grade(clashing, model).collect()
    assert len(found) == docs.count() and found[0].raw_text == 1
    for r in found:
        score = float(single[grader.features((r.text or "").encode())].sum())
        want = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert np.allclose(r.tails, want, atol=1e-5) and abs(r.expected_grade - sum(r.tails)) < 1e-9
    # repeated and null ratings: the smallest grade of an id counts, rows without id or grade do not
    once = spark.createDataFrame([(i, i % 3) for i in range(12)], "doc_id long, grade int")
    odd = once.unionByName(once.withColumn("grade", F.col("grade") + 1)).unionByName(
        spark.createDataFrame([(None, 0), (5, None)], "doc_id long, grade int")
    )
    a, b = grader.fit(docs, once), grader.fit(docs.drop_duplicates(), odd)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(700, 16)).round(3)
    vectors[300:420] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    found = neighbours.search(neighbours.index(frame, shard=300), frame.where("vec_id % 50 = 0 or vec_id = 7"), block=10).collect()
    hits = total = 0
    for q in {r.query_id for r in found}:
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(700), far)) if i != q][:10]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - far[r.vec_id]) < 1e-12 for r in own)
        hits, total = hits + len({r.vec_id for r in own} & set(want)), total + 10
        if q == 7 or 300 <= q < 420:
            assert [r.vec_id for r in own] == want
    assert hits >= 0.9 * total
    assert neighbours.search(neighbours.index(frame.limit(0)), frame.limit(0)).count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark):
    shared, own = paragraph(21, 40), [paragraph(30 + k, 45) for k in range(3)]
    rows = [(1, f"{own[0]}\n{shared}"), (2, f"{own[1]}\n{shared}"), (2, own[2]), (2, own[2]), (None, shared), (9, "short")]
    frame = spark.createDataFrame(rows, TEXT).withColumn("spans", F.lit("own")).withColumn("held", F.lit(1)).withColumn("row", F.lit(2))
    left = Counter((r.doc_id, r.text, r.spans, r.held, r.row) for r in substrings.dedup(frame).collect())
    assert left == Counter([(i, t, "own", 1, 2) for i, t in [rows[0], (2, own[1]), rows[2], rows[3], rows[4], rows[5]]])


def test_short_lines_and_repeats_within(spark):
    wrapped = "\n".join(" ".join(paragraph(50, 48).split()[i : i + 8]) for i in range(0, 48, 8))
    texts = [f"{paragraph(51)}\n\n{wrapped}", f"{wrapped}\n\n{paragraph(52)}", f"{paragraph(53)}\n{paragraph(53)}"]
    frame = spark.createDataFrame(list(enumerate(texts)), TEXT)
    across = substrings.find(frame).where("kind = 'paragraph'").collect()
    assert sorted((r.doc_id, r.kept_doc_id, r.n_words, r.removed) for r in across) == [(0, 0, 48, False), (1, 0, 48, True)]
    within = substrings.find(frame, within=True).where("kind = 'paragraph' and doc_id = 2").collect()
    assert sorted((r.start, r.removed) for r in within) == [(0, False), (len(paragraph(53)) + 1, True)]
    with pytest.raises(ValueError, match="shingle"):
        substrings.find(frame, min_words=3)


def test_representatives_by_row(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text of some words"), (2, "quite another text of some words"), (None, "a b c d e f g")]
    frame = spark.createDataFrame(rows, TEXT).withColumn("held", F.lit(1)).withColumn("stays", F.lit("own"))
    kept = Counter((r.doc_id, r.text) for r in simhash.representatives(frame).collect())
    assert kept == Counter([rows[0], rows[2], rows[4]])
    assert simhash.representatives(frame.limit(0)).count() == 0


def test_many_matches_cost_in_proportion(spark):
    frame = spark.createDataFrame([(1, "mail joe@example.com and 1.2.3.4 x " * 3000, "own")], TEXT + ", match_email string")
    found = pii.find(frame).select("match_email", F.size("pii").alias("n"), pii.joined(F.col("pii")).alias("s")).first()
    assert found.n == 6000 and found.match_email == "own" and found.s == plain_pii("mail joe@example.com and 1.2.3.4 x " * 3000)
    assert pii.find(empty(spark)).count() == 0
    keys = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" password: abcdefghijklmnopqrstuvwx'
    assert pii.mask(spark.createDataFrame([(1, keys)], TEXT)).first().text == '<SECRET>" password: abcdefghijklmnopqrstuvwx'


def test_clashing_columns_pass_the_license_scan(spark):
    frame = spark.createDataFrame([(1, "cc by " * 400), (2, None)], TEXT)
    for name in ("words", "at", "starts", "found"):
        frame = frame.withColumn(name, F.lit(name))
    rows = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert len(rows[1].base_places) == 400 and rows[1].words == "words" and rows[1].found == "found" and rows[2].score == 0
    assert licenses.scan(frame.limit(0)).count() == 0


def test_neighbours_of_huge_and_tied_vectors(spark):
    rows = [(i, [float(i % 7), 0.0, 1.0]) for i in range(60)] + [(60, [1e200, 1e200, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(neighbours.index(frame), frame.where("vec_id = 30")).orderBy("rank").collect()
    points = np.array([v for _, v in rows[:60]])
    far = np.sqrt(((points - points[30]) ** 2).sum(axis=1))
    assert [r.vec_id for r in found] == [int(i) for i in np.lexsort((np.arange(60), far)) if i != 30][:10]


def test_readable_is_linear_and_strips_what_is_closed(spark):
    prose = " ".join(f"Word{i}" for i in range(60))
    pages = [
        f"<p>{prose}</p>", f"<script>{prose}</script>", f"<nav a>{prose}<nav>{prose}</nav >", f"<!-- {prose} -->", f"<STYLE>x</style\n>{prose}",
        f"<nav {prose}", f"<script>var t='</p>';</script><p>{prose}<nav>", prose.upper(), "", None, "</nav></script>-->" + prose + "<!-- <nav <script",
    ]
    want = [True, False, False, False, True, True, True, False, False, None, True]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    assert [r.g for r in frame.select("i", url_filters.readable(F.col("html")).alias("g")).orderBy("i").collect()] == want
    for opener in ("<nav ", "<script>", "<!--", "</nav ", "<", "</nav" + " " * 9):
        broken = spark.createDataFrame([(opener * (1_000_000 // len(opener)),)], "html string")
        began = time.time()
        broken.select(url_filters.readable(F.col("html"))).collect()
        assert time.time() - began < 20, opener
