"""Line dedup, phrases and manifests against plain versions, on odd and empty inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revdelta.llm import catalog, collocations, line_dedup, manifest
from revdelta.llm.common import stored

UPPER = catalog.UPPER
LOWER = str.maketrans(UPPER, UPPER.lower())
SPACES = " \t\n\x0b\x0c\r"


def plain_lines(rows, min_chars, min_docs):
    """rows: (id, text); what each row keeps."""
    at = lambda i: line_dedup.NO_ID if i is None else i
    key = lambda line: line.strip(SPACES).translate(LOWER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(at(i))
    lost = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if at(i) >= lost.get(key(x), at(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_rows():
    rng = random.Random(3)
    common = [f"Line {i} of some length, ÄÖ and So on" for i in range(12)]
    rows = []
    for i in range(150):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randrange(12))]
        lines = [f" {x}\t" if rng.random() < 0.2 else x.upper() if rng.random() < 0.1 else x for x in lines]
        rows.append((i, "\n".join(["the line that stands in every document", *lines, ""])))
    rows += [(7, "the line that stands in every document\n\nother text"), (7, rows[7][1]), (None, common[0] + "\n" + common[1]), (None, None)]
    return [*rows, (300, None), (301, ""), (302, "\n" * 40), (303, "the line that stands in every document\n" * 500), (304, "ß" * 40 + "\n" + "x" * 100_000)]


@pytest.mark.parametrize(("parts", "batch"), [(1, 10_000), (4, 37), (40, 11)])
def test_line_dedup_equals_a_plain_version(spark, parts, batch):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "own", 0) for r in rows], "doc_id long, text string, kept_text string, row long").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = line_dedup.dedup(docs, min_chars=20, min_docs=4)
        assert found.columns == ["doc_id", "text", "row", "n_lines", "n_dropped", "kept_text"]
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_lines(rows, 20, 4)


def test_bitmaps_tell_lines_apart(spark):
    rows = [(i, "kept once in the last of them\n" + "\n".join(f"mine {i} {j}" for j in range(i))) for i in range(20)]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=10, min_docs=5)
    got = {r.doc: np.unpackbits(np.frombuffer(zlib.decompress(r.bitmap), np.uint8)) for r in maps.collect()}
    assert set(got) == set(range(19)) and all(b[0] == 0 and b[1:].all() for b in got.values())


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_phrases(rows, least, within, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = set()
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            over = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if not any(100 * b >= within * a for b in over):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.mark.parametrize(("slice_bytes", "bits"), [(8 << 20, True), (900, False)])
def test_phrases_equal_a_plain_version(spark, monkeypatch, slice_bytes, bits):
    monkeypatch.setattr(collocations, "SLICE_BYTES", slice_bytes)
    if not bits:  # as if the map of pairs were full
        monkeypatch.setattr(collocations, "_pair_map", lambda pairs: None)
    rng = random.Random(5)
    words = "a b c of the New York größe 😀 x\x01 x x-y 12".split(" ")
    weights = [9, 3, 1, 20, 20, 4, 4, 1, 1, 2, 2, 1, 1]
    text = lambda: "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for w in rng.choices(words, weights, k=rng.randrange(60)))
    rows = [(rng.choice(["en", "de", None, "und", "fr"]), text()) for _ in range(300)]
    rows += [("en", None), (None, ""), ("de", " .,\t"), ("xx", "one two three. one two three"), ("en", "of the " * 3000), ("en", rows[0][1])]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, word string, slice int").repartition(3)
    got = {tuple(r) for r in collocations.mine(docs, least=4, top=40).collect()}
    assert got == plain_phrases(rows, 4, 50, 40) and len(got) > 100


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**12 + 7, 10**13 + 1, 3 * 10**12 + 11
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.mine(spark.createDataFrame([("en", "no phrase stands often")], "lang string, text string")).collect() == []


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_forest(trees):
    """trees: lists of leaves; subroots, root, and the siblings of every leaf, step by step."""

    def tree(nodes, ways):
        nodes = [(h, [w]) for h, w in zip(nodes, ways)]
        while len(nodes) > 1:
            above = []
            for start in range(0, len(nodes), 8):
                run = nodes[start : start + 8]
                for at, (_, below) in enumerate(run):
                    for way in below:
                        way.append(([h for h, _ in run[:at]], [h for h, _ in run[at + 1 :]]))
                above.append((sha(h for h, _ in run), [w for _, ws in run for w in ws]))
            nodes = above
        return nodes[0][0]

    ways = [[[] for _ in leaves] for leaves in trees]
    subroots = [tree(leaves, w) for leaves, w in zip(trees, ways)]
    tops = [[] for _ in trees]
    root = tree(subroots, tops)
    return subroots, root, [[w + t for w in own] for own, t in zip(ways, tops)]


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for r in rows:
        broken = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        text = r[4].translate(LOWER) if broken and r[4] is not None else r[4]
        by.setdefault(r[2], []).append((r[0], sha(map(field, r)), sha(map(field, (*r[:4], text)))))
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = [sorted(by[k], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for k in order]
    subroots, root, ways = plain_forest([[leaf for _, leaf, _ in t] for t in trees])
    out = []
    for t, sub, own in zip(trees, subroots, ways):
        for (i, leaf, changed), way in zip(t, own):
            folded = changed
            for left, right in way:
                folded = sha([*left, folded, *right])
            out.append((i, leaf, sub, root, sha(h for left, right in way for h in (*left, *right)), folded, folded == root))
    return Counter(out)


def manifest_rows(n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["s", None, ""]), rng.choice(["en", "en", "en", "de", None, "é", ""]), rng.choice([3, None]), rng.choice(["Text", "low", "", "Ünï"]) + str(i) if i % 5 else None) for i in range(n)]
    return [*rows, (None, "s", "en", 1, "no id"), (3, "s", "en", 1, "again"), (3, "s", "en", 1, "again"), (-9, "s", "zz", 1, "alone" * 9000)]


@pytest.mark.parametrize(("n", "parts"), [(3, 4), (700, 1), (700, 40), (1500, 20)])
def test_manifest_equals_a_plain_version(spark, tmp_path, n, parts):
    rng = random.Random(n)
    rows = manifest_rows(n) if n < 1500 else [(i, "s", f"lang{rng.randrange(70)}" if i % 2 else "hot", 1, f"T{i}") for i in range(n)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, schema).withColumn("tree", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = Counter(tuple(r) for r in catalog.op13_manifest(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_manifest(rows)


def test_fragments_merge_in_any_order():
    size, rng = 300, random.Random(1)
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(size)]
    _, root, _ = plain_forest([[x.hex() for x in leaves]])
    for _ in range(5):
        dealt = [rng.randrange(7) for _ in leaves]
        parts = [{0: {i: h for i, h in enumerate(leaves) if dealt[i] == p}} for p in range(7)]
        rng.shuffle(parts)
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            joint = {level: a.get(level, {}) | b.get(level, {}) for level in {*a, *b}}
            manifest.settle(size, joint)
            parts.append(joint)
        assert {k: v for k, v in parts[0].items() if v} == {3: {0: bytes.fromhex(root)}}


def test_manifest_of_an_empty_table(spark):
    docs = stored(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string"))
    found = manifest.verify(docs, docs.columns, "lang", "doc_id")
    assert found.collect() == [] and found.columns[0] == "doc_id"
