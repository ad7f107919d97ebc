"""The registered queries against plain versions of what they return, over whole small tables."""

import base64
import hashlib
import itertools
import re
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from revdelta.llm import catalog

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans(catalog.UPPER, catalog.UPPER.lower())


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def test_op1_pieces_hold_every_id(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*e.ids, 1] for i, e in zip(docs, tokenizer.encode_batch(list(docs.values()), add_special_tokens=False))}
    pieces, places = {}, {}
    for p in catalog.op1_packing(spark, FOLDER).collect():
        pieces.setdefault(p.doc_id, []).append(p)
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(itertools.accumulate([0, *(p.length for p in own)]))[:-1] and {p.doc_tokens for p in own} == {len(ids[i])}
        for p in own:
            part = ids[i][p.start : p.start + p.length]
            assert len(part) == p.length and p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        assert sum(p.length for p in own) == len(ids[i])
    for own in places.values():
        assert [o for o, _ in sorted(own)] == list(itertools.accumulate([0, *(n for _, n in sorted(own))]))[:-1] and sum(n for _, n in own) <= 2048


KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def holds(kind, text):
    digits = [int(c) for c in text if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_op2_base_spans(spark, docs):
    found = {r.doc_id: r for r in catalog.op2_pii(spark, FOLDER).collect()}
    assert set(found) == set(docs)
    for i, text in docs.items():
        spans = [(kind, m.start(), m.end()) for kind, pattern in KINDS.items() for m in pattern.finditer(text) if holds(kind, m[0])]
        told = found[i]
        assert [told.n_email, told.n_ip, told.n_card, told.n_phone] == [sum(s[0] == kind for s in spans) for kind in KINDS]
        base = ["%s:%d:%d" % s for s in spans]
        assert told.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(told.spans.split(","))


def test_op3_encodes_as_the_library_does(spark, docs):
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in catalog.op3_byte_bpe(spark, FOLDER).collect():
        ids = encoding.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(LOWER)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6_components_of_all_pairs(spark, docs):
    prints = {i: fingerprint(t) for i, t in docs.items()}
    smallest = {i: i for i in docs}
    for _ in docs:
        before = dict(smallest)
        for a, b in itertools.combinations(docs, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                smallest[a] = smallest[b] = min(smallest[a], smallest[b])
        if before == smallest:
            break
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op6_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", smallest[i]) for i in docs}


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def test_op8_base_places(spark, docs):
    for r in catalog.op8_licenses(spark, FOLDER).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs[r.doc_id].translate(LOWER))
        places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1
