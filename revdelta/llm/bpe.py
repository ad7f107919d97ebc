"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text exactly one token can end its encoding. The table
of these last tokens gives the encoding of any prefix by walking back, lets a piece grow
at its end without encoding it again, and lets an edit re-encode only what follows it
until the table agrees with the old one.

A token t can end prefix i if it spells the prefix's end and the last token of the rest,
p, may stand before it: merging p + t as bytes never merges across their border.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdelta.llm.common import free, map_texts

#: Pieces and token pairs kept in a Python worker; when full, it starts anew.
CACHE_PIECES = 600_000
CACHE_PAIRS = 500_000
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merging by lowest rank, leftmost first; only ranks under `below` merge."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60 or below is not None and rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixBpe:
    """The tables of one vocabulary. Tokens are named by their ranks, the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.base = max(ranks.values()) + 1
        #: token -> the two tokens of its last merge, for tokens that merging can reach
        self.parts: dict[int, tuple[int, int]] = {}
        self.reached = {t: r for t, r in ranks.items() if len(t) == 1}
        for t, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and len(halves := merged(t, ranks, rank)) == 2:
                self.parts[rank] = (ranks[halves[0]], ranks[halves[1]])
                self.reached[t] = rank
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that lie at one end of `token` as merging builds it, from the byte
        up, each with the rank of the merge that uses it up."""
        chain, used = [], NEVER
        while True:
            chain.append((self.tokens[token], used))
            if token not in self.parts:
                return chain[::-1]
            used, token = token, self.parts[token][side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of left and right encode as just these two.

        Merges happen in rising order of rank. Both ends at the border are followed up
        in that order; the pair fails if joining what meets there would come first, on a
        tie with a merge to its right too.
        """
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            joined = self.ranks.get(x + y, NEVER)
            if joined < x_used and joined <= y_used and joined != NEVER:
                return False
            if x_used == y_used == NEVER:
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def extend(self, piece: bytes, last: list[int], until: int | None = None) -> None:
        """Fill `last`, the last token of each prefix of `piece` from length 1 on."""
        reached, pairs, longest, base = self.reached.get, self.pairs, self.longest, self.base
        for end in range(len(last) + 1, (until or len(piece)) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = reached(piece[start:end])
                if token is not None:
                    if not start:
                        break
                    pair = last[start - 1] * base + token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) > CACHE_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.may_follow(last[start - 1], token)
                    if fits:
                        break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(token)

    def walk(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= len(self.tokens[token])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:  # a piece that is a token is encoded as it, reached or not
            return [self.ranks[piece]]
        last: list[int] = []
        self.extend(piece, last)
        return self.walk(last)

    def learn(self, new: list[str]) -> None:
        """Encode pieces and keep them. In byte order each one shares the table up to
        where it leaves its predecessor."""
        before, last = b"", []
        for text, piece in sorted(((p, p.encode()) for p in new), key=lambda x: x[1]):
            if piece in self.ranks:  # a piece that is a token is encoded as it, reached or not
                ids = (self.ranks[piece],)
            else:
                shared = next((i for i, (a, b) in enumerate(zip(before, piece)) if a != b), min(len(before), len(piece)))
                del last[shared:]
                self.extend(piece, last)
                before, ids = piece, self.walk(last)
            self.pieces[text] = array("I", ids).tobytes()

    def encode_le(self, texts: list[str], pattern: regex.Pattern) -> list[bytes]:
        """The ids of texts in little-endian unsigned 32-bit bytes: each match of the
        pattern for itself, as ordinary text."""
        split = [pattern.findall(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.pieces)
        if len(self.pieces) + len(new) > CACHE_PIECES:
            self.pieces.clear()
            new = set(chain.from_iterable(split))
        self.learn(list(new))
        known = self.pieces.__getitem__
        return [b"".join(map(known, pieces)) for pieces in split]

    def encode(self, text: str, pattern: regex.Pattern) -> list[int]:
        return np.frombuffer(self.encode_le([text], pattern)[0], "<u4").tolist()


class PrefixTable:
    """One growing, editable piece of bytes and its last tokens."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact: the last tokens of shorter prefixes stay as they are."""
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def edit(self, start: int, end: int, by: bytes) -> int:
        """Replace piece[start:end]; returns how many table entries were computed anew.

        Entries before the edit stay. Behind it, once as many entries in a row as the
        longest token has bytes equal the old ones, all later ones do.
        """
        tail, old = self.piece[end:], self.last[end:]
        self.piece = self.piece[:start] + by + tail
        del self.last[start:]
        behind, equal = start + len(by), 0
        for length in range(start + 1, len(self.piece) + 1):
            self.bpe.extend(self.piece, self.last, length)
            if length > behind:
                equal = equal + 1 if self.last[-1] == old[length - behind - 1] else 0
                if equal >= self.bpe.longest:
                    self.last += old[length - behind :]
                    return length - start
        return len(self.piece) - start

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the whole piece or of any prefix of it."""
        return self.bpe.walk(self.last if length is None else self.last[:length])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> PrefixBpe:
    return PrefixBpe(read_ranks(path))


@lru_cache(maxsize=2)
def spellings(path: str) -> dict[int, bytes]:
    return {r: t for t, r in read_ranks(path).items()}


def spell(flat: np.ndarray, ends: list[int], tokens: dict[int, bytes]) -> list[bytes]:
    """The bytes of several id sequences, which lie end to end in `flat`."""
    parts = list(map(tokens.__getitem__, flat.tolist()))
    return [b"".join(parts[start:end]) for start, end in zip([0, *ends], ends)]


def encode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", check: str | None = None) -> DataFrame:
    """docs plus `ids` (array of int), the encoding of the whole text.

    check names a further column (binary) for the bytes that decoding the ids gives, so
    that a caller can hold both against each other without a second pass. ranks_file must
    be readable at that path on every executor. Null and empty texts give an empty array.
    A column named like a result is replaced, others pass through.
    """

    def make():
        bpe, split = vocabulary(ranks_file), regex.compile(pattern)

        def work(texts: list[bytes]) -> list[pa.Array]:
            made = bpe.encode_le([t.decode("utf-8", "replace") for t in texts], split)
            ends = np.cumsum([0, *map(len, made)]) // 4
            flat = np.frombuffer(b"".join(made), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            if check is None:
                return [ids]
            return [ids, pa.array(spell(flat, ends[1:].tolist(), bpe.tokens), pa.binary())]

        return work

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return map_texts(docs, text, fields + ([T.StructField(check, T.BinaryType())] if check else []), make)


def decode(encoded: DataFrame, ranks_file: str, ids: str = "ids") -> DataFrame:
    """encoded plus `decoded` (binary), the bytes that the ids spell; null ids spell nothing."""
    encoded = free(encoded, "decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = encoded.columns.index(ids)

    def run(batches):
        tokens = spellings(ranks_file)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                lists = part.column(at)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                made = spell(flat, np.cumsum(sizes).tolist(), tokens)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)
