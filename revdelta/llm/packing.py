"""Packing by power-of-two decomposition.

Each document's ids, closed by an end id, are cut into as many pieces of the longest
length as fit and then into pieces of falling powers of two, the binary digits of what
remains. A piece is one training sequence: none crosses documents, none needs padding,
and batches are drawn from the bucket of one length. Nothing is shuffled.

Null and empty texts give the end id alone. Repeated rows are packed each for itself.
Other columns pass through; columns that clash with the result columns are replaced.
An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdelta.llm.common import free, hidden, map_texts

LONGEST = 2048
END_ID = 1
WORD_END = "</w>"
#: Bytes of words, ids and their entries kept in a Python worker; when full, it starts anew.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 200
#: Characters below are handled word by word; texts with any other go to the tokenizer whole.
LATIN = 0x250


def _simple(char: str) -> bool:
    """Whether the word path may see a character: no control but tab and line ends, nothing
    that libraries class differently, and a lower case of one character below LATIN."""
    low = char.lower()
    control = unicodedata.category(char) in ("Cc", "Cf") and char not in "\t\n\r"
    return not control and char != "\xa0" and len(low) == 1 and ord(low) < LATIN


@cache
def _latin() -> tuple[str, re.Pattern]:
    """(a class of the characters that the word path leaves to the tokenizer, the tokenizer's word pattern).

    Below LATIN no character combines or changes under NFC, and the lower case of simple
    characters stays below it, so the pattern sees every letter as one.
    """
    simple = [c for c in map(chr, range(LATIN)) if _simple(c)]
    letters, numbers = ("".join(c for c in simple if unicodedata.category(c)[0] == k) for k in "LN")
    words = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+"
    return f"[^{re.escape(''.join(simple))}]", re.compile(words)


class WordIds:
    """Ids of texts by a tokenizer whose words are encoded independently of each other
    and end in tokens marked as word ends.

    encode() gives the ids of each text as little-endian unsigned 32-bit bytes, equal to
    those of the tokenizer on the whole text. With specials, the written names of special
    tokens become those tokens, as in a plain call of the tokenizer; else they are text.
    """

    def __init__(self, tokenizer_file: str, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = not specials
        odd, self.words = _latin()
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd, self.names = re.compile(odd), names  # apart: a search for one class of characters is quick
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> bool:
        """Encode new words in one text, spaces keep them apart; false if that fails."""
        ids = self._whole(" ".join(words))
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return False
        flat, start = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            self.known[word] = flat[start:end]
            start = end
        self.held += len(flat) + sum(map(len, words)) + ENTRY_BYTES * len(words)
        return True

    def _is_odd(self, text: str) -> bool:
        """Whether the tokenizer must see the text whole."""
        return self.odd.search(text) is not None or any(n in text for n in self.names)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if self._is_odd(t) else self.words.findall(t.lower()) for t in texts]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        new = set(chain.from_iterable(x for x in split if x is not None)).difference(self.known)
        if new and not self._learn(list(new)):
            return [self._whole(t).tobytes() for t in texts]
        known = self.known.__getitem__
        return [self._whole(t).tobytes() if x is None else b"".join(map(known, x)) for t, x in zip(texts, split)]


@lru_cache(maxsize=1)
def word_ids(tokenizer_file: str, specials: bool) -> WordIds:
    """One for a worker process, so that later tasks find the words of earlier ones."""
    return WordIds(tokenizer_file, specials)


def token_ids(docs: DataFrame, tokenizer_file: str, text: str = "text", end_id: int = END_ID, specials: bool = True) -> DataFrame:
    """docs plus `ids_le`: the document's ids with the end id, little-endian unsigned 32 bits.

    tokenizer_file must be readable at that path on every executor.
    """
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encode = word_ids(tokenizer_file, specials).encode

        def work(texts: list[bytes]) -> list[pa.Array]:
            found = encode([t.decode("utf-8", "replace") for t in texts])
            return [pa.array([x + end for x in found], pa.binary())]

        return work

    return map_texts(docs, text, [T.StructField("ids_le", T.BinaryType())], make)


def cuts(n: str, longest: int = LONGEST) -> str:
    """SQL for the (start, length) pieces of n ids: whole longest pieces, then n's low bits."""
    bits = [1 << i for i in range(longest.bit_length() - 2, -1, -1)]
    low = ", ".join(
        f"if({n} & {b} != 0, named_struct('start', {n} - {n} % {2 * b}, 'length', {b}L), null)" for b in bits
    )
    whole = (
        f"if({n} >= {longest}, transform(sequence(0L, {n} div {longest} - 1), "
        f"i -> named_struct('start', i * {longest}, 'length', {longest}L)), array())"
    )
    return f"concat({whole}, array_compact(array({low})))"


def pack(
    docs: DataFrame, tokenizer_file: str, text: str = "text", longest: int = LONGEST, end_id: int = END_ID, specials: bool = True
) -> DataFrame:
    """One row per piece: docs' other columns and start, length, ids_le, doc_tokens,
    sequence_id, offset, bucket.

    sequence_id is unique and, as nothing is shuffled, the same when a task runs again;
    offset is 0, as a sequence is one piece; bucket is the power of two of the length.
    specials: whether written names of special tokens in a text count as those tokens.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    docs = free(docs, "start", "length", "ids_le", "doc_tokens", "sequence_id", "offset", "bucket")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    ids = token_ids(docs, tokenizer_file, text, end_id, specials)
    ids = ids.select(*kept, "ids_le", F.expr("length(ids_le) div 4").alias("doc_tokens"))
    piece = hidden(docs, "piece")
    pieces = ids.select("*", F.explode(F.expr(cuts("doc_tokens", longest))).alias(piece))
    at, size = F.col(piece)["start"], F.col(piece)["length"]
    return pieces.select(
        *kept,
        at.alias("start"),
        size.alias("length"),
        F.substring("ids_le", (4 * at + 1).cast("int"), (4 * size).cast("int")).alias("ids_le"),
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2(size).cast("int").alias("bucket"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces as Parquet with a folder for each bucket: batches of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)
