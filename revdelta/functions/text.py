"""Text quality, words and normal forms, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as unreadable, and where pages match.
SPACE = "\\x09-\\x0D\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
UNREADABLE = "[\\x00-\\x08\\x0E-\\x1F\\uE000-\\uF8FF\\uFFFD]"
DECODABLE_FLOOR = 0.5
PAGE_MATCH = 0.55
PAGE_WORD = "[\\p{L}\\p{N}][\\p{L}\\p{N}'’.\\-/]*"
TOKEN = f"[\\p{{L}}\\p{{N}}_]+|[^{SPACE}\\p{{L}}\\p{{N}}_]"
CLOSING, OPENING = "],.!?:;%)}\"'’", "([{\"'$/"
DASHES = "[‐‑‒–—−]"
UNITS = "v|ma|a|ns|ms|mm|cm|°c"


def decodable_ratio(text: Column) -> Column:
    """Share of characters other than white space that stand for real text; 1 for none."""
    seen = F.length(F.regexp_replace(text, f"[{SPACE}]", ""))
    bad = F.regexp_count(text, F.lit(UNREADABLE))
    return F.when(seen == 0, 1.0).otherwise(1 - bad / seen)


def is_decodable(text: Column, floor: float = DECODABLE_FLOOR) -> Column:
    return decodable_ratio(text) >= floor


def fingerprint(text: Column) -> Column:
    """The distinct words of a page. Leaders (runs of dots) part words, closing marks go."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), "\\.{2,}", " "), F.lit(PAGE_WORD), F.lit(0))
    bare = F.transform(words, lambda w: F.regexp_replace(w, "[.\\-/'’]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def tokens(text: Column) -> Column:
    """Words and single marks, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def join_tokens(words: Column) -> Column:
    """Readable text of tokens: no space before closing or after opening marks."""

    def add(done: Column, word: Column) -> Column:
        tight = F.contains(F.lit(CLOSING), word) | F.contains(F.lit(OPENING), F.right(done, F.lit(1)))
        return F.when(done == "", word).when(tight, F.concat(done, word)).otherwise(F.concat(done, F.lit(" "), word))

    return F.aggregate(words, F.lit(""), add)


def trigrams(text: Column) -> Column:
    """Character trigrams in order, single characters where there are fewer than three."""
    chars = F.split(F.regexp_replace(text, f"[{SPACE}]+", " "), "")
    after = lambda k: F.slice(chars, F.lit(k), F.greatest(F.size(chars), F.lit(1)))
    pairs = F.zip_with(chars, after(2), lambda a, b: F.concat(a, b))
    threes = F.filter(F.zip_with(pairs, after(3), lambda a, b: F.concat(a, b)), lambda g: g.isNotNull())
    return F.when(F.size(chars) < 3, F.filter(chars, lambda c: c != "")).otherwise(threes)


_NUMBER_LETTER = re.compile(r"([0-9])\s*-\s*([a-z])(?![A-Za-z0-9_])")
_NUMBER_UNIT = re.compile(rf"([0-9])\s+({UNITS})(?![A-Za-z0-9_])")


def _glued(text: str) -> str:
    return _NUMBER_UNIT.sub(r"\1\2", _NUMBER_LETTER.sub(r"\1\2", text))


def _plain(char: str) -> bool:
    return unicodedata.category(char)[0] in "LN"


def canonical(text: str) -> str:
    """Words only, compatibility-normalised and lower-cased, numbers glued to their units."""
    lower = re.sub(DASHES, "-", unicodedata.normalize("NFKC", text).lower())
    return " ".join("".join(c if _plain(c) else " " for c in _glued(lower)).split())


def identity(text: str) -> str:
    """Like canonical(), but strict enough for technical labels: marks stay."""
    source = re.sub(DASHES, "-", unicodedata.normalize("NFKC", text))
    technical = source == source.upper() or re.search(r"[0-9/_+#]", source)
    out = _glued(source.lower())
    if technical:
        out = re.sub(r"(?<=[^\W\d_])\s+(?=[^\W\d_])", "", out)
    return " ".join(re.sub(r"\s*([,;:/()\[\]{}])\s*", r"\1", out).split())


def canonical_text(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(canonical, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def identity_text(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(identity, na_action="ignore")

    return F.pandas_udf(run, "string")(text)
