"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

All of it is column expressions. A pattern is run by the JVM over the whole text; the
text between matches and the matches themselves, in turn, give every span's place in
code points, so no text is cut by position. Patterns are written so that a failing start
is left at once (possessive repeats, no start inside a run), which keeps long runs of
letters or digits linear. Matches, gaps and block starts are columns of their own, so
that each is computed once for a text: the whole is linear in its matches.

Null texts count as empty; empty texts have no spans. Repeated rows stay. Columns that
clash with the result columns are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdelta.llm.common import free, hidden

#: Spans are numbered in blocks: each append to an array copies it.
BLOCK = 64
#: Code points on either side of a span that are searched for context words.
NEAR = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    context: str
    base_score: float
    #: texts without this have no match (None: look at all texts)
    needs: str | None = None


_LOCAL = "[A-Za-z0-9._%+-]"
#: The order is the order of spans in the result; the first four are the base kinds.
KINDS = (
    Kind(
        "email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"mail|contact|kontakt|correo|courriel", 0.8, "@",
    ),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"\bip\b|host|server|addr|client", 0.5, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", r"card|karte|tarjeta|carte|visa|credit|payment", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"tel|phone|call|mobil|fax", 0.6, "+"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        r"iban|konto|account|cuenta|compte|bank", 0.7,
    ),
    Kind(
        "secret",
        r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x20\"']{0,3}[=:][\x20\"']{0,3}[A-Za-z0-9_+/=-]{16,}+",
        r"auth|login|bearer|credential|private|prod", 0.7,
    ),
)
BASE = KINDS[:4]


def _digit(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.lit(1)).try_cast("int")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = _digit(digits, -i)
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces has remainder 1: letters count as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind on one match."""
    if kind == "ip":
        part = lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), lambda p: part(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        bare = F.regexp_replace(match, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    if kind == "secret":
        # written out words have no digits; keys mix digits and letters
        value = F.regexp_extract(match, "[A-Za-z0-9_+/=-]{16,}$", 0)
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def _blocks(pairs: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))


def _block_starts(pairs: Column) -> Column:
    """Where each block of (gap, match) pairs starts in the text."""
    ahead = lambda at, p: at + _length(p["gap"]) + _length(p["match"])
    end = lambda acc, b: F.aggregate(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), F.element_at(acc, -1), ahead)
    return F.aggregate(_blocks(pairs), F.array(F.lit(0).cast("long")), lambda acc, b: F.array_append(acc, end(acc, b)))


def _placed(kind: Kind, gaps: Column, pairs: Column, starts: Column) -> Column:
    """Confirmed spans of one kind. All three are columns, so looking up an element is cheap."""

    def spans(b: Column) -> Column:
        first = F.struct(F.get(starts, b).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            here = F.get(pairs, i)
            start = acc["at"] + _length(here["gap"])
            end = start + _length(here["match"])
            around = F.lower(F.concat_ws(" ", F.right(here["gap"], F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
            score = F.lit(kind.base_score) + F.when(around.rlike(kind.context), 0.2).otherwise(0.0)
            span = F.struct(
                F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score")
            ).cast(SPAN)
            out = F.when(confirmed(kind.name, here["match"]), F.array_append(acc["out"], span)).otherwise(acc["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        last = F.least((b + 1) * BLOCK, F.size(pairs)) - 1
        return F.aggregate(F.sequence(b * BLOCK, last), first, step)["out"]

    return F.flatten(F.transform(_blocks(pairs), spans))


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs plus `pii`, an array of (kind, start, end, score) by kind in the given order,
    then start; places are code points from 0, ends exclusive, scores 0 to 1."""
    docs = free(docs, "pii")
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns]
    name = {(k.name, what): hidden(docs, f"{what}_{k.name}") for k in kinds for what in ("match", "gap", "pair", "start")}
    column = lambda k, what: F.col(name[k.name, what])
    some = lambda k: F.size(column(k, "match")) > 0

    def matches(k: Kind) -> Column:
        found = F.regexp_extract_all(words, F.lit(k.pattern), F.lit(0))
        return found if k.needs is None else F.when(F.contains(words, F.lit(k.needs)), found).otherwise(F.array().cast("array<string>"))

    # one projection after the other: what several expressions read is computed before them
    found = docs.select(*own, *[matches(k).alias(name[k.name, "match"]) for k in kinds])
    found = found.select("*", *[F.when(some(k), F.split(words, k.pattern, -1)).alias(name[k.name, "gap"]) for k in kinds])
    pair = lambda gap, match: F.struct(gap.alias("gap"), match.alias("match"))
    pairs = lambda k: F.zip_with(F.slice(column(k, "gap"), F.lit(1), F.size(column(k, "match"))), column(k, "match"), pair)
    found = found.select("*", *[F.when(some(k), pairs(k)).alias(name[k.name, "pair"]) for k in kinds])
    found = found.select("*", *[F.when(some(k), _block_starts(column(k, "pair"))).alias(name[k.name, "start"]) for k in kinds])
    none = F.array().cast(f"array<{SPAN}>")
    spans = [F.when(some(k), _placed(k, column(k, "gap"), column(k, "pair"), column(k, "start"))).otherwise(none) for k in kinds]
    return found.select(*own, F.concat(*spans).alias("pii"))


#: Kinds are masked one after the other in this order: longer numbers before their parts.
MASK_ORDER = ("secret", "card", "iban", "phone", "email", "ip")


def mask(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every confirmed span in the text replaced by its kind, like <EMAIL>.

    Kinds are masked in MASK_ORDER, each over what the last one left, in time linear in
    the text. Null texts stay null.
    """
    by_name = {k.name: k for k in kinds}
    out = docs
    for name in [n for n in MASK_ORDER if n in by_name]:
        kind = by_name[name]
        words = F.col(f"`{text}`")
        matches = F.regexp_extract_all(words, F.lit(kind.pattern), F.lit(0))
        safe = F.transform(matches, lambda m: F.when(confirmed(kind.name, m), f"<{kind.name.upper()}>").otherwise(m))  # noqa: B023
        gaps = F.split(words, kind.pattern, -1)
        parts = F.zip_with(gaps, safe, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
        new = F.when(words.rlike(kind.pattern), F.array_join(parts, "")).otherwise(words)
        if kind.needs is not None:
            new = F.when(F.contains(words, F.lit(kind.needs)), new).otherwise(words)
        out = out.withColumn(text, new)
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
