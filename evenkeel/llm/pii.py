"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores. Columns only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.columns import let

#: Code points before a span that are searched for context words; spans of at least this score are kept.
CONTEXT, THRESHOLD = 40, 0.5


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``base`` kinds are kept whenever they are valid, whatever their score.

    ``hint`` is a character that every match has (skips the pattern elsewhere), ``score`` the score of a confirmed
    match, ``context`` a pattern of words that add ``boost``.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    boost: float = 0.3
    hint: str | None = None
    base: bool = True


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_valid(match: Column) -> Column:
    small = lambda p: let(
        F.regexp_replace(p, "^0+(?=.)", ""), lambda t: (F.length(t) <= 3) & (F.coalesce(t.try_cast("int"), F.lit(999)) <= 255)
    )
    return F.forall(F.split(match, "[.]"), small)


def luhn_valid(match: Column, least: int, most: int) -> Column:
    return let(_digits(match), lambda d: F.length(d).between(least, most) & F.call_function("luhn_check", d))


def mod97_valid(match: Column) -> Column:
    """ISO 7064 check of an account number: the first four characters go last, letters count 10 to 35."""
    bare = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + (F.ascii(c) - 48)).otherwise(a * 100 + (F.ascii(c) - 55)) % 97
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.length(bare).between(15, 34) & (rest == 1)


# Possessive forms of the plain patterns: they match the same spans without going back over long runs. A run of local
# characters or digits is tried from its start only, or from the end of the match before.
KINDS = (
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True), 0.8, r"(?i)\b(e-?mail|mail|contact|write)\b", hint="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", _ip_valid, 0.6, r"(?i)\b(ip|host|server|address)\b", hint="."),
    Kind(
        "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+", lambda m: luhn_valid(m, 14, 19), 0.7,
        r"(?i)\b(card|visa|credit|debit|payment)\b",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(10, 15), 0.6,
        r"(?i)\b(tel|phone|call|mobile|fax)\b", hint="+",
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        mod97_valid, 0.7, r"(?i)\b(iban|account|bank)\b", base=False,
    ),
    Kind(
        "short_card", r"(?<![0-9.+-])(?<![0-9]\x20)[0-9]{13}(?![0-9]|[\x20.-][0-9])", lambda m: luhn_valid(m, 13, 13), 0.3,
        r"(?i)\b(card|visa|credit|debit|payment)\b", base=False,
    ),
)

SPAN = "struct<start:int,rank:int,end:int,kind:string,base:boolean,score:double>"


def _matches(text: Column, kind: Kind, rank: int) -> Column:
    """Valid spans of one kind: the lengths of the matches and of the gaps between them give the places."""
    empty = F.array().cast(f"array<{SPAN}>")

    def spans(found: Column, gaps: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            match = F.get(found, i)
            start = acc["at"] + F.length(F.get(gaps, i))
            end = start + F.length(match)
            near = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
            score = F.least(F.lit(kind.score) + F.when(near.rlike(kind.context), kind.boost).otherwise(0.0), F.lit(1.0))
            good = kind.valid(match) if kind.base else kind.valid(match) & (score >= THRESHOLD)
            span = F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"),
                F.lit(kind.base).alias("base"), score.alias("score"),
            ).cast(SPAN)
            return F.struct(end.alias("at"), F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["spans"])

    every = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    some = text.rlike(kind.pattern) if kind.hint is None else F.contains(text, F.lit(kind.hint)) & text.rlike(kind.pattern)
    return F.when(some, let(every, lambda m: let(F.split(text, kind.pattern, -1), lambda g: spans(m, g)))).otherwise(empty)


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_spans``: array of (start, rank, end, kind, base, score) by start, then kind.

    Offsets count code points, the end is exclusive. A null text has no spans. Rows are independent, so neither skew
    nor order matters; a text with very many matches costs their number squared in array copies. Raises ``ValueError``
    if ``docs`` has a column ``pii_spans`` or ``__text``.
    """
    if {"pii_spans", "__text"} & set(docs.columns):
        raise ValueError("columns pii_spans and __text clash with the operator's own")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [_matches(F.col("__text"), kind, rank) for rank, kind in enumerate(KINDS)]
    rows = docs.withColumn("__text", text)
    return rows.withColumn("pii_spans", F.sort_array(F.concat(*parts))).drop("__text")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; nulls stay null.

    Overlapping spans count as one, named after the first.
    """
    text, start = F.col("text"), lambda s: s["start"]

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(start(s) - acc["at"], F.lit(0)))
        out = F.when(start(s) >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    last = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size("pii_spans") > 0, F.aggregate("pii_spans", zero, step, last)).otherwise(text)
    return find_spans(docs).withColumn("text", clean).drop("pii_spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document the number of base spans by kind, the digest of the base spans and all spans as text."""
    found = find_spans(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("pii_spans")).alias("spans"),
    )
