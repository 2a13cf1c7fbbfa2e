"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything runs as DataFrame functions.  For one kind, ``split`` and
``regexp_extract_all`` with the same pattern give the text between the matches
and the matches themselves; running sums of their lengths are the spans, in code
points.  Checks:

* email, ip (every part at most 255), phone (8 to 15 digits),
* card: 16 to 19 digits passing Luhn,
* iban: the length of its country, and mod-97 of the rearranged number is 1; where no
  length is known, the longest run that holds no blank before a known country's start,
* ssn: nine digits in 3-2-4 groups with valid groups; these have no checksum, so
  they count only when a context word stands near.

A match that fails its check is dropped; the search is not retried inside it.
The score is the kind's base confidence, raised when one of the kind's context
words stands within ``CONTEXT`` code points of the span (up to the neighbouring
match of the same kind) and lowered when a word of a different meaning does.
Spans of the first four kinds are always kept; the others need ``MIN_SCORE``.

The email and ip patterns carry a look-behind (or ``\\G``, the end of the last
match) so that a long run of word characters is scanned once, not once per
position.  This does not change the matches: within one run of the first class a
match exists from every start or from none.

Null text counts as empty: no spans.  Long texts are searched whole, repeated rows alike,
and empty tables give empty tables.  Existing columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomspark.llm.common import running_sums

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# Length of an IBAN by country, from the registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_KNOWN = "|".join(c for countries in IBAN_LENGTHS.values() for c in countries.split())
_IBAN = "|".join([f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}"
                  for n, countries in IBAN_LENGTHS.items()]
                 + [rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{_KNOWN})[0-9]{{2}}))?[A-Z0-9]){{11,30}}"])

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

# A text can hold a kind only if this pattern occurs in it (cheap test first).
HINTS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
}

CONTEXT = 48
MIN_SCORE = 0.5
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR = {
    "email": r"mail|contact|write to|reach",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|credit|debit|pay|expir|cvv",
    "phone": r"phone|tel\b|call|mobile|cell|fax|contact",
    "iban": r"iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": r"ssn|social security|taxpayer",
}
AGAINST = {
    "email": r"example|noreply",
    "ip": r"version|release|section|chapter",
    "card": r"order|invoice|isbn|tracking|serial",
    "phone": r"order|invoice|isbn|tracking|serial",
    "iban": r"serial|licen[cs]e key",
    "ssn": r"order|invoice|isbn|part no",
}
NEAR_GAIN, AGAINST_LOSS = 0.2, 0.2


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(place: Column) -> Column:
        d = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        return F.when(place % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(places, F.lit(0), lambda acc, p: acc + value(p)) % 10 == 0


def _mod97(code: Column) -> Column:
    """Whether an IBAN (upper case, no spaces) has the check value 1."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def step(acc: Column, place: Column) -> Column:
        c = F.ascii(F.substring(turned, place, F.lit(1)))
        return (F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."),
                        lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                        & (F.coalesce(F.regexp_extract(p, "([0-9]{1,3})$", 1).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), _mod97(code)).otherwise(F.lit(False))
    if kind == "ssn":
        area, group, serial = (F.split(match, "-")[i] for i in range(3))
        return (~area.isin("000", "666")) & (area < "900") & (group != "00") & (serial != "0000")
    return F.lit(True)


def _score(kind: str, around: Column) -> Column:
    low = F.lower(around)
    raised = F.when(low.rlike(NEAR[kind]), F.lit(NEAR_GAIN)).otherwise(F.lit(0.0))
    lowered = F.when(low.rlike(AGAINST[kind]), F.lit(AGAINST_LOSS)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(BASE_SCORE[kind]) + raised - lowered))


def _cut(df: DataFrame, text: str, kind: str, prefix: str) -> DataFrame:
    """Add the pieces between the matches of a kind (``<prefix>p``) and the
    matches (``<prefix>m``); both null where the kind cannot occur."""
    pattern = F.lit(PATTERNS[kind])
    found = F.col(text).rlike(HINTS[kind])
    return df.withColumns({
        prefix + "p": F.when(found, F.split(F.col(text), PATTERNS[kind], -1)),
        prefix + "m": F.when(found, F.regexp_extract_all(F.col(text), pattern, F.lit(0))),
    })


def _around(pieces: Column, i: Column) -> Column:
    """The text next to match i, up to the neighbouring matches."""
    return F.concat(F.right(F.get(pieces, i), F.lit(CONTEXT)), F.lit(" "),
                    F.left(F.get(pieces, i + 1), F.lit(CONTEXT)))


def _kept(kind: str, match: Column, score: Column) -> Column:
    valid = _valid(kind, match)
    return valid if kind in BASE_KINDS else valid & (score >= MIN_SCORE)


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,match:string,score:double>>"


def _spans(kind: str, pieces: Column, matches: Column, ends: Column) -> Column:
    """The confirmed spans of one kind; the check comes before the score, as
    most proposals of "card" are plain numbers."""

    def numbered(match: Column, i: Column) -> Column:
        return F.struct(match.alias("match"), i.alias("i"))

    def span(x: Column) -> Column:
        match, end = x["match"], F.get(ends, x["i"])
        return F.struct(F.lit(kind).alias("kind"), (end - F.length(match)).alias("start"), end.alias("end"),
                        match.alias("match"), _score(kind, _around(pieces, x["i"])).alias("score"))

    checked = F.filter(F.transform(matches, numbered), lambda x: _valid(kind, x["match"]))
    spans = F.transform(checked, span)
    if kind not in BASE_KINDS:
        spans = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    return F.coalesce(spans, F.array().cast(SPAN_TYPE))


def _replacement(kind: str, pieces: Column):
    def put(match: Column, i: Column) -> Column:
        return F.when(_kept(kind, match, _score(kind, _around(pieces, i))),
                      F.lit(f"[{kind.upper()}]")).otherwise(match)

    return put


def find_pii(df: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Add ``out``: array<struct<kind, start, end, match, score>>, ordered by
    kind as listed in ``kinds``, then start; code points, end exclusive."""
    tmp = "__pii_"
    kept = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias(tmp + "t"))
    for kind in kinds:
        df = _cut(df, tmp + "t", kind, f"{tmp}{kind}_")
    steps = {}
    for kind in kinds:
        p, m = f"{tmp}{kind}_p", f"{tmp}{kind}_m"
        steps[f"{tmp}{kind}_s"] = F.expr(
            f"zip_with(slice({p}, 1, size({m})), {m}, (x, y) -> cast(length(x) + length(y) as bigint))")
    df = df.withColumns(steps)
    df = df.withColumns({f"{tmp}{kind}_e": running_sums(f"{tmp}{kind}_s") for kind in kinds})
    spans = [_spans(kind, *(F.col(f"{tmp}{kind}_{x}") for x in "pme")) for kind in kinds]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.concat(*spans).alias(out))


def mask_pii(df: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Replace every confirmed span of ``text`` by ``[KIND]``, kind by kind in
    the listed order, each kind on the text the kinds before it have left.
    Null text stays null; other columns stay as they are."""
    tmp = "__pii_"
    order = df.columns
    for kind in kinds:
        cut = _cut(df, text, kind, tmp)
        pieces, matches = F.col(tmp + "p"), F.col(tmp + "m")
        put = F.transform(matches, _replacement(kind, pieces))
        joined = F.array_join(F.flatten(F.zip_with(
            pieces, put, lambda x, y: F.array(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))), "")
        df = cut.withColumn(text, F.when(F.size(matches) > 0, joined).otherwise(F.col(text))).select(
            *[F.col(f"`{c}`") for c in order])
    return df
