"""Licence statements: identifier tags, notice phrases and licence expressions.

Words are runs of digits, ASCII letters and all characters from U+0080 on; A-Z count as
a-z and nothing else changes case.  One Aho-Corasick automaton holds all phrases as
sequences of words: a text becomes one symbol a word (words of no phrase share one), and
the automaton names every place where a phrase's words stand consecutively, overlapping
places included.  Three kinds of phrases:

* base phrases (``BASE``) and further notices (``NOTICES``): a place is reported with its
  label, the number of its first word and its span;
* identifier tags (``TAGS``): the text behind a tag and its separator is read as a licence
  expression, up to the first token that cannot continue it.  A shunting-yard parser
  turns it into postfix order (WITH binds before AND, AND before OR, parentheses first)
  and evaluates it: the normal form, the licences named, and how far it restricts
  use (0 public domain, 1 permissive, 2 weak copyleft, 3 strong copyleft, 4 restricted or
  unknown): OR takes the freer side, AND the stricter, and an exception makes strong
  copyleft weak.  Behind the plain field names (``license:``, ``licence =``) an expression
  counts only if every licence in it is known; behind a tag of SPDX any
  identifier counts, and a tag without an expression is reported as not valid.

The score is 1 - product of (1 - weight) over the distinct labels: how surely the text
states a licence, 0 without any.  ``restriction`` is the strictest of notices and tags
(null without any).

Defined cases.  Null text counts as empty: no words, no places, score 0.  Long texts are
taken in blocks that end between words, and a phrase across a block's end is found.
Repeated rows get equal results; a row depends on its own text only, so empty tables
give empty tables and no row waits for another.  Equal places are in the order of
label; a column named like the output is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomspark.llm.common import by_parts
from bomspark.session import ship_package

# Base phrases and labels of the contract.
BASE = {"cc-by": ("cc by",), "gpl": ("general public license",), "reserved": ("all rights reserved",)}

# Further notices as label -> (weight, restriction, phrases).
NOTICES = {
    "agpl": (0.9, 3, ("affero general public license", "gnu agpl")),
    "apache": (0.9, 1, ("apache license", "apache software license")),
    "boost": (0.9, 1, ("boost software license",)),
    "bsd": (0.9, 1, ("bsd license", "bsd 2 clause", "bsd 3 clause", "redistribution and use in source and binary forms")),
    "cc-by-nc": (0.9, 4, ("cc by nc", "creative commons attribution noncommercial")),
    "cc-by-nd": (0.9, 4, ("cc by nd", "creative commons attribution noderivatives")),
    "cc-by-sa": (0.9, 3, ("cc by sa", "creative commons attribution sharealike")),
    "cc0": (0.9, 0, ("cc0", "creative commons zero")),
    "creative-commons": (0.7, 4, ("creative commons",)),
    "eclipse": (0.9, 2, ("eclipse public license",)),
    "gnu-gpl": (0.9, 3, ("gnu gpl", "gplv2", "gplv3")),
    "isc": (0.9, 1, ("isc license",)),
    "lgpl": (0.9, 2, ("lesser general public license", "gnu lgpl", "lgplv2", "lgplv3")),
    "licensed-under": (0.6, 4, ("licensed under", "released under", "distributed under the terms")),
    "mit": (0.9, 1, ("mit license", "mit licence", "permission is hereby granted free of charge")),
    "mozilla": (0.9, 2, ("mozilla public license",)),
    "no-warranty": (0.4, 1, ("without warranty of any kind", "without warranties or conditions of any kind")),
    "proprietary": (0.8, 4, ("proprietary and confidential", "unauthorized copying of this file")),
    "public-domain": (0.5, 0, ("released into the public domain", "dedicated to the public domain")),
    "unlicense": (0.8, 0, ("the unlicense",)),
}
BASE_RULES = {"cc-by": (0.8, 1), "gpl": (0.9, 3), "reserved": (0.5, 4)}
# Notices that say nothing about the terms themselves.
NO_TERMS = ("licensed-under", "no-warranty")

# Identifier tags, and whether they demand known licences.
TAGS = {"spdx license identifier": False, "license expression": True, "license": True, "licence": True}
TAG_WEIGHT = 0.95

# Restriction by the first words of a licence identifier; the longest counts.
FAMILIES = {
    "0bsd": 1, "afl": 1, "agpl": 3, "apache": 1, "artistic": 2, "blueoak": 1, "bsd": 1, "bsl": 1, "busl": 4, "cc-by": 1,
    "cc-by-nc": 4, "cc-by-nd": 4, "cc-by-sa": 3, "cc0": 0, "cddl": 2, "cecill": 3, "cpl": 2, "ecl": 1, "elastic": 4, "epl": 2,
    "eupl": 3, "gfdl": 3, "gpl": 3, "hpnd": 1, "isc": 1, "lgpl": 2, "libpng": 1, "mit": 1, "mpl": 2, "ms-pl": 2, "mulanpsl": 1,
    "ncsa": 1, "odbl": 3, "ofl": 2, "openssl": 1, "osl": 3, "pddl": 0, "php": 1, "postgresql": 1, "psf": 1, "python": 1, "qpl": 3,
    "sspl": 4, "unicode": 1, "unlicense": 0, "upl": 1, "vim": 1, "wtfpl": 0, "x11": 1, "zlib": 1, "zpl": 1,
}
UNKNOWN = 4
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9]+(?:[.:_-]+[A-Za-z0-9]+)*\+?)")
BLOCK_BYTES = 1 << 20

PLACE = "struct<label:string,word:bigint,start:bigint,end:bigint>"
TAG = ("struct<start:bigint,end:bigint,expression:string,licences:array<string>,restriction:int,valid:boolean>")
RESULT = (f"struct<n_words:bigint,places:array<{PLACE}>,tags:array<{TAG}>,labels:array<string>,"
          "restriction:int,score:double>")


# -- licence expressions ---------------------------------------------------------------

def restriction_of(licence: str) -> int | None:
    """Restriction of a licence identifier, None if its family is not known."""
    name = licence.lower().rstrip("+")
    parts = re.split(r"[-_]", name)
    for n in range(len(parts), 0, -1):
        found = FAMILIES.get("-".join(parts[:n]))
        if found is not None:
            return found
    return None


def read_expression(text: str, at: int) -> tuple[list[str], int]:
    """Tokens of the licence expression that starts at ``at``, and its end.  Ends before
    the first token that cannot continue it; a part left open is not taken."""
    tokens: list[str] = []
    whole, end, depth, operand = 0, at, 0, True
    while True:
        m = TOKEN.match(text, at)
        if not m:
            break
        t = m.group(1)
        word = t.upper() if t in ("or", "and", "with", "OR", "AND", "WITH") else t
        if operand:
            if t == ")" or word in PRECEDENCE:
                break
            depth += t == "("
            operand = t == "("
        elif t == ")":
            if not depth:
                break
            depth -= 1
        elif word in PRECEDENCE:
            operand = True
        else:
            break
        tokens.append(word)
        at = m.end()
        if not operand and not depth:
            whole, end = len(tokens), at
    return tokens[:whole], end


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the tokens in postfix order, None if they are no expression."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            held.append(t)
        elif t == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[str, list[str], int, bool] | None:
    """(normal form, licences, restriction, all licences known); None if WITH does not
    stand between a licence and an exception."""
    # value: form, outermost operator, licences, restriction, known
    stack: list[tuple[str, str, list[str], int, bool]] = []

    def form(value, operator: str) -> str:
        return f"({value[0]})" if value[1] and PRECEDENCE[value[1]] < PRECEDENCE[operator] else value[0]

    for t in postfix:
        if t not in PRECEDENCE:
            r = restriction_of(t)
            stack.append((t, "", [t], UNKNOWN if r is None else r, r is not None))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "WITH":
            if left[1] or right[1]:
                return None
            r = 2 if left[3] == 3 else left[3]
            stack.append((f"{left[0]} WITH {right[0]}", t, left[2], r, left[4]))
        else:
            choose = min if t == "OR" else max
            stack.append((f"{form(left, t)} {t} {form(right, t)}", t, left[2] + right[2],
                          choose(left[3], right[3]), left[4] and right[4]))
    value = stack.pop()
    return value[0], sorted(set(value[2])), value[3], value[4]


def parse_expression(tokens: list[str]) -> tuple[str, list[str], int, bool] | None:
    postfix = to_postfix(tokens)
    return evaluate(postfix) if postfix else None


# -- the automaton ---------------------------------------------------------------------

class Phrases:
    """All phrases as one automaton over symbols, one symbol a word."""

    def __init__(self):
        import ahocorasick

        phrases = [(p, "place", label) for label, found in BASE.items() for p in found]
        phrases += [(p, "place", label) for label, (_, _, found) in NOTICES.items() for p in found]
        phrases += [(p, "tag", known) for p, known in TAGS.items()]
        words = sorted({w for p, _, _ in phrases for w in p.split()})
        self.symbol = {w.encode(): chr(i + 1) for i, w in enumerate(words)}
        self.longest = max(len(p.split()) for p, _, _ in phrases)
        self.automaton = ahocorasick.Automaton()
        for phrase, kind, what in phrases:
            key = "".join(self.symbol[w.encode()] for w in phrase.split())
            self.automaton.add_word(key, (len(key), kind, what))
        self.automaton.make_automaton()

    def find(self, data: bytes) -> tuple[int, list[tuple[int, int, str, object]]]:
        """(number of words, places as (first word, words, kind, label or rule)) of a
        text in lower case."""
        n, found, carry = 0, [], ""
        for at, stop in blocks(data):
            symbols = "".join(map(self.symbol.get, WORD.findall(data, at, stop), repeat("\0")))
            base = n - len(carry)
            for end, (size, kind, what) in self.automaton.iter(carry + symbols):
                if base + end >= n:  # else it lies in words that were searched before
                    found.append((base + end - size + 1, size, kind, what))
            n += len(symbols)
            carry = (carry + symbols)[-(self.longest - 1):]
        return n, found


def blocks(data: bytes):
    """(start, stop) of blocks of about BLOCK_BYTES that end between words."""
    at = 0
    while at < len(data):
        stop = at + BLOCK_BYTES
        if stop < len(data):
            m = WORD.match(data, stop)
            stop = m.end() if m else stop
        yield at, min(stop, len(data))
        at = stop


@lru_cache(maxsize=1)
def phrases() -> Phrases:
    return Phrases()


def _spans(data: bytes, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Start and end, in code points, of the words with the given numbers."""
    found: dict[int, tuple[int, int]] = {}
    last, point = 0, 0
    for i, m in enumerate(WORD.finditer(data)):
        if i in wanted:
            a, b = m.span()
            point += len(data[last:a].decode("utf-8", "surrogatepass"))
            size = len(data[a:b].decode("utf-8", "surrogatepass"))
            found[i] = (point, point + size)
            last, point = b, point + size
            if len(found) == len(wanted):
                break
    return found


def scan(raw: bytes) -> dict:
    """The result of one text, given in UTF-8."""
    data = raw.lower()  # bytes: A-Z only
    n, found = phrases().find(data)
    if not found:
        return {"n_words": n, "places": [], "tags": [], "labels": [], "restriction": None, "score": 0.0}
    spans = _spans(data, {w for first, size, _, _ in found for w in (first, first + size - 1)})
    text = raw.decode("utf-8", "surrogatepass") if any(kind == "tag" for _, _, kind, _ in found) else ""
    places, tags, rules = [], [], {}
    for first, size, kind, what in sorted(found, key=lambda f: (f[0], f[2], str(f[3]))):
        start, end = spans[first][0], spans[first + size - 1][1]
        if kind == "place":
            places.append({"label": what, "word": first, "start": start, "end": end})
            weight, restriction = BASE_RULES.get(what) or NOTICES[what][:2]
            rules[what] = (weight, None if what in NO_TERMS else restriction)
            continue
        m = SEPARATOR.match(text, end)
        if not m:
            continue
        tokens, stop = read_expression(text, m.end())
        value = parse_expression(tokens)
        if value and (value[3] or not what):
            tags.append({"start": start, "end": stop, "expression": value[0], "licences": value[1],
                         "restriction": value[2], "valid": True})
            rules.update({f"spdx:{x.lower()}": (TAG_WEIGHT, value[2]) for x in value[1]})
        elif not what:
            tags.append({"start": start, "end": end, "expression": None, "licences": [], "restriction": UNKNOWN, "valid": False})
            rules["spdx:invalid"] = (TAG_WEIGHT, UNKNOWN)
    left = 1.0
    for label in sorted(rules):
        left *= 1.0 - rules[label][0]
    terms = [r for _, r in rules.values() if r is not None]
    return {"n_words": n, "places": places, "tags": tags, "labels": sorted(rules),
            "restriction": max(terms) if terms else None, "score": 1.0 - left}


def find_licenses(df: DataFrame, text: str = "text", out: str = "licences") -> DataFrame:
    """Add ``out``: struct<n_words, places, tags, labels, restriction, score>; spans are in
    code points, end exclusive."""
    ship_package(df.sparkSession)

    def scan_all(texts):
        import pyarrow as pa

        place = pa.struct([("label", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
        tag = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expression", pa.string()),
                         ("licences", pa.list_(pa.string())), ("restriction", pa.int32()), ("valid", pa.bool_())])
        return pa.array([scan(t or b"") for t in texts.cast(pa.binary()).to_pylist()],
                        pa.struct([("n_words", pa.int64()), ("places", pa.list_(place)), ("tags", pa.list_(tag)),
                                   ("labels", pa.list_(pa.string())), ("restriction", pa.int32()), ("score", pa.float64())]))

    return df.withColumn(out, by_parts(scan_all, RESULT, F.col(text)))
