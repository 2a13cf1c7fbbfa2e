"""Secrets: known shapes, and random strings found by token efficiency.

Known shapes, leftmost and non-overlapping per kind; a match that fails its length
is dropped without another try inside it:

* assign: password, passwd, secret, token or api key, a colon or equals sign, and a
  value of MIN_VALUE characters or more (the span is the whole match),
* access: ``AKIA`` and capitals or digits, 20 characters or more,
* hex: 24 or more lower-case hexadecimal digits.

random: a byte-pair vocabulary packs natural words and identifiers into few
tokens, while a random string needs a token for every one or two characters.  Runs
of MIN_RUN or more characters of ``[A-Za-z0-9+/_=-]`` count as random when they have
fewer than MAX_RATIO characters per token.  Excluded: hexadecimal digests of the usual
lengths, UUIDs, plain numbers (runs without letters), one character repeated, and identifiers whose parts (split
at ``_ - / + =`` and changes of case) are all short numbers or words, a word being three
or more letters of MAX_RATIO or more characters per token.  A run that lies inside a span of a known
shape is not reported again.

Runs longer than PIECE characters are encoded in pieces; each seam adds at most one
token.  Null text counts as empty: no spans.  Long texts are searched whole, repeated rows
alike, and empty tables give empty tables.  A column named like the output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomspark.llm.common import by_parts
from bomspark.session import ship_package

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
MIN_VALUE = 6
MIN_RUN = 20
MAX_RATIO = 2.2
PIECE = 512

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
# a shorter run cannot become long enough at a later start, so the length may
# stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[A-Z]")
WORD_PART = re.compile(r"[A-Za-z]{3,}|[0-9]{1,4}")


def known_shape(run: str) -> bool:
    """Digests, UUIDs, numbers, and one character repeated."""
    return (bool(DIGEST.fullmatch(run) or UUID.fullmatch(run)) or not any(c.isalpha() for c in run)
            or run.count(run[0]) == len(run))


class Scanner:
    def __init__(self, ranks_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.tokens = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary

    def ratio(self, run: str) -> float:
        """Characters per token."""
        return len(run) / max(1, sum(len(self.tokens(run[i:i + PIECE])) for i in range(0, len(run), PIECE)))

    def identifier(self, run: str) -> bool:
        """Whether a run is made of words, which take few tokens each, and short numbers."""
        return all(WORD_PART.fullmatch(p) and (p.isdigit() or self.ratio(p) >= MAX_RATIO) for p in PARTS.findall(run))

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
                 if m.end(2) - m.start(2) >= MIN_VALUE]
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        spans = [(k, a, b, self.ratio(text[a:b])) for k, a, b in found]
        at, covered = 0, -1  # known spans that start at or before the run, and their farthest end
        for m in RUN.finditer(text):
            while at < len(found) and found[at][1] <= m.start():
                covered = max(covered, found[at][2])
                at += 1
            if covered >= m.end() or known_shape(m.group()):
                continue
            ratio = self.ratio(m.group())
            if ratio < MAX_RATIO and not self.identifier(m.group()):
                spans.append(("random", m.start(), m.end(), ratio))
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        return spans


_SCANNERS: dict[str, Scanner] = {}  # of this worker process


def scanner_of(data: bytes, pattern: str) -> Scanner:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(data, pattern)
    return _SCANNERS[key]


def find_secrets(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: array<struct<kind, start, end, ratio>> ordered by start, then
    kind as in KINDS; code points, end exclusive.  ``path`` is a tiktoken rank file,
    ``pattern`` its splitting pattern."""
    spark = df.sparkSession
    ship_package(spark)
    with open(path, "rb") as f:  # a file of the installed tokenizers, read on the driver
        ranks = spark.sparkContext.broadcast(f.read())

    def spans_of(texts):
        import pyarrow as pa

        scan = scanner_of(ranks.value, pattern).scan
        rows = [scan(t) if t else [] for t in texts.to_pylist()]
        flat = [s for r in rows for s in r]
        offsets, n = [0], 0
        for r in rows:
            n += len(r)
            offsets.append(n)
        kinds, starts, ends, ratios = zip(*flat) if flat else ((), (), (), ())
        values = pa.StructArray.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()),
             pa.array(ends, pa.int64()), pa.array(ratios, pa.float64())], ["kind", "start", "end", "ratio"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    kind = "array<struct<kind:string,start:bigint,end:bigint,ratio:double>>"
    return df.withColumn(out, by_parts(spans_of, kind, F.col(text)))
