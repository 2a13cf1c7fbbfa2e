"""Licence scans against a plain search, and the expression parser against a
recursive-descent one."""

import random
import re

import pytest

from bomspark.llm import licenses as L
from bomspark.llm import queries as Q

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_places(text, phrases):
    """(label, first word) of every place, by comparing word lists."""
    words = WORDS.findall((text or "").translate(LOWER))
    out = []
    for label, found in phrases.items():
        for p in found:
            p = p.split()
            out += [(label, i) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), sorted(out)


def all_phrases():
    return {**L.BASE, **{label: found for label, (_, _, found) in L.NOTICES.items()}}


def texts():
    rng = random.Random(5)
    bits = ["cc", "by", "CC-BY", "General", "public", "LICENSE", "all rights", "reserved", "All", "Rights", "MIT License",
            "straße", "ccKby", "by-nc", "\n", ", ", " ", "(", "\x7f", "é", "3", "gnu lesser", "Apache", "zero", "creative commons"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    out += [None, "", " \t ", "cc by cc by", "CC-BY cc by-sa 4.0", "all all rights reserved rights reserved",
            "GENERAL PUBLIC LICENSE" * 3, "x" * 5000 + " cc by", "lesser general public license",
            "Iİ cc by", "cc by", "cc　by", "cc_by", "cc`by", "ccby"]
    return out


def test_places_equal_a_plain_search(monkeypatch):
    for size in (1 << 20, 7):  # phrases across the ends of blocks, too
        monkeypatch.setattr(L, "BLOCK_BYTES", size)
        for t in texts():
            got = L.scan((t or "").encode())
            n, want = plain_places(t, all_phrases())
            assert got["n_words"] == n
            assert sorted((p["label"], p["word"]) for p in got["places"]) == want, t
            for p in got["places"]:
                said = " ".join(WORDS.findall(t[p["start"]:p["end"]].translate(LOWER)))
                assert said in all_phrases()[p["label"]]


def descent(tokens):
    """(form, licences, restriction) by recursive descent, None if no expression."""
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def atom():
        nonlocal at
        t = peek()
        if t == "(":
            at += 1
            v = level(1)
            if v is None or peek() != ")":
                return None
            at += 1
            return v
        if t is None or t == ")" or t in L.PRECEDENCE:
            return None
        at += 1
        r = L.restriction_of(t)
        return ("id", t, [t], 4 if r is None else r)

    def level(n):
        nonlocal at
        left = atom() if n == 3 else level(n + 1)
        operator = {1: "OR", 2: "AND", 3: "WITH"}[n]
        while left is not None and peek() == operator:
            at += 1
            right = atom() if n == 3 else level(n + 1)
            if right is None:
                return None
            if n == 3:
                if left[0] != "id" or right[0] != "id":
                    return None
                left = ("WITH", f"{left[1]} WITH {right[1]}", left[2], 2 if left[3] == 3 else left[3])
                continue
            a, b = (f"({v[1]})" if n == 2 and v[0] == "OR" else v[1] for v in (left, right))
            left = (operator, f"{a} {operator} {b}", left[2] + right[2], (min if n == 1 else max)(left[3], right[3]))
        return left

    v = level(1) if tokens else None
    return None if v is None or at != len(tokens) else (v[1], sorted(set(v[2])), v[3])


def test_parser_equals_recursive_descent():
    rng = random.Random(3)
    ids = ["MIT", "Apache-2.0", "GPL-2.0-only", "LGPL-2.1+", "Foo-1", "Classpath-exception-2.0", "CC0-1.0"]
    good = 0
    for _ in range(20_000):
        tokens = [rng.choice(ids if rng.random() < 0.5 else ["(", ")", "OR", "AND", "WITH"]) for _ in range(rng.randrange(0, 8))]
        got = L.parse_expression(tokens)
        assert (got and got[:3]) == descent(tokens), tokens
        good += got is not None
    assert good > 500


@pytest.mark.parametrize("text, expressions, labels", [
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */ x",
     ["(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"], "spdx:apache-2.0,spdx:gpl-2.0-only,spdx:mit"),
    ("SPDX-License-Identifier: MIT\nnext line", ["MIT"], "spdx:mit"),
    ("SPDX-License-Identifier: mit or (apache-2.0", ["mit"], "spdx:mit"),
    ("SPDX-License-Identifier: MIT and nothing else", ["MIT AND nothing"], "spdx:mit,spdx:nothing"),
    ("SPDX-License-Identifier: ???", [None], "spdx:invalid"),
    ("\"license\": \"MIT\", ", ["MIT"], "spdx:mit"),
    ("licence = BSD-3-Clause.", ["BSD-3-Clause"], "bsd,spdx:bsd-3-clause"),
    ("License: see the file", [], ""),
    ("a driving license", [], ""),
    ("Released under the MIT License.", [], "licensed-under,mit")])
def test_tags(text, expressions, labels):
    got = L.scan(text.encode())
    assert [t["expression"] for t in got["tags"]] == expressions
    assert ",".join(got["labels"]) == labels
    assert 0 <= got["score"] < 1 and (got["score"] > 0) == bool(labels)


def test_restriction_of_an_expression():
    value = {e: L.parse_expression(e.split())[2] for e in (
        "MIT OR GPL-3.0-only", "MIT AND GPL-3.0-only", "GPL-2.0-only WITH Classpath-exception-2.0", "Own-1", "CC0-1.0 AND MIT",
        "CC-BY-NC-4.0", "CC-BY-4.0")}
    assert list(value.values()) == [1, 3, 2, 4, 1, 4, 1]


def test_query_columns(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "all rights reserved"), (5, "cc by"), (5, "cc by")]
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, labels string, score string, "
                          "licences string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op11_licenses(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    for i, t in enumerate(texts()):
        if i == 5:
            continue
        n, base = plain_places(t, L.BASE)
        r = by_id[i]
        every = sorted({label for label, _ in plain_places(t, all_phrases())[1]})
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((min(w for _, w in base), max(w for _, w in base)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for label, _ in base}))
        assert [x for x in r.labels.split(",") if x and not x.startswith("spdx:")] == every
        assert 0 <= r.score <= 1
    assert [r.base_labels for r in got if r.doc_id is None] == ["reserved"]


def test_found_in_the_documents(spark):
    """Every planted licence line of the table carries a label; prose without the words has none."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = Q.op11_licenses(spark, sf).join(docs, "doc_id").select("text", "labels", "score").collect()
    for r in rows:
        stated = re.search(r"(?i)licensed under|released under|all rights reserved", r.text or "")
        assert (r.labels != "") >= bool(stated)
        if not re.search(r"(?i)licen|rights|creative|cc0|gpl|domain|confidential|warrant|cc.by|permission|redistribution", r.text or ""):
            assert r.labels == "" and r.score == 0
