"""Each operator against a brute-force version on small inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bomspark.llm import bpe, jaccard_join, langid, mixing, pii, secret_scan, sharding, topk, toxicity, winnow
from bomspark.session import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- 5 PII

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def random_texts(seed, n, pieces, size):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_pii_equals_plain_patterns(spark, docs):
    pieces = ["a", "@", ".", "b.c", "-", "_", " ", "1", "25", "255.", "4111 1111 1111 1111", "+1 (212) 555-0100",
              "😀", "é", "\n", "+", "(", "x@y.zz", "0001.2.3.4"]
    rows = [(i, t) for i, t in enumerate(random_texts(5, 400, pieces, 14))]
    rows += [(1000 + i, r.text) for i, r in enumerate(docs.select("text").collect())]
    df = spark.createDataFrame(rows, "id long, text string")
    for r in pii.find_pii(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in BASE] == base_pii(r.text or "")


def test_pii_checksums_and_context(spark):
    df = spark.createDataFrame([
        ("account GB82 WEST 1234 5698 7654 32 end",), ("GB83 WEST 1234 5698 7654 32",),
        ("ssn 123-45-6789",), ("part 123-45-6789",), ("my ip address is 10.0.0.1",), ("version 10.0.0.1",)], "text string")
    got = [[(s.kind, s.match, round(s.score, 2)) for s in r.pii] for r in pii.find_pii(df).collect()]
    assert got[0] == [("iban", "GB82 WEST 1234 5698 7654 32", 1.0)]
    assert got[1] == [] and got[3] == []
    assert got[2] == [("ssn", "123-45-6789", 0.5)]
    assert got[4][0][2] > got[5][0][2]


def test_pii_iban_before_upper_case_words_and_numbers(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    texts = [f"{de} BIC COBADEFFXXX", f"{gb} 2024-01-31", f"{no} 500 EUR", f"{de} {gb} {no} A1", f"QQ12 ABCD EFGH IJKL {de} X"]
    got = [[s.match for s in r.pii if s.kind == "iban"] for r in pii.find_pii(
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    assert got == [[de], [gb], [no], [de, gb, no], [de]]


def test_pii_masks_every_base_span(spark, docs):
    for r in pii.mask_pii(docs.select("doc_id", "text")).collect():
        left = base_pii(r.text or "")
        assert not [s for s in left if s[0] in ("email", "ip", "card")]


def test_pii_long_runs_are_linear(spark):
    text = "x" * 200_000 + " a@b.c" + ".d" * 50_000 + " " + "1" * 200_000 + " " + "9." * 50_000
    got = pii.find_pii(spark.createDataFrame([(text,)], "text string")).first().pii
    assert [(s.kind, s.start, s.end) for s in got if s.kind == "email"] == [("email", 200_001, 300_006)]


# ---- 3 BPE

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return path, t


def test_bpe_equals_the_library(spark, docs, tokenizer):
    path, lib = tokenizer
    pieces = ["a", "th", "in", "</w>", "<|endoftext|>", "'s", "'S", " ", "\n", "\x1c", "\x85", "　", "Σ", "İ", "é",
              "é", "你", "😀", "1", "½", "!", "...", "<", "\x00", "ſ", "ing", "aaa"]
    texts = random_texts(7, 500, pieces, 12) + [r.text for r in docs.select("text").collect()] + ["a" * 20_000, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = bpe.decode(bpe.encode(df, path), path).orderBy("id").collect()
    for r, e in zip(out, lib.encode_batch(texts, add_special_tokens=False)):
        assert r.ids == e.ids
        assert r.decoded == lib.decode(e.ids, skip_special_tokens=False)


def test_bpe_border_test_equals_merging(tokenizer):
    """Two tokens are compatible exactly if merging their text gives the pair."""
    path, _ = tokenizer
    with open(path, "rb") as f:
        data = f.read()
    coder, texts = bpe.Encoder(data), bpe.Decoder(data)
    rnd = random.Random(3)
    names = [texts.decode(np.array([i])) for i in range(49406)]
    plain = [i for i, n in enumerate(names) if not n.endswith("</w>") and n.isascii() and n.isalpha()]

    def merged(text):
        parts = [coder_id[c] for c in text]
        while True:
            ranks = [(coder.merge[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in coder.merge]
            if not ranks:
                return parts
            _, i = min(ranks)
            made = next(t for t in made_by[parts[i], parts[i + 1]])
            parts[i:i + 2] = [made]

    coder_id = {n: i for i, n in enumerate(names) if len(n) == 1}
    made_by = {}
    for t in range(49406):
        if coder.born[t] >= 0:
            made_by.setdefault((coder.left[t], coder.right[t]), []).append(t)
    for _ in range(500):
        x, y = rnd.choice(plain), rnd.choice(plain)
        if merged(names[x]) == [x] and merged(names[y]) == [y]:
            assert coder.compatible(x, y) == (merged(names[x] + names[y]) == [x, y])


# ---- 6 secrets

def base_secrets(text):
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                         r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


@pytest.fixture(scope="module")
def scanner():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return secret_scan.Scanner(f.read(), public_tokenizers.PATTERN)


def test_secrets_equal_plain_patterns(scanner, docs):
    pieces = ["password", "TOKEN", "api_key", "apikey", "ſecret", "secret", " ", "=", ":", '"', "abc", "deadbeef01", "AKIA",
              "ABCDEFGH12345678", "é", "0123456789abcdef", "/", "\n"]
    for t in random_texts(11, 800, pieces, 10) + [r.text or "" for r in docs.select("text").collect()]:
        assert [s[:3] for s in scanner.scan(t) if s[0] != "random"] == base_secrets(t)


def test_random_strings_found_and_known_ones_left(scanner):
    secret = "q7Zp0LxV9bT2mK4sW8yR1nD6"
    assert [s[0] for s in scanner.scan(f"see {secret} there")] == ["random"]
    for known in ("d41d8cd98f00b204e9800998ecf8427e".upper(), "123e4567-e89b-12d3-a456-426614174000",
                  "some_long_identifier_name", "getTheVeryLongPropertyName", "12345678901234567890",
                  "internationalization"):
        assert [s for s in scanner.scan(f"see {known} there") if s[0] == "random"] == []


def test_random_strings_of_one_class_or_long_groups_are_tested(scanner):
    for secret in ("xkvqzt7391bnwqpd4422rtzz", "JBSWY3DPEHPK3PXPJBSWY3DPEHPK3PXP", "qzxvkwjpbtrhgnmdfyclsqzx",
                   "QZXVKWJPBTRHGNMDFYCLSQZX"):
        assert [s[:3] for s in scanner.scan(f"see {secret} there")] == [("random", 4, 4 + len(secret))]
    for known in ("=" * 40, "2024-01-31-2359591234567890", "error_code_1234_not_found", "MAXIMUM_NUMBER_OF_CONNECTIONS"):
        assert scanner.scan(f"see {known} there") == []


# ---- 8 winnowing

def brute_winnow(text, k, w):
    if not text:
        return []
    k = min(k, len(text))
    grams = [int(winnow.fingerprint_text(text[i:i + k], k, 1)[0][0]) for i in range(len(text) - k + 1)]
    w, out = min(w, len(grams)), []
    for i in range(len(grams) - w + 1):
        least = min(grams[i:i + w])
        at = max(j for j in range(i, i + w) if grams[j] == least)
        if not out or out[-1] != (least, at):
            out.append((least, at))
    return out


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_winnowing_equals_brute_force(block):
    for t in random_texts(2, 200, list("ab😀"), 70):
        h, p = winnow.fingerprint_text(t, 4, 6, block)
        assert list(zip(h.tolist(), p.tolist())) == brute_winnow(t, 4, 6)


def test_shared_passage_shares_a_fingerprint():
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = word(winnow.W + winnow.K - 1)
        a, at_a = winnow.fingerprint_text(word(100) + passage + word(50))
        b, at_b = winnow.fingerprint_text(word(33) + passage + word(80))
        inside_a = {h for h, p in zip(a.tolist(), at_a.tolist()) if 100 <= p < 100 + winnow.W}
        inside_b = {h for h, p in zip(b.tolist(), at_b.tolist()) if 33 <= p < 33 + winnow.W}
        assert inside_a & inside_b


def test_next_text_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 7)
    rows = [(i * 3 - 40, f"t{i}") for i in range(100)] + [(None, "none"), (5, "tie"), (5, "a"), (500, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want = Counter((order[i][0], order[i][1], order[(i + 1) % len(order)][1]) for i in range(len(order)))
    df = df.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    assert Counter(tuple(r) for r in winnow.with_next(df, "doc_id", "crc", "text").drop("crc").collect()) == want


@pytest.mark.parametrize("hot", [7, None])
def test_next_text_of_a_hot_id_over_many_ranges(spark, monkeypatch, hot):
    """One id, or none, with most rows, many of them with one text: cut into slices, and equal rows as one."""
    monkeypatch.setattr(winnow, "RANGE_ROWS", 10)
    rows = [(hot, f"t{i}") for i in range(200)] + [(hot, "same")] * 120 + [(i, f"u{i}") for i in range(60)] + [(3, "u3")] * 30
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    want = Counter((*order[i], order[(i + 1) % len(order)][1]) for i in range(len(order)))
    assert Counter(tuple(r) for r in winnow.with_next(df, "doc_id", "crc", "text").drop("crc").collect()) == want


def test_likeness_equals_sets():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.randrange(12) for _ in range(rnd.randrange(9))] for _ in range(2))
        both = len(set(a)) + len(set(b))
        assert winnow.likeness(a, b) == (2 * len(set(a) & set(b)) / both if both else 1.0)


def test_packed_texts_round_trip(spark):
    texts = ["", None, "é😀\n" * 2000, "\x00a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [winnow.unpack_text(bytes(r.p)) for r in df.select(winnow.pack(F.col("text")).alias("p")).collect()] == [t or "" for t in texts]
    assert winnow.edited_text("abcde", "XYZ") == "abcXY" and winnow.edited_text("abcde", "X") == "abcX"
    assert winnow.edited_text("a", "XYZ") == "a" and winnow.edited_text("", "X") == ""


# ---- 2 language

def brute_grams(text):
    counts = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f"_{w}_"
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                if p[i:i + n] != "_":
                    counts[p[i:i + n]] += 1
    # a shared edge between two words stands once in the padded line, for each word here
    return counts


def test_ngram_counts_equal_brute_force():
    for t in random_texts(4, 200, list("aébX1 ,_") + ["ß", "😀", "中"], 40):
        keys, counts = langid.count_grams([t])
        assert {langid.gram_text(k): c for k, c in zip(keys.tolist(), counts.tolist())} == dict(brute_grams(t))


def test_language_distance_equals_brute_force(monkeypatch):
    profiles = {"xx": ["a", "b", "ab"], "yy": ["b", "c", "a"]}
    ranker = langid.Ranker(profiles, 3)
    for t in random_texts(6, 200, list("abc "), 12):
        counts = brute_grams(t)
        own = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:3]
        if not own:
            assert ranker.predict(t) == ("und", 0.0)
            continue
        far = {lang: sum(abs(i - p.index(g)) if g in p else 3 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=lambda x: far[x])
        assert ranker.predict(t) == (best, 1 - far[best] / (3 * len(own)))


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than a group holds; results as from one group."""
    rnd = random.Random(12)
    letters = [chr(0x4E00 + i) for i in range(300)]
    rows = [(100 * i + k, " ".join(rnd.choice(letters[5 * i:5 * i + 5]) for _ in range(20)), f"lang{i:02d}") for i in range(40) for k in range(3)]
    rows += [(None, "xx", None), (1, None, "lang00"), (9999, "?!", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    for group in (5_000, 7):
        monkeypatch.setattr(langid, "LANG_GROUP", group)
        profiles = langid.fit(docs)
        got = langid.predict(docs, profiles).selectExpr("doc_id", "lang", "language.lang AS said", "language.score AS score")
        seen.append(sorted(map(str, got.collect())))
        assert all(r.said == r.lang for r in got.collect() if r.lang and r.score > 0)
    assert seen[0] == seen[1] and profiles.parts == 6


def test_training_rows_of_a_hot_id_are_bounded(spark):
    rows = [(7, f"word {i}", "en") for i in range(3000)] + [(7, "copy of a row", "en")] * 3000 + [(i, "mot", "fr") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    grams = langid.fit(docs, train_docs=100).part(0)
    assert set(grams) == {"en", "fr"}


def test_signs_are_not_letters():
    ranker = langid.Ranker({"xx": ["a"]}, 3)
    assert ranker.predict("² ³ Ⅷ 1 _ ½ !") == ("und", 0.0)
    assert langid.words_of("m²x ab") == ["m", "x", "ab"]


def test_language_blocks_do_not_matter(monkeypatch):
    t = "ab abc é " * 50
    whole = [x.tolist() for x in langid.count_grams([t])]
    monkeypatch.setattr(langid, "BLOCK_CHARS", 13)
    assert [x.tolist() for x in langid.count_grams([t])] == whole


# ---- 1 toxicity

def brute_maximal(scores):
    """Maximal segments by their definition: all proper prefixes and suffixes sums
    are positive, and no such segment contains them."""
    n, found = len(scores), []
    total = [0.0]
    for s in scores:
        total.append(total[-1] + s)
    def good(a, b):
        return all(total[i] > total[a] for i in range(a + 1, b + 1)) and all(total[i] < total[b] for i in range(a, b))
    segments = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if good(a, b)]
    for a, b in segments:
        if not any((c, d) != (a, b) and c <= a and b <= d for c, d in segments):
            found.append((a, b))
    return found


def test_training_rows_are_bounded_by_rows(spark):
    """Also where one labelled id repeats, with different texts and with one text."""
    rows = [(7, f"text {i}") for i in range(2000)] + [(7, "same text")] * 1900 + [(i, f"other {i}") for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), (7, 0)] + [(i, 0) for i in range(100, 200)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 5000).count() == 4000
    assert toxicity.training_rows(docs, labels, 120).count() <= 200
    assert toxicity.training_rows(docs, labels.filter("false"), 120).count() == 0


def test_segments_equal_brute_force():
    rnd = random.Random(9)
    words = {"p": 1.0, "q": 0.37, "n": -0.61, "m": -0.05}
    for _ in range(300):
        tokens = [rnd.choice(["p", "q", "n", "m", "x", "y"]) for _ in range(rnd.randint(0, 14))]
        found = toxicity.Scored(" ".join(tokens), words)
        seen, scores = Counter(), []
        for t in tokens:
            seen[t] += 1
            scores.append(words.get(t, 0.0) / seen[t] ** 2 - 0.05)
        got = [(found.places[a], found.places[b] + 1) for _, a, b in toxicity.maximal_segments(found, 0.05)]
        want = [(a, b) for a, b in brute_maximal(scores)]
        assert got == want


def test_toxicity_learns_and_locates(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    rows = []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(40)]
        if i % 8 == 0:
            text[rnd.randint(5, 30)] = rnd.choice(["vile", "filth"])
        rows.append((i, " ".join(text), int(i % 8 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.filter("doc_id < 300").select("doc_id", "text"), df.filter("doc_id < 300").select("doc_id", "toxic"))
    for r in toxicity.score(df.filter("doc_id >= 300"), model).collect():
        assert (r.toxicity.score >= 0.5) == bool(r.toxic)
        if r.toxic:
            s = r.toxicity.segments[0]
            assert set(r.text[s.start:s.end].split()) & {"vile", "filth"}


def test_toxicity_without_a_class(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert all(r.toxicity.score < 0.5 for r in toxicity.score(df, model).collect())
    model = toxicity.fit(df, labels.filter("false"))
    assert [r.toxicity.score for r in toxicity.score(df, model).collect()] == [0.5, 0.5]


# ---- 4 mixing

def fair_targets(words, weights, share, cap):
    """Targets by resharing the excess again and again."""
    total, target, full = share * sum(words), [0.0] * len(words), set()
    while True:
        left = total - sum(cap * words[i] for i in full)
        open_ = [i for i in range(len(words)) if i not in full]
        for i in open_:
            target[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if target[i] > cap * words[i]}
        if not over:
            for i in full:
                target[i] = cap * words[i]
            return target
        full |= over


def test_targets_equal_resharing(spark):
    rnd = random.Random(13)
    for _ in range(3):
        words = [rnd.randint(1, 1000) for _ in range(7)]
        df = spark.createDataFrame([(f"0s{i}", w) for i, w in enumerate(words)], "src string, size long")
        got = [r.target for r in mixing.source_targets(df).orderBy("src").collect()]
        assert got == pytest.approx(fair_targets(words, [5, 2, 1, 5, 2, 1, 5], 1.5, 2.0))


def test_mix_takes_the_pareto_order(spark, docs):
    rows = mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id", "source", "mix.*").collect()
    assert len(rows) == docs.count()
    longest = max(r.size for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        words = sum(r.size for r in mine)
        assert all(r.source_size == words for r in mine)
        assert all(0 <= r.copies <= 2 for r in mine)
        assert min(r.copies for r in mine if r.size) >= int(mine[0].target // words)
        taken = sum(r.size * r.copies for r in mine)
        assert abs(taken - mine[0].target) <= longest / 2 + 1
        # probabilities favour length and are proportional to 1 + floor(log2(size)) below one
        open_ = {r.size: r.p for r in mine if 0 < r.p < 1}
        ratio = {round(p / (1 + size.bit_length() - 1), 9) for size, p in open_.items()}
        assert len(ratio) <= 1
    again = mixing.mix(docs.select("doc_id", "text", "source").repartition(3)).select("doc_id", "mix.copies")
    assert sorted(again.collect()) == sorted((r.doc_id, r.copies) for r in rows)


# ---- 7 sharding

def test_shards_move_only_into_changed_subtrees(spark):
    ids = spark.range(4000)
    tree = sharding.default_tree(8)
    before = {r.id: r for r in sharding.place(ids, ["id"], tree).collect()}
    after = {r.id: r for r in sharding.place(ids, ["id"], sharding.default_tree(9)).collect()}
    moved = [i for i in before if before[i].shard != after[i].shard]
    assert moved and all(after[i].shard == 8 for i in moved)
    assert max(Counter(r.shard for r in before.values()).values()) < 1.2 * 4000 / 8
    # twice the weight of shard 0: rows move only into its region, rack and shard
    heavy = [sharding.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 0 else 1.0) for s in tree]
    changed = {r.id: r for r in sharding.place(ids, ["id"], heavy).collect()}
    for i, r in before.items():
        c = changed[i]
        if r.region != c.region:
            assert c.region == "r0"
        elif r.rack != c.rack:
            assert c.rack == "r0.k0"
        elif r.shard != c.shard:
            assert c.shard == 0
    n = Counter(r.shard for r in changed.values())
    assert 0.15 < n[0] / 4000 < 0.30


def test_draws_equal_brute_force(spark):
    tree = sharding.default_tree(9) + [sharding.Shard("r9", "r9.k0", 20, 0.5), sharding.Shard("r9", "r9.k1", 21, 3.0)]

    def descend(key):
        def draw(name, weight):
            x = int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:12], 16)
            return -math.log((x + 0.5) / 2**48) / weight

        at = tree
        for part in (lambda s: s.region, lambda s: s.rack, lambda s: str(s.shard)):
            weights = {}
            for s in at:
                weights[part(s)] = weights.get(part(s), 0.0) + s.weight
            best = min(weights, key=lambda n: (draw(n, weights[n]), n))
            at = [s for s in at if part(s) == best]
        return at[0].shard

    ids = spark.createDataFrame([(i,) for i in range(400)] + [(None,)], "id long")
    for r in sharding.place(ids, ["id"], tree).collect():
        assert r.shard == descend("null" if r.id is None else r.id)


def test_slots_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    rows = spark.range(500).union(spark.createDataFrame([(7,)] * 200, "id long"))
    placed = materialise(sharding.place(rows, ["id"], sharding.default_tree(8)), "t")
    got = {}
    for r in sharding.number_slots(placed, order=["id"]).collect():
        got.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, got.values())) == 700
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


# ---- 9 Jaccard join

def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for size, copies, edits in ((60, 40, 3), (200, 25, 6), (12, 10, 1), (5, 6, 1), (3, 4, 1), (900, 5, 20)):
        base = [rnd.choice(vocab) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                at = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[at] = rnd.choice(vocab)
                else:
                    del w[at]
                    if not w:
                        w = ["x"]
            rows.append((i, " ".join(w) if rnd.random() < 0.7 else "  ".join(w).upper()))
            i += 1
    shared = " ".join(rnd.choice(vocab) for _ in range(80))
    for _ in range(40):  # a passage many documents share
        rows.append((i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60))) + " " + shared))
        i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, " \t\n"), (i + 3, rows[0][1])]


@pytest.mark.parametrize("words,percent,limits", [(4, 85, {}), (5, 80, {"TILE_ROWS": 7, "FEW_PAIRS": 0, "HOT_SHINGLES": 5,
                                                                       "TASK_TIMES": 2, "SMALL_TILE": 2})])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, words, percent, limits):
    for name, value in limits.items():  # small tiles and forests: the second pass must mend them
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(words)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_signature_bound_never_loses_a_link():
    rnd = random.Random(21)
    for _ in range(200):
        universe = rnd.sample(range(1 << 60), 300)
        a = np.array(sorted(rnd.sample(universe, rnd.randint(1, 250))), np.uint64)
        b = np.array(sorted(rnd.sample(universe, rnd.randint(1, 250))), np.uint64)
        d = jaccard_join.differing_bits(jaccard_join.signature(a), jaccard_join.signature(b))
        assert len(set(a.tolist()) & set(b.tolist())) <= (len(a) + len(b) - d) // 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.sid: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(3)}}


# ---- 10 top-k

def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    monkeypatch.setattr(topk, "RUN_BUCKETS", 3)
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.normal(size=8) * rnd.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(6)]                      # ties
    rows += [(400, [0.0] * 8), (401, [1.0] * 4), (402, [0.5] * 4)]         # zero vector, other dimension
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(600, [3e9] * 8), (601, [-2e9] * 8)]                          # beyond exact floating point
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = df.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    got = {}
    for r in topk.top_products(v, v.filter("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    good = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows
            if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q in (i for i in good if i % 10 == 0):
        scores = [(-clamp(sum(a * b for a, b in zip(good[q], w))), i) for i, w in good.items() if i != q and len(w) == len(good[q])]
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:5]]


def test_topk_of_a_query_whose_id_is_repeated(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.integers(1, 50, 4).tolist()) for i in range(60)] + [(10, [60 + i] * 4) for i in range(9)]
    v = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    asked = spark.createDataFrame([(10, [1, 1, 1, 1])], "vec_id long, v array<bigint>")
    got = [(-r.score, r.id) for r in topk.top_products(v, asked, 5).orderBy("rank").collect()]
    assert got == sorted((-sum(w), i) for i, w in rows if i != 10)[:5]


def test_topk_buckets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    monkeypatch.setattr(topk, "RUN_BUCKETS", 3)
    written = {}

    def kept(df, name):
        written[name] = materialise(df, name)
        return written[name]

    monkeypatch.setattr(topk, "materialise", kept)
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.integers(-90, 90, 4).tolist()) for i in range(300)]
    rows += [(1000 + i, [30, -20, 10, 5]) for i in range(200)]                  # one length
    rows += [(7, rnd.integers(-90, 90, 4).tolist()) for _ in range(100)]        # one id
    rows += [(20, [9, 9, 9, 9 + i % 40]) for i in range(120)]                   # one id that is asked for
    v = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    asked = spark.createDataFrame([r for r in rows if r[0] % 10 == 0 and r[0] != 20] + [(20, [1, 2, 3, 4])], v.schema)
    got = {}
    for r in topk.top_products(v, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    sizes = [r.n for r in written["topk-buckets"].select("n").collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 16
    for q, w in {i: w for i, w in asked.collect()}.items():
        assert got[q] == sorted((-sum(a * b for a, b in zip(w, x)), i) for i, x in rows if i != q)[:5]


def test_toxicity_marks_each_passage_of_a_long_text():
    model = toxicity.Model(words={"vile": 3.0, "scum": 3.0, "filth": 3.0, "kind": -1.0}, gumbel_l=1.0, gumbel_k=0.1)
    passage, clean = "vile scum filth vile scum filth", "some kind words here " * 60
    text = " ".join([passage, clean, passage, clean, passage])
    evidence, found = toxicity.evidence_of(text, model)
    assert [text[a:b] for a, b, _, _ in found] == [passage] * 3
    assert 0 < evidence < sum(math.log(toxicity.E_MAX / e) for _, _, _, e in found)
