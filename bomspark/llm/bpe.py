"""Byte-pair encoding by backtracking, and decoding by an offset table.

A model is a ``tokenizers`` JSON file of kind BPE with byte-level symbols and an
end-of-word suffix (the public ``word_bpe_49k.json``): NFC, lower case, words split
by a pattern, no decoder.  Encoding one word:

* an Aho-Corasick automaton over the vocabulary gives the longest token that
  starts at each place of the word;
* tokens are put down from left to right, longest first; a token may follow
  another only if the pair is compatible, i.e. if running the merges over the two
  strings side by side never merges across their border (``compatible``, a walk
  down the two merge trees, kept in a table);
* where no token fits, the last token is taken back and its next shorter prefix
  tried; an end position that led nowhere is never entered again, so the work is
  linear in the length of the word.

Merging by rank and this search give the same tokens, because a sequence of
tokens that each encode to themselves and are pairwise compatible is unique.
Tokens that do not encode to themselves cannot occur and are left out.

Decoding: all token texts stand in one buffer with an offset per id; a document's
ids are gathered from it in one vector operation.  With no decoder in the file,
tokens are joined by one space, as the library does.

The file is a parameter; its bytes are broadcast (fixed size, not part of the
data) and each worker builds the tables once.  Words up to CACHED_CHARS letters
are remembered in two tables (words, runs with other characters) per task, each of
two generations of at most CACHE_WORDS entries: when the young one is full it becomes
the old one, and what is still used moves over, so frequent words stay.  They are
forgotten when the task ends: workers change between encoding, decoding and other
stages, and every one of an executor would hold them for good.

Null text encodes like the empty text: no ids.  Null ids decode to the empty text.
Long texts are encoded whole, repeated rows alike, and empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.llm.common import by_parts
from bomspark.session import bound_batches, ship_package

CACHED_CHARS = 48
CACHE_WORDS = 110_000
CACHE_PAIRS = 300_000
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
END = "Ā"  # stands for the end-of-word suffix; byte symbols are U+0000 to U+00FF


def _byte_symbols() -> dict[str, str]:
    """Printable stand-in -> byte (as U+0000..U+00FF) of byte-level BPE: bytes that
    print stand for themselves, the others take U+0100 and on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class Remembered(dict):
    """A table of bounded size that keeps what is used; see the module text."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def find(self, key: str) -> bytes | None:
        got = self.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.keep(key, got)
        return got

    def keep(self, key: str, value: bytes) -> bytes:
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                super().clear()
            self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.old = {}


class Encoder:
    """The tables of one model; see the module text."""

    def __init__(self, data: bytes):
        import ahocorasick
        import regex

        spec = json.loads(data)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        symbols = _byte_symbols()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

        def plain(token: str) -> str:
            ends = token.endswith(suffix) and token != suffix
            body = token[:-len(suffix)] if ends else token
            return "".join(symbols[c] for c in body) + (END if ends else "")

        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall

        n = max([*vocab.values(), *added.values()]) + 1
        self.left, self.right, self.born = [0] * n, [0] * n, [-1] * n
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            x, y = vocab[a], vocab[b]
            if self.born[made] >= 0:
                raise ValueError("a token with two merges")
            self.merge[x, y] = rank
            self.left[made], self.right[made], self.born[made] = x, y, rank
        self.table: dict[tuple[int, int], bool] = {}

        texts = {i: plain(t) for t, i in vocab.items() if t not in added}
        usable: dict[str, int] = {}
        good = [True] * n
        for i in sorted(texts, key=lambda i: self.born[i]):
            if self.born[i] >= 0:
                x, y = self.left[i], self.right[i]
                good[i] = good[x] and good[y] and self._apart(x, y, self.born[i])
            if good[i]:
                usable[texts[i]] = i
        self.length = [0] * n
        self.shorter = [-1] * n  # longest usable proper prefix
        automaton = ahocorasick.Automaton()
        for text, i in usable.items():
            self.length[i] = len(text)
            automaton.add_word(text, (len(text), i))
            for cut in range(len(text) - 1, 0, -1):
                if (p := usable.get(text[:cut])) is not None:
                    self.shorter[i] = p
                    break
        automaton.make_automaton()
        self.matches = automaton.iter
        self.words_known = Remembered()
        self.runs_known = Remembered()

    def _apart(self, x: int, y: int, limit: float) -> bool:
        """Whether no merge of a rank below ``limit`` joins x and y across their
        border.  Goes back in time: the youngest of the two border pieces is
        undone again and again; a merge of the pieces in between happens if its rank
        comes before the left piece ends, and not after the right one does (of equal
        merges the leftmost is first)."""
        merge, born, left, right = self.merge, self.born, self.left, self.right
        x_ends = y_ends = limit
        while True:
            rank = merge.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends and rank < limit:
                return False
            if born[x] > born[y]:
                x_ends, x = born[x], right[x]
            elif born[y] >= 0:
                y_ends, y = born[y], left[y]
            else:
                return True

    def compatible(self, x: int, y: int) -> bool:
        known = self.table.get((x, y))
        if known is None:
            if len(self.table) >= CACHE_PAIRS:
                self.table.clear()
            known = self.table[x, y] = self._apart(x, y, float("inf"))
        return known

    def forget(self) -> None:
        """Drop what was remembered of the texts; the tables of the model stay."""
        for known in (self.words_known, self.runs_known, self.table):
            known.clear()

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        s = word.encode().decode("latin-1") + END
        size = len(s)
        longest = [-1] * size
        for end, (length, token) in self.matches(s):
            longest[end - length + 1] = token  # ends rise, so the last is the longest
        sizes, shorter, table = self.length, self.shorter, self.table
        open_ = bytearray(b"\x01") * (size + 1)
        open_[size - 1] = 0  # the end mark belongs to the last symbol
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            while token >= 0:
                end = at + sizes[token]
                if open_[end]:
                    if last < 0:
                        break
                    fits = table.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, at = token, end
                if at < size:
                    token = longest[at]
            else:
                open_[at] = 0
                out.pop()
                at -= sizes[last]
                token = shorter[last]
                last = out[-1] if out else -1
        return out

    def word_bytes(self, word: str) -> bytes:
        """Ids of one word as 32-bit integers."""
        ids = self.words_known.find(word)
        return ids if ids is not None else self.words_known.keep(word, array("i", self.encode_word(word)).tobytes())

    def run_bytes(self, run: str) -> bytes:
        """Ids of a run without white space, as 32-bit integers."""
        if run.isascii() and run.isalpha():  # one word
            return self.word_bytes(run.lower())
        ids = self.runs_known.find(run)
        if ids is None:
            # letter-by-letter lower case: no special final sigma
            words = self.words(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())
            ids = self.runs_known.keep(run, b"".join(map(self.word_bytes, words)))
        return ids

    def _plain_bytes(self, text: str, out: list[bytes]) -> None:
        # words never cross white space; str.split also cuts at four separators
        # that the pattern does not count as white space
        runs = text.split() if not SEPARATORS.search(text) else SPACES.split(text)
        known, run_bytes = self.words_known.get, self.run_bytes
        out += [known(run) or run_bytes(run) for run in runs if run]

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers in native order."""
        out: list[bytes] = []
        if self.added_pattern is None:
            self._plain_bytes(text, out)
        else:
            for part in self.added_pattern.split(text):
                if part in self.added:
                    out.append(array("i", [self.added[part]]).tobytes())
                else:
                    self._plain_bytes(part, out)
        return b"".join(out)


class Decoder:
    """The texts of all tokens in one buffer, each followed by a space."""

    def __init__(self, data: bytes):
        import numpy as np

        spec = json.loads(data)
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            names[i] = token.encode() + b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.buffer = np.frombuffer(b"".join(names), np.uint8)

    def decode(self, ids) -> str:
        """``ids``: a numpy array of known ids."""
        import numpy as np

        if len(ids) == 0:
            return ""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.buffer[places].tobytes()[:-1].decode("utf-8", "replace")


_TABLES: dict[tuple[type, str], object] = {}  # of this worker process


def table_of(kind: type, data: bytes):
    """The encoder or decoder of a model file, built once per worker."""
    key = (kind, hashlib.sha256(data).hexdigest())
    if key not in _TABLES:
        _TABLES[key] = kind(data)
    return _TABLES[key]


def forget_words() -> None:
    """Drop what the encoders of this worker remember of the texts of its task."""
    for table in _TABLES.values():
        if isinstance(table, Encoder):
            table.forget()


def _model(spark: SparkSession, path: str):
    ship_package(spark)
    bound_batches(spark)
    with open(path, "rb") as f:  # a file of the installed tokenizers, read on the driver
        return spark.sparkContext.broadcast(f.read())


def _lists(found: list[bytes]):
    """Ids in bytes, one entry a text, as an Arrow array of lists."""
    import numpy as np
    import pyarrow as pa

    offsets = np.cumsum([0] + [len(x) // 4 for x in found], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the token ids of ``text`` as array<int>.  A column of that name is replaced."""
    model = _model(df.sparkSession, path)

    def ids_of(texts):
        coder = table_of(Encoder, model.value)
        return _lists([coder.encode(t) if t else b"" for t in texts.to_pylist()])

    return df.withColumn(out, by_parts(ids_of, "array<int>", F.col(text), after=forget_words))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the token ids.  A column of that name is replaced."""
    model = _model(df.sparkSession, path)

    def text_of(lists):
        import numpy as np
        import pyarrow as pa

        coder = table_of(Decoder, model.value)
        values = lists.values.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        nulls = lists.is_null().to_pylist()
        return pa.array(["" if null else coder.decode(values[a:b].astype(np.int64))
                         for null, a, b in zip(nulls, offsets[:-1], offsets[1:])], pa.string())

    return df.withColumn(out, by_parts(text_of, "string", F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``ids`` as ``encode`` does and ``out`` as ``decode`` makes it from them.  One worker does both, so a task
    needs one and not two at a time, and the ids do not travel back to be decoded."""
    model = _model(df.sparkSession, path)

    def both_of(texts):
        import numpy as np
        import pyarrow as pa

        encoder, decoder = table_of(Encoder, model.value), table_of(Decoder, model.value)
        found = [encoder.encode(t) if t else b"" for t in texts.to_pylist()]
        decoded = pa.array([decoder.decode(np.frombuffer(x, np.int32).astype(np.int64)) for x in found], pa.string())
        return pa.StructArray.from_arrays([_lists(found), decoded], ["ids", "decoded"])

    coded = by_parts(both_of, "struct<ids:array<int>,decoded:string>", F.col(text), after=forget_words)
    return df.withColumn("__coded", coded).withColumns({ids: F.col("__coded.ids"), out: F.col("__coded.decoded")}).drop("__coded")
