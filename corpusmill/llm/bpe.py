"""Byte-level BPE encoding and decoding with a given rank file.

Text is cut by a pattern into pieces; each piece's UTF-8 bytes are read as
Latin-1, so that an Aho-Corasick automaton of the vocabulary finds every token
at every position. The encoder then walks from left to right, taking the
longest token that forms a compatible pair with the one before it (a pair is
compatible if BPE on the two tokens' joined bytes gives back those two tokens;
answers are memoised), and steps back to shorter tokens where the walk gets
stuck. Each position is given up at most once, so time is linear in the piece.
The result is the one that BPE merges give.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import hashlib
import re
import threading
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the memos of a Python worker, which are emptied when full, and the longest text that is a key.
PIECES, PAIRS, KEY = 400_000, 400_000, 64
#: Seconds after its last use that a Python worker keeps a codec. Workers outlive the stage that started them, and an idle one would keep its memory from the next.
KEPT_S = 10
WIDE = re.compile(r"\s\s\s").search
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Memo(dict):
    """A dict that fills itself and starts anew at its bound."""

    def __init__(self, make, bound: int):
        self.make, self.bound = make, bound

    def __missing__(self, key):
        value = self.make(key)
        if not isinstance(key, str) or len(key) <= KEY:
            if len(self) >= self.bound:
                self.clear()
            self[key] = value
        return value


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank table and one cutting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack single bytes, so not every text can be encoded")
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.width, self.shorter = {}, {}
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, i))
            self.width[i] = len(t)
            self.shorter[i] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None)
        self.automaton.make_automaton()
        self.made_of: dict[int, tuple[int, int]] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            for n in range(1, len(t)):
                left, right = ranks.get(t[:n], i), ranks.get(t[n:], i)
                if (left < i or n == 1) and (right < i or n == len(t) - 1) and self._apart((left, right), i):
                    self.made_of[i] = left, right
                    break
        self.compatible = Memo(self._apart, PAIRS)
        self.pieces = Memo(self._piece, PIECES)
        self.later_words = Memo(lambda word: b"".join(map(self.pieces.__getitem__, self.find(" " + word))), PIECES)
        table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.widths = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def _apart(self, pair: tuple[int, int], before: int = 1 << 60) -> bool:
        """True if merging the bytes of two tokens, with ranks under `before`, gives back these two tokens.

        The merges on either side of the boundary are undone, latest first. In
        each state the two tokens at the boundary would have merged with each
        other if their joined rank comes before the merge that was undone last
        (or at the same rank, where that merge was to the right).
        """
        left, right = pair
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                return False
            at_left, at_right = left if left in self.made_of else -1, right if right in self.made_of else -1
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                before, left = left, self.made_of[left][1]
            else:
                before, right = right + 1, self.made_of[right][0]

    def walk(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest = [0] * len(piece)
        for end, (n, i) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n] = i  # of those that start here the last found is the longest
        compatible, width, shorter = self.compatible, self.width, self.shorter
        out: list[int] = []
        closed = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else None
            while token is not None:
                end = at + width[token]
                if not closed[end] and (last is None or compatible[last, token]):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
            else:  # nothing fits here: this position is closed, and the token before it gets shorter
                closed[at] = 1
                last = out.pop()
                at -= width[last]
                token = shorter[last]

    def _piece(self, piece: str) -> bytes:
        return array("I", self.walk(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No piece of the usual patterns reaches over a blank but one that begins
        with it or one of white space on both its sides, so texts without
        three white-space characters in a row are taken word by word.
        """
        if WIDE(text) or not text:
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        first, *later = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, self.find(first))) + b"".join(map(self.later_words.__getitem__, later))

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4")
        widths = self.widths[i]
        ends = np.cumsum(widths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[i] - ends + widths, widths)].tobytes()


class Held:
    """What the tasks of a Python worker make once and share, let go when none has used it for KEPT_S."""

    def __init__(self, make):
        self.make, self.made, self.users, self.lock, self.timer = make, {}, 0, threading.RLock(), None

    @contextlib.contextmanager
    def use(self, *key):
        with self.lock:
            if self.timer:
                self.timer.cancel()
            if key not in self.made:
                self.made[key] = self.make(*key)
            self.users += 1
            value = self.made[key]
        try:
            yield value
        finally:
            del value
            with self.lock:
                self.users -= 1
                if not self.users:
                    self.timer = threading.Timer(KEPT_S, self.let_go)
                    self.timer.daemon = True
                    self.timer.start()

    def let_go(self) -> None:
        with self.lock:
            if self.users or threading.current_thread() is not self.timer:  # used meanwhile: a later timer ends it
                return
            self.made.clear()
            gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)


_codecs = Held(lambda path, pattern: Codec(load_ranks(path), pattern))


def codec(path: str, pattern: str):
    """A context with the worker's codec, which all its tasks use while they follow each other."""
    return _codecs.use(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with the column ids (array<int>); null texts count as empty. Each row gives one row.

    path: a rank file that every executor can read, such as one of an installed package.
    """

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with codec(path, pattern) as c:
            for s in parts:
                yield pd.Series([np.frombuffer(c.encode(t or ""), "<i4") for t in s], dtype=object)

    return docs.withColumn("ids", ids(F.col("text")))


def decoded(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df with the column text, made anew from ids; bytes that aren't UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with codec(path, pattern) as c:
            for s in parts:
                yield s.map(lambda x: c.decode(np.asarray(() if x is None else x, "<u4").tobytes()).decode("utf-8", "replace"))

    return df.withColumn("text", text(F.col("ids")))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids, and SHA-256 of the bytes decoded from them.

    Null texts count as empty (0 tokens, digests of no bytes). Texts are
    encoded whole; repeated rows and null ids pass through; extra columns are
    ignored; an empty table gives an empty result.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with codec(path, pattern) as c:
            for b in batches:
                out = []
                for t in b["text"]:
                    ids = c.encode(t or "")
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
                made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                made.insert(0, "doc_id", b["doc_id"].array)
                yield made

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, SCHEMA)
