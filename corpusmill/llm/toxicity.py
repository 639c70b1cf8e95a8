"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lowers case, strips accents and full-width forms, maps look-alike
letters and digit or sign substitutions to one skeleton letter, and turns all
else into blanks, so that "1D10T", "idiot" and the Cyrillic look-alike meet.
The lexicon (words, and beginnings that several of them share), its weights, and exception phrases in
which an entry doesn't count are learned from a bounded sample of labelled
rows; scoring reads every whole text.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common

#: Labelled rows that the fit reads at most, and entries of the lexicon at most.
SAMPLE, LEXICON = 20_000, 600
#: Documents with label 1 that an entry needs, and contexts that an exception phrase needs; what a document still counts once an entry explains it.
SUPPORT, KEPT = 5, 0.3
#: Lengths of the word beginnings that may become entries, and words that must have one.
PREFIXES, FAMILY = (4, 5, 6, 7), 3

#: Letters of other scripts, and digits, by the Latin letter they stand for.
LOOKALIKES = {
    "a": "аαɑ4@", "b": "ьβ8", "c": "сϲ", "d": "ԁ", "e": "еεє3", "g": "ɡ9", "h": "һ", "i": "іιıl1|ӏ!",
    "j": "ј", "k": "кκ", "m": "м", "n": "пη", "o": "оοσ0", "p": "рρ", "s": "ѕ5$", "t": "тτ7",
    "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "2",
}
SKELETON = {other: letter for letter, others in LOOKALIKES.items() for other in others}
#: Signs that stand for letters only between letters.
INNER = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")


class _Table(dict):
    """For str.translate: made a character at a time, as they are met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).casefold():
            if c.isalnum():
                out += SKELETON.get(c, c)
            elif not unicodedata.combining(c):
                out += " "
        self[code] = out
        return out


_table = _Table({ord(c): " " for c in "@$!|"})


def fold(text: str) -> str:
    """The skeleton of a text, with a blank at both ends. Lone joining marks vanish."""
    if INNER.search(text):
        text = INNER.sub(lambda m: SKELETON[m[0]], text)
    return f" {text.translate(_table)} "


@dataclass(frozen=True)
class Lexicon:
    """entries: anchored skeletons (" word " or " beginning") and weights; exceptions: phrases of skeleton words."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    bias: float = -4.0
    slope: float = 1.0
    power: float = 0.0

    def score(self, total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        x = self.bias + self.slope * total / np.maximum(n_words, 1) ** self.power
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Matcher:
    def __init__(self, entries: tuple[str, ...], exceptions: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for k, e in enumerate(entries):
            self.automaton.add_word(e, (len(e), k))
        for e in exceptions:
            self.automaton.add_word(f" {e} ", (len(e) + 2, -1))
        self.any = bool(entries or exceptions)
        if self.any:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int]]:
        """(start, entry) of matches outside exception phrases; of the entries that begin at one word the longest counts."""
        if not self.any:
            return []
        best: dict[int, tuple[int, int]] = {}
        spans = []
        for end, (n, k) in self.automaton.iter(folded):
            start = end - n + 1
            if k < 0:
                spans.append((start, end))
            elif n > best.get(start, (0, 0))[0]:
                best[start] = n, k
        if not spans:
            return [(s, k) for s, (_, k) in best.items()]
        spans.sort()
        starts, far, reach = [a for a, _ in spans], 0, []
        for _, b in spans:
            far = max(far, b)
            reach.append(far)
        return [(s, k) for s, (n, k) in best.items() if (at := bisect.bisect_right(starts, s)) == 0 or reach[at - 1] < s + n - 1]


@functools.lru_cache(maxsize=4)
def matcher(entries: tuple[str, ...], exceptions: tuple[str, ...]) -> Matcher:
    return Matcher(entries, exceptions)


def _entries_of(folded: str) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in PREFIXES:
        out.update(" " + w[:n] for w in words if len(w) > n)
    return out


def _candidates(sample: DataFrame) -> list[str]:
    """The most telling entries, at most 8 LEXICON of them. A beginning must be that of several words that are telling themselves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, other = Counter(), Counter()
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                (toxic if y else other).update(_entries_of(fold(text)))
        yield pd.DataFrame([(e, toxic[e], other[e]) for e in toxic.keys() | other.keys()], columns=["entry", "pos", "neg"])

    sums = sample.mapInPandas(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = common.written(sums.where("pos > neg"), "entries")
    words = sums.where(F.col("entry").endswith(" ") & (F.col("pos") >= 2)).select(F.rtrim("entry").alias("word"))
    beginnings = words.select(F.explode(F.array(*[F.when(F.length("word") > n + 1, F.substring("word", 1, n + 1)) for n in PREFIXES])).alias("entry"))
    beginnings = beginnings.where("entry is not null").groupBy("entry").count().where(F.col("count") >= FAMILY).select("entry")
    telling = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5)) * F.log1p("pos")
    allowed = sums.where(F.col("entry").endswith(" ")).unionByName(sums.where(~F.col("entry").endswith(" ")).join(beginnings, "entry", "left_semi"))
    return [r["entry"] for r in allowed.where(F.col("pos") >= SUPPORT).orderBy(telling.desc(), "entry").limit(8 * LEXICON).collect()]


def covering(entries: list[str], found: list[list[int]], y: list[int], ratio: float) -> list[str]:
    """Entries that explain the documents with label 1 one after the other.

    found: per document the entries in it. The most telling entry is taken,
    and its documents count for KEPT of what they did from then on, until none
    is left with SUPPORT and odds over `ratio`. So a word that only goes along
    with a telling one, in copies of a text say, isn't taken for its sake, but
    one that is in many texts is.
    """
    places: list[list[int]] = [[] for _ in entries]
    n = np.zeros((len(entries), 2))
    for d, ks in enumerate(found):
        for k in ks:
            places[k].append(d)
            n[k, y[d]] += 1

    def telling(k: int) -> tuple:
        """Smallest first; of equals a whole word, then the first by letters."""
        pos, neg = max(n[k, 1], 0.0), max(n[k, 0], 0.0)
        return round(-math.log((pos + 0.5) / (neg + 0.5)) * math.log1p(pos), 9), entries[k][-1] != " ", entries[k]

    def good(k: int) -> bool:
        return n[k, 1] >= SUPPORT and (n[k, 1] + 0.5) / (n[k, 0] + 0.5) > ratio

    queue, out, weight = [(telling(k), k) for k in range(len(entries)) if good(k)], [], [1.0] * len(found)
    heapq.heapify(queue)
    while queue and len(out) < LEXICON:
        rank, k = heapq.heappop(queue)
        if not good(k):
            continue
        if rank != telling(k):  # fewer documents are left to it by now
            heapq.heappush(queue, (telling(k), k))
            continue
        out.append(entries[k])
        for d in places[k]:
            lost = weight[d] * (1 - KEPT)
            weight[d] -= lost
            for other in found[d]:
                n[other, y[d]] -= lost
    return out


def _lexicon(sample: DataFrame, ratio: float) -> tuple[str, ...]:
    entries = _candidates(sample)
    number = {e: i for i, e in enumerate(entries)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted(number[e] for e in _entries_of(fold(t)) & number.keys()) for t in b["text"]]
            yield pd.DataFrame({"found": found, "y": b["y"]})

    rows = sample.mapInPandas(present, "found array<int>, y int").toPandas()  # bound rows of numbers
    rows = sorted(zip(map(list, rows["found"]), rows["y"], strict=True))
    return tuple(covering(entries, [f for f, _ in rows], [int(v) for _, v in rows], ratio))


def _contexts(folded: str, hits: list[tuple[int, int]]) -> Iterator[str]:
    """The word pairs around each hit."""
    for start, _ in hits:
        before, word = folded[:start].rsplit(" ", 1)[-1], folded[start + 1 :].split(" ", 2)
        if before:
            yield f"{before} {word[0]}"
        if len(word) > 1 and word[1]:
            yield f"{word[0]} {word[1]}"


def _exceptions(sample: DataFrame, entries: tuple[str, ...], share: float) -> tuple[str, ...]:
    """Word pairs with an entry in which label 1 is rarer than among all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, other, m = Counter(), Counter(), matcher(entries, ())
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                f = fold(text)
                (toxic if y else other).update(set(_contexts(f, m.hits(f))))
        yield pd.DataFrame([(e, toxic[e], other[e]) for e in toxic.keys() | other.keys()], columns=["phrase", "pos", "neg"])

    sums = sample.mapInPandas(count, "phrase string, pos long, neg long").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    few = sums.where((F.col("neg") >= SUPPORT) & (F.col("pos") <= share * F.col("neg")))
    return tuple(sorted(r["phrase"] for r in few.orderBy(F.desc("neg"), "phrase").limit(LEXICON).collect()))


def _fit_weights(counts: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, np.ndarray]:
    """Non-negative logistic weights with a small L2 penalty."""
    n, k = counts.shape
    x = np.minimum(counts, 2.0)
    step = 4 * n / (np.linalg.norm(np.column_stack([x, np.ones(n)]), 2) ** 2 + 1e-9)
    w = z = np.append(np.zeros(k), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    momentum = 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(x @ z[:-1] + z[-1], -30, 30))) - y) / n
        new = z - step * np.append(x.T @ error + 1e-5 * z[:-1], error.sum())
        new[:-1] = np.maximum(new[:-1], 0)
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return float(w[-1]), w[:-1]


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon for label `toxic` from at most `bound` labelled rows outside the held-out fifth.

    exceptions: phrases that never count, besides the learned ones. Without
    rows of both labels the lexicon is empty and the score a constant.
    """
    sample = common.written(common.labelled_sample(docs, labels, "toxic", bound), "toxic-sample")
    pos, n = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    share = (pos + 1) / (n + 2)
    empty = Lexicon((), (), math.log(share / (1 - share)))
    if not pos or pos == n:
        return empty
    entries = _lexicon(sample, 3 * share / (1 - share))
    if not entries:
        return empty
    given = tuple(" ".join(fold(e).split()) for e in exceptions)
    phrases = tuple(sorted({*given, *_exceptions(sample, entries, share)}))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = matcher(entries, phrases)
        for b in batches:
            out = []
            for text, y in zip(b["text"], b["y"], strict=True):
                f = fold(text)
                out.append(([k for _, k in m.hits(f)], len(f.split()), y))
            yield pd.DataFrame(out, columns=["hits", "n_words", "y"])

    rows = sample.mapInPandas(match, "hits array<int>, n_words long, y int").toPandas()  # bound rows of numbers
    rows = rows.assign(hits=[tuple(sorted(h)) for h in rows["hits"]]).sort_values(["n_words", "y", "hits"])
    counts = np.zeros((len(rows), len(entries)))
    for i, found in enumerate(rows["hits"]):
        np.add.at(counts[i], list(found), 1)
    y, words = rows["y"].to_numpy(np.float64), rows["n_words"].to_numpy(np.float64)
    _, weights = _fit_weights(counts, y)
    found = Lexicon(tuple((e, float(w)) for e, w in zip(entries, weights, strict=True) if w > 0.05), phrases)
    total = np.minimum(counts, 2.0) @ np.where(weights > 0.05, weights, 0)
    best = None
    for power in (0.0, 0.1, 0.25, 0.5):
        x = (total / np.maximum(words, 1) ** power)[:, None]
        scale = x.max() or 1.0
        b, w = _fit_weights(np.minimum(x / scale, 1.0) * 2, y, 800)
        p = np.clip(1 / (1 + np.exp(-np.clip(b + w[0] * np.minimum(x[:, 0] / scale, 1.0) * 2, -30, 30))), 1e-6, 1 - 1e-6)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if best is None or loss < best[0] - 1e-6:
            best = loss, power, b, float(w[0]) * 2 / scale
    return Lexicon(found.entries, phrases, best[2], best[3], best[1])


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with the column score. An entry counts twice in a text at most; null and empty texts have no hits."""
    entries, weights = tuple(e for e, _ in lexicon.entries), np.array([w for _, w in lexicon.entries] or [0.0])

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(entries, lexicon.exceptions)
        for s in parts:
            total, words = np.zeros(len(s)), np.zeros(len(s))
            for i, t in enumerate(s):
                f = fold(t or "")
                words[i] = f.count(" ") - 1
                if found := m.hits(f):
                    for k, n in Counter(k for _, k in found).items():
                        total[i] += weights[k] * min(n, 2)
                    words[i] = len(f.split())
            yield pd.Series(lexicon.score(total, words))

    return docs.withColumn("score", score(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts score as texts without hits. Repeated rows give
    repeated results; a null doc_id is held out under crc32 of "". Extra
    columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    out = scored(docs, fit(docs, labels, bound))
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
