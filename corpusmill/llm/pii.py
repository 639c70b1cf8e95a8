"""Personal data by weak supervision.

Fixed patterns give the base spans. Looser candidates (what the patterns just
miss, obfuscated addresses, credentials, names after a title) are voted on by
three kinds of labelers: shape rules, a gazetteer and the words around them.
Expectation-maximisation over the counts of all vote patterns in the corpus
estimates each labeler's reliability; a logistic classifier of the spans' own
looks (length, characters, entropy, what stands beside them), trained on the
resulting posteriors, decides which candidates are added. Base spans stay.

All texts are read whole, once to count votes and looks (a table whose size
does not depend on the corpus) and once to write spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "account", "contact", "secret", "name")
KINDS = BASE + ADDED

Span = tuple[str, int, int]

# Fixed patterns. Possessive runs match what greedy ones would, without going back.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates: kind and pattern. Those of the kinds account, contact and secret are shorter than REACH and are looked for near digits only.
DIGITS, REACH = re.compile(r"[0-9]+"), 80
AT = re.compile(r"[(\[{]at[)\]}]", re.I)
TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Herr ", "Frau ", "Señor ", "Señora ", "Madame ", "Monsieur ")
LOOSE = (
    ("address", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("account", re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![0-9A-Za-z.,-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])")),
    ("contact", re.compile(r"(?<![0-9A-Za-z+.,-])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[0-9]{3})[\x20./-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[a-z]_[0-9A-Za-z]{20,64}|sk-[0-9A-Za-z_-]{16,64}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")),
    ("name", re.compile(r"(?:(?<=Mr\. )|(?<=Mrs\. )|(?<=Ms\. )|(?<=Dr\. )|(?<=Herr )|(?<=Frau )|(?<=Señor )|(?<=Señora )|(?<=Madame )|(?<=Monsieur ))[^\W\d_a-z][^\W\d_]{1,30}(?: [^\W\d_a-z][^\W\d_]{1,30})?")),
)

#: Words of the gazetteer (prefixes of issuers, country codes, common given names) and of contexts, by kind.
GAZETTEER = {
    "account": ("DE", "FR", "ES", "IT", "NL", "GB", "CH", "AT", "BE", "PT", "4", "51", "52", "53", "54", "55", "34", "37", "6011"),
    "secret": ("AKIA", "ghp_", "gho_", "sk-"),
    "address": ("gmail", "mail", "example", "outlook", "yahoo", "hotmail", "proton", "web"),
    "contact": ("(", "0", "1", "555"),
    "name": ("Anna", "Maria", "Peter", "Paul", "Hans", "Jean", "Marie", "Juan", "Carlos", "John", "James", "Mary", "David", "Michael", "Laura", "Thomas"),
}
CONTEXT = {
    "address": re.compile(r"mail|contact|write|kontakt|correo|courriel|@", re.I),
    "account": re.compile(r"card|iban|account|konto|compte|cuenta|ssn|social|visa|credit|tarjeta|carte|pay", re.I),
    "contact": re.compile(r"phone|tel|call|mobile|fax|handy|numero|número|appel|llam|ruf", re.I),
    "secret": re.compile(r"token|key|secret|password|passw|bearer|auth|api|credential", re.I),
    "name": re.compile(r"name|dear|from|by|signed|von|par|por", re.I),
}
#: Characters looked at on either side of a candidate.
NEAR = 32
LABELERS = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, m.end() if m else 0))


def base_spans(text: str) -> list[Span]:
    """The base spans by kind and start. Matches that fail their test are dropped, and the search goes on after them."""
    out = list(emails(text)) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip("0")) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, to the next blanks; candidates of the kinds with digits lie inside one."""
    out: list[tuple[int, int]] = []
    for m in DIGITS.finditer(text):
        if out and m.start() - REACH <= out[-1][1]:
            if m.end() + REACH <= out[-1][1]:
                continue
            start = out.pop()[0]
        else:
            start = max(text.rfind(" ", 0, max(0, m.start() - REACH)), 0)
        end = text.find(" ", m.end() + REACH)
        out.append((start, len(text) if end < 0 else end))
    return out


def candidates(text: str, base: list[Span]) -> Iterator[tuple[Span, str]]:
    """Loose spans that meet no base span and no earlier candidate, with their votes and looks."""
    regions, taken = _regions(text), None
    for kind, pattern in LOOSE:
        if kind == "address":
            within = [(0, len(text))] if AT.search(text) else []
        elif kind == "name":
            within = [(0, len(text))] if any(t in text for t in TITLES) else []
        elif kind == "secret" and any(t in text for t in GAZETTEER["secret"]):
            within = [(0, len(text))]
        else:
            within = regions
        for lo, hi in within:
            for m in pattern.finditer(text, lo, hi):
                s, e = m.span()
                if taken is None:
                    taken = bytearray(len(text))
                    for _, x, y in base:
                        taken[x:y] = b"\1" * (y - x)
                if 1 in taken[s:e]:
                    continue
                taken[s:e] = b"\1" * (e - s)
                yield (kind, s, e), f"{kind}:{''.join(map(str, votes(kind, m[0], text, s, e)))}:{''.join(map(str, looks(m[0], text, s, e)))}"


def votes(kind: str, found: str, text: str, s: int, e: int) -> tuple[int, ...]:
    """Of the shape, gazetteer and context labelers: 1 personal, 0 not."""
    d = _digits(found)
    if kind == "account":
        shape = luhn(d) if 13 <= len(d) <= 19 and found[0].isdigit() else len(d) == 9 or _iban(found)
    elif kind == "contact":
        shape = 9 <= len(d) <= 15
    elif kind == "secret":
        shape = len(set(found)) >= 10 and any(c.isdigit() for c in found)
    elif kind == "address":
        shape = "." in found or "dot" in found.casefold()
    else:
        shape = True
    known = found.startswith(GAZETTEER[kind]) if kind != "address" else any(w in found.casefold() for w in GAZETTEER[kind])
    near = text[max(0, s - NEAR) : s] + " " + text[e : e + NEAR // 2]
    return int(shape), int(known), int(bool(CONTEXT[kind].search(near)))


#: How many values each look can take.
LOOKS = (4, 4, 2, 2, 3, 3, 2)


def looks(found: str, text: str, s: int, e: int) -> tuple[int, ...]:
    """What a span is like, whatever the labelers say: length, share of digits, upper and lower case, entropy, and what stands before and after it."""
    n, digits = len(found), len(_digits(found))
    size = 0 if n <= 12 else 1 if n <= 20 else 2 if n <= 34 else 3
    share = 3 if digits == n else 2 if 2 * digits >= n else 1 if digits else 0
    counts = Counter(found).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    before, after = text[max(0, s - 2) : s].strip(), text[e : e + 1]
    opened = 2 if before[-1:] in ("\"", "'", "=", ":", "(", "<") and before else 1 if before else 0
    return size, share, int(any(c.isupper() for c in found)), int(any(c.islower() for c in found)), 0 if entropy < 2.5 else 1 if entropy < 3.5 else 2, opened, int(after in ("", " ", "\n", ".", ",", ";", ")", "\"", "'", ">"))


def _iban(found: str) -> bool:
    s = found.replace(" ", "")
    return s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def estimate(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior of each vote pattern by expectation-maximisation.

    Two hidden classes; labelers are independent given the class, with a
    reliability for each labeler and kind, started at a majority vote and
    smoothed towards it.
    """
    out: dict[str, float] = {}
    for kind in ADDED:
        rows = [(tuple(map(int, p.split(":")[1])), n) for p, n in sorted(counts.items()) if p.startswith(kind + ":")]
        if not rows:
            continue
        v, n = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
        hit, false, prior = np.full(LABELERS, 0.8), np.full(LABELERS, 0.2), 0.5
        for _ in range(rounds):
            yes = prior * np.prod(np.where(v == 1, hit, 1 - hit), axis=1)
            no = (1 - prior) * np.prod(np.where(v == 1, false, 1 - false), axis=1)
            q = yes / (yes + no)
            weight = max(1.0, 0.1 * n.sum())  # the prior's weight keeps the classes from changing places
            hit = np.clip(((n * q) @ v + 0.8 * weight) / ((n * q).sum() + weight), 0.5, 0.99)  # no labeler is worse than chance
            false = np.clip(((n * (1 - q)) @ v + 0.2 * weight) / ((n * (1 - q)).sum() + weight), 0.01, 0.5)
            prior = ((n * q).sum() + 0.5 * weight) / (n.sum() + weight)
        out |= {f"{kind}:{''.join(str(int(x)) for x in r)}": float(p) for r, p in zip(v, q, strict=True)}
    return out


def _features(pattern: str) -> list[float]:
    """Of a kind and a span's looks; the votes are what the classifier learns from, not what it sees."""
    kind, _, seen = pattern.split(":")
    out = [1.0, *(float(kind == k) for k in ADDED)]
    for value, n in zip(map(int, seen), LOOKS, strict=True):
        out += [float(value == i) for i in range(n)]
    return out


def train(counts: dict[str, int]) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the votes' posteriors, a row for each pattern of votes and looks."""
    by_votes: Counter = Counter()
    for p, n in counts.items():
        by_votes[p.rsplit(":", 1)[0]] += n
    posterior, patterns = estimate(by_votes), sorted(counts)
    if not patterns:
        return np.zeros(1 + len(ADDED) + sum(LOOKS))
    x = np.array([_features(p) for p in patterns])
    y = np.array([posterior[p.rsplit(":", 1)[0]] for p in patterns])
    n = np.sqrt(np.array([counts[p] for p in patterns], float))
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(2000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 1.0 * (x.T @ (n * (p - y)) + 1e-3 * w)
    return w


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def vote_counts(docs: DataFrame) -> dict[str, int]:
    """Occurrences of every pattern of votes and looks in all texts: at most 5 kinds x 8 votes x 1,152 looks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()
        for b in batches:
            for t in b["text"]:
                if t:
                    n.update(p for _, p in candidates(t, base_spans(t)))
        yield pd.DataFrame(sorted(n.items()), columns=["pattern", "n"])

    rows = docs.select("text").mapInPandas(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in rows.collect()}


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans that aren't base ones).

    Null and empty texts have no spans. Offsets count code points; ends are
    exclusive. Repeated rows and null ids give a row each; extra columns are
    ignored; an empty table gives an empty result.
    """
    weights = train(vote_counts(docs))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accepted: dict[str, bool] = {}
        for b in batches:
            out = []
            for t in b["text"]:
                base = base_spans(t) if t else []
                n = Counter(k for k, _, _ in base)
                added = []
                for span, pattern in candidates(t, base) if t else ():
                    if pattern not in accepted:
                        accepted[pattern] = float(np.dot(weights, _features(pattern))) > 0
                    if accepted[pattern]:
                        added.append(span)
                out.append((*(n[k] for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            made = pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            made.insert(0, "doc_id", b["doc_id"].array)
            yield made

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, schema)


def redact(text: str, spans: str) -> str:
    """text with each listed span replaced by its kind in brackets; of spans that overlap the first counts."""
    parts = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e, k in parts:
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join([*out, text[at:]])
