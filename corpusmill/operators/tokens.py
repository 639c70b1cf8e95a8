"""Tokenizers: training, checked encoding, coverage, and conversations on the wire.

Tokenizers are objects of the public `tokenizers` library. They travel to the
workers as JSON, and texts are encoded in Arrow batches.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The roles of a conversation, in the order of their control tokens, which the end of a turn follows.
ROLES = ("system", "user", "assistant")
CONTROLS = ("<|v1_system|>", "<|v1_user|>", "<|v1_assistant|>", "<|v1_end_turn|>")
#: The pattern that cuts a text into pieces before merges, as byte-level tokenizers do.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes are themselves, the others letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


def pieces(docs: DataFrame) -> DataFrame:
    """(piece, n): how often each piece occurs in the texts."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({PIECE})"), F.lit(1))).alias("piece"))
    return found.groupBy("piece").agg(F.count("*").alias("n"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """(first, second, n): how often two bytes stand side by side in a piece, from distinct pieces and their counts."""
    codes = F.transform(F.split(F.hex(F.encode("piece", "UTF-8")), "(?<=\\G..)(?=.)"), lambda h: F.conv(h, 16, 10).cast("int"))
    rows = pieces(docs).select("n", codes.alias("b")).where("size(b) > 1")
    rows = rows.select("n", F.explode(F.arrays_zip(F.expr("slice(b, 1, size(b) - 1)").alias("first"), F.expr("slice(b, 2, size(b) - 1)").alias("second"))).alias("p"))
    return rows.groupBy("p.first", "p.second").agg(F.sum("n").alias("n"))


def learned_merges(counts: dict[str, int], merges: int, least: int = 1) -> list[tuple[str, str]]:
    """The merges of byte-pair encoding over pieces in byte letters: the commonest pair first, the smaller one on ties.

    Pairs' counts and places are kept up to date, so a merge costs as much as
    the pieces that it changes.
    """
    words = [(list(w), n) for w, n in sorted(counts.items())]
    pairs: Counter = Counter()
    places: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, (w, n) in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            pairs[p] += n
            places[p].add(i)
    queue, out = [(-n, p) for p, n in pairs.items()], []
    heapq.heapify(queue)
    while queue and len(out) < merges:
        n, pair = heapq.heappop(queue)
        if -n != pairs[pair]:  # has changed since
            if pairs[pair] > 0:
                heapq.heappush(queue, (-pairs[pair], pair))
            continue
        if -n < max(1, least):
            break
        out.append(pair)
        changed = set()
        for i in places.pop(pair):
            w, count = words[i]
            new, k = [], 0
            while k < len(w):
                whole = k + 1 < len(w) and (w[k], w[k + 1]) == pair
                new.append(w[k] + w[k + 1] if whole else w[k])
                k += 2 if whole else 1
            for p in zip(w, w[1:], strict=False):
                pairs[p] -= count
                changed.add(p)
            for p in zip(new, new[1:], strict=False):
                pairs[p] += count
                places[p].add(i)
                changed.add(p)
            words[i] = new, count
        for p in changed:
            if pairs[p] > 0 and p != pair:
                heapq.heappush(queue, (-pairs[p], p))
    return out


def train(docs: DataFrame, vocabulary: int, least: int = 1, controls: tuple[str, ...] = ()) -> str:
    """JSON of a byte-level BPE tokenizer learned from (text): 256 bytes, merges of pairs that occur `least` times, then the controls as special tokens.

    Spark counts the pieces of all texts; the driver holds distinct pieces,
    not texts, and learns the merges.
    """
    if vocabulary - len(controls) < 256 or least < 1:
        raise ValueError("a vocabulary has the 256 bytes and its controls at least, and a least count of 1")
    letters = byte_letters()
    rows = pieces(docs.where(F.col("text").rlike(r"\S"))).toPandas()  # a row for each distinct piece
    if rows.empty:
        raise ValueError("no text to learn from")
    counts = {"".join(letters[b] for b in p.encode()): int(n) for p, n in zip(rows["piece"], rows["n"], strict=True)}
    vocab = {c: i for i, c in enumerate(sorted(letters.values()))}
    merges = []
    for a, b in learned_merges(counts, vocabulary - len(controls) - 256, least):
        merges.append([a, b])
        vocab.setdefault(a + b, len(vocab))
    if clash := set(controls) & set(vocab):
        raise ValueError(f"learned what is kept for control: {sorted(clash)}")
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    added = [{"id": len(vocab) + i, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, c in enumerate(controls)]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}, ensure_ascii=False)


@functools.lru_cache(maxsize=4)
def loaded(text: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def encoded(docs: DataFrame, tokenizer: str, *, checked: bool = True) -> DataFrame:
    """docs with tokens (array<int>) of text. checked: no truncation, padding, overflow, or text without a token; such texts are an error."""
    settings = json.loads(tokenizer)
    if checked and (settings.get("truncation") or settings.get("padding")):
        raise ValueError("this tokenizer cuts or pads")

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = loaded(tokenizer)
        for s in parts:
            out = t.encode_batch(["" if x is None else x for x in s], add_special_tokens=False)
            if checked and any(e.overflowing or (x or "").strip() and not e.ids for x, e in zip(s, out, strict=True)):
                raise ValueError("a text has no tokens, or more than it may have")
            yield pd.Series([e.ids for e in out], dtype=object)

    return docs.withColumn("tokens", ids(F.col("text")))


def decoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs with text of tokens; special tokens are shown."""

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = loaded(tokenizer)
        for s in parts:
            yield pd.Series(t.decode_batch([[] if x is None else list(x) for x in s], skip_special_tokens=False), dtype=object)

    return docs.withColumn("text", texts(F.col("tokens")))


def vocabulary(spark, tokenizer: str) -> DataFrame:
    """(token, id) of all tokens, added ones too."""
    return spark.createDataFrame(sorted(loaded(tokenizer).get_vocab(with_added_tokens=True).items(), key=lambda x: x[1]), "token string, id int")


def coverage(rows: DataFrame, unknown_id: int | None) -> DataFrame:
    """rows (tokens, ...) with token_count, unknown_count and unknown_rate, which is null without tokens."""
    n = F.size("tokens")
    bad = F.size(F.filter("tokens", lambda x: x == unknown_id)) if unknown_id is not None else F.lit(0)
    return rows.withColumns({"token_count": n, "unknown_count": bad, "unknown_rate": F.when(n > 0, bad / n)})


def control_ids(tokenizer: str, controls: tuple[str, ...] = CONTROLS) -> list[int]:
    """Ids of the controls, which must be special tokens of a tokenizer that neither cuts, pads nor changes texts."""
    settings = json.loads(tokenizer)
    if any(settings.get(k) for k in ("truncation", "padding", "normalizer", "post_processor")):
        raise ValueError("a chat tokenizer has no truncation, padding, normalizer or post-processor")
    known = {a["content"]: a for a in settings.get("added_tokens", [])}
    for c in controls:
        a = known.get(c)
        if not a or not a["special"] or any(a[k] for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError(f"{c} isn't a plain special token")
    ids = [known[c]["id"] for c in controls]
    if len(set(ids)) < len(ids):
        raise ValueError("controls need ids of their own")
    return ids


def wire(chats: DataFrame, tokenizer: str, *, prompt: bool = False, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """chats (messages: array<struct<role, content>>, ...) with ids and mask.

    A message is its role's id, its content's ids, and the end of turn. mask:
    of each id after the first, true for an assistant's contents and their
    ends. Control text in a content is plain text; a content that can't be
    decoded again is an error, as is a turn out of order. prompt: the last
    message is a user's, and the assistant's id follows.
    """
    special = control_ids(tokenizer, controls)
    roles, end = dict(zip(ROLES, special, strict=False)), special[3]

    def one(t, messages) -> tuple[list[int], list[bool]]:
        turns = [m["role"] for m in messages]
        turns = turns[1:] if turns[:1] == ["system"] else turns
        last = "user" if prompt else "assistant"
        if not turns or turns != [("user", "assistant")[i % 2] for i in range(len(turns))] or turns[-1] != last:
            raise ValueError(f"turns out of order: {turns}")
        ids, learned = [], []
        for m in messages:
            content = t.encode(m["content"], add_special_tokens=False).ids
            if set(content) & set(special) or t.decode(content, skip_special_tokens=False) != m["content"]:
                raise ValueError("a content doesn't survive encoding")
            own = m["role"] == "assistant"
            ids += [roles[m["role"]], *content, end]
            learned += [False, *[own] * (len(content) + 1)]
        if prompt:
            ids.append(roles["assistant"])
            learned.append(False)
        return ids, learned[1:]

    @F.pandas_udf("ids array<int>, mask array<boolean>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = loaded(tokenizer)
        t.encode_special_tokens = True
        for s in parts:
            out = [one(t, m) for m in s]
            yield pd.DataFrame({"ids": [i for i, _ in out], "mask": [k for _, k in out]})

    return chats.withColumn("_wire", encode(F.col("messages"))).select("*", "_wire.ids", "_wire.mask").drop("_wire")
