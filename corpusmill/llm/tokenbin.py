"""Token ids in a compact file format: canonical, length-limited Huffman codes from global counts.

A file image holds whole documents in ascending order of doc_id: a header, the
code lengths (which define the canonical code), the documents' ids and token
counts, the bit offset of every block, and the code bits. Blocks of BLOCK ids
can be decoded independently; the reader decodes all blocks of an image in
step, one table look-up for each of them at a time.

Images are rows of a table, one file each, so that Spark's commit protocol
covers them: a task that is lost and run again leaves no half-written file.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import struct
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import common

#: Longest code in bits (more if there are more ids than such codes), ids of a block, ids encoded at a time, and ids after which an image is closed.
LIMIT, BLOCK, CHUNK, IMAGE = 16, 512, 1 << 18, 1 << 19
#: Words whose ids a Python worker keeps, which starts anew when full, and the longest word of them.
WORDS, KEY = 500_000, 64
MAGIC, HEAD = b"CMTB\x01\0\0\0", struct.Struct("<8sQQQQQ")
#: Special tokens, and white space on which the tokenizer and str.split may differ: such texts are encoded whole.
_ODD = "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x3000, 0xFEFF)))
_WHOLE, _ODD_ASCII = re.compile(rf"<\||[{_ODD}]").search, tuple(c for c in _ODD if c.isascii())
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def whole(text: str) -> bool:
    """True for texts that are encoded whole."""
    if text.isascii():
        return "<|" in text or any(c in text for c in _ODD_ASCII)
    return _WHOLE(text) is not None


# Codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (0 for ids that don't occur) of an optimal prefix code of at most `limit` bits, or as many as the number of ids takes, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = [int(x) for x in counts[used]]
    # Each level keeps, for every package in order of weight, how many single ids come before it.
    level, levels = weights, []
    for _ in range(limit - 1):
        packages = [level[i] + level[i + 1] for i in range(0, len(level) - 1, 2)]
        merged = list(heapq.merge(((w, 0) for w in weights), ((w, 1) for w in packages)))
        levels.append(np.cumsum([1 - kind for _, kind in merged]))
        level = [w for w, _ in merged]
    take = 2 * (len(used) - 1)
    depth = np.zeros(len(used), np.int64)
    for singles in reversed(levels):
        n = int(singles[take - 1]) if take else 0
        depth[:n] += 1
        take = 2 * (take - n)
    depth[:take] += 1
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - before
        before = n
        ids = np.flatnonzero(lengths == n)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


@functools.lru_cache(maxsize=2)
def decoding_table(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for as many bits to come as the longest code has."""
    n = np.frombuffer(lengths, np.uint8)
    most = int(n.max(initial=1))
    ids = np.flatnonzero(n)
    ids = ids[np.lexsort((ids, n[ids]))]
    repeats = 1 << (most - n[ids].astype(np.int64))
    symbols, width = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.int64)
    symbols[: repeats.sum()], width[: repeats.sum()] = np.repeat(ids, repeats), np.repeat(n[ids], repeats)
    return symbols, width


def _packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits, first bit first, in whole 32-bit words, and the bit offset of every block."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    starts = ends - width
    value = codes[ids] << (64 - (starts & 31) - width).astype(np.uint64)
    words = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
    at = starts >> 5
    first = np.flatnonzero(np.diff(at, prepend=-1))  # the codes' bits don't overlap, so sums join them
    words[at[first]] += np.add.reduceat(value >> np.uint64(32), first)
    words[at[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    n = -(-int(ends[-1]) // 32)
    return words[:n].astype(">u4").tobytes(), starts[::BLOCK]


def to_image(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """The file image of some documents. doc_ids: with NULL_ID for null."""
    parts, offsets, at = [], [], 0
    for i in range(0, len(ids), CHUNK):
        part, starts = _packed(ids[i : i + CHUNK], lengths, codes)
        parts.append(part)
        offsets.append(starts + 8 * at)
        at += len(part)
    table = zlib.compress(lengths.tobytes(), 6)
    blocks = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), len(table), at)
    return b"".join([head, table, doc_ids.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), blocks.astype("<u8").tobytes(), *parts])


def from_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, sizes and ids of a file image."""
    magic, n_docs, n_ids, n_blocks, n_table, n_bytes = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    symbols, width = decoding_table(zlib.decompress(image[at : at + n_table]))
    at, most = at + n_table, len(symbols).bit_length() - 1
    doc_ids = np.frombuffer(image, "<i8", n_docs, at)
    sizes = np.frombuffer(image, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    bits = np.frombuffer(image, "<u8", n_blocks, at + 16 * n_docs).astype(np.int64)
    words = np.frombuffer(image, ">u4", n_bytes // 4, at + 16 * n_docs + 8 * n_blocks).astype(np.uint64)
    words = np.concatenate([words, np.zeros(BLOCK * most // 32 + 2, np.uint64)])  # the last block runs on over padding
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.empty((BLOCK, n_blocks), np.uint32)
    for i in range(BLOCK):
        peek = (pairs[bits >> 5] >> (64 - most - (bits & 31)).astype(np.uint64)) & np.uint64((1 << most) - 1)
        out[i] = symbols[peek]
        bits = bits + width[peek]
    return doc_ids, sizes, out.T.reshape(-1)[:n_ids]


# Tokens


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Ids of words between blanks, by the tokenizer, as little-endian numbers of `kind`."""

    def __init__(self, tokenizer: Tokenizer, kind: str):
        self.tokenizer, self.model, self.alphabet = tokenizer, tokenizer.model, _byte_letters()
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        if sys.byteorder != "little":
            raise ValueError("ids are laid out by little-endian machines")

    def letters(self, word: str) -> bytes:
        """Of a word of letters: lower-case and composed ones need only the tokenizer's merges."""
        if word.isascii():
            word = word.lower()
        elif word == word.lower() and unicodedata.is_normalized("NFC", word):
            word = word.encode().decode("latin-1").translate(self.alphabet)
        else:
            return self.raw(word)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def raw(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        letters = word
        if not word.isalpha():
            letters = word.rstrip(PUNCTUATION)
        if letters == word and word.isascii():
            out = self.letters(word) if word.isalpha() else self.raw(word)
        elif not (letters.isalpha() and (letters.isascii() or letters.lower().isalpha())):  # a small İ is i and a dot above, which is no letter
            out = self.raw(word)
        elif letters == word:
            out = self.letters(word)
        else:  # the tokenizer parts letters from signs
            out = self[letters] + self[word[len(letters) :]]
        if len(word) <= KEY:
            if len(self) >= WORDS:
                self.clear()
            self[word] = out
        return out

    def text(self, text: str) -> bytes:
        if whole(text):
            return self.raw(text)
        return b"".join(map(self.__getitem__, (text.lower() if text.isascii() else text).split()))


@functools.cache
def word_ids(path: str, kind: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(Tokenizer.from_file(path), kind)


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian, 2 bytes each if the vocabulary allows, else 4), with end_id at each text's end.

    For tokenizers that part words at white space, lower-case, and part letters
    from signs, as the CLIP family does; null texts count as empty.
    """
    kind = id_kind(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, end = word_ids(path, kind), np.array([end_id], kind).tobytes()
        for b in batches:
            ids = pa.array([w.text(t or "") + end for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, ids binary")


def id_kind(path: str) -> str:
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


# Files

NULL_ID = -(2**63)


def write_images(tokens: DataFrame, kind: str) -> DataFrame:
    """(part, seq, n_docs, n_ids, image): the file images of (doc_id, ids), in ascending order of doc_id.

    Equal doc_ids are in order of their ids' bytes, null ones first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            total = np.pad(total, (0, max(0, len(got) - len(total))))
            total[: len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    sums = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary
    counts = np.zeros(int(sums["id"].max()) + 1 if len(sums) else 0, np.int64)
    counts[sums["id"]] = sums["n"]
    lengths = code_lengths(counts)
    codes = canonical(lengths)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, doc_ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        size = np.dtype(kind).itemsize

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), kind)
            image = to_image(np.array(doc_ids, np.int64), np.array([len(t) // size for t in texts]), ids, lengths, codes)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(texts)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "image": pa.array([image], pa.binary())})

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids.append(NULL_ID if d is None else d)
                texts.append(t)
                held += len(t) // size
                if held >= IMAGE:
                    yield close()
                    seq, doc_ids, texts, held = seq + 1, [], [], 0
        if texts:
            yield close()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return common.written(ordered.mapInArrow(images, "part int, seq int, n_docs long, n_ids long, image binary"), "token-files")


def read_images(files: DataFrame, *, digests: bool = False) -> DataFrame:
    """(doc_id, start, ids as little-endian unsigned 32-bit numbers) from file images; with digests (n_tokens, ids_crc32) in place of ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, sizes, ids = from_image(image.as_py())
                ends, data = np.cumsum(sizes), memoryview(ids.astype("<u4").tobytes())
                parts = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                out = {"doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), "start": pa.array(ends - sizes + base, pa.int64())}
                if digests:
                    out |= {"n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                else:
                    out["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" if digests else "doc_id long, start long, ids binary"
    return _with_base(files).select("base", "image").mapInArrow(rows, schema)


def _with_base(files: DataFrame) -> DataFrame:
    """files with base: the ids of all images before. Parts are ranges, so sums over them are few; within one, images are in order."""
    from pyspark.sql import Window

    spark = files.sparkSession
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition
    before = np.cumsum([0, *(r["n"] for r in parts)]).tolist()
    offsets = spark.createDataFrame([(r["part"], n) for r, n in zip(parts, before, strict=False)], "part int, offset long")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.select("part", "seq", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    sums = sums.join(F.broadcast(offsets), "part").select("part", "seq", (F.col("offset") + F.col("inside")).alias("base"))
    return files.join(sums, ["part", "seq"])


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the documents' ids as files and reads them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone. Repeated rows are kept, one
    after the other; rows with a null id come first, under a null doc_id. Extra
    columns are ignored; an empty table gives an empty result.
    """
    tokens = common.written(tokenized(docs, path, end_id), "tokens")
    return read_images(write_images(tokens, id_kind(path)), digests=True)
