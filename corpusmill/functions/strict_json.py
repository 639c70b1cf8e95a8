"""JSON that is what it says: no repeated keys, no numbers that aren't finite, one way to write it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is repeated")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} isn't a finite number")


def parse(text: str | bytes):
    """json.loads, but repeated keys, NaN and infinities are errors."""
    return json.loads(text, object_pairs_hook=_once, parse_constant=_no_constant)


def canonical(value, *, indent: int | None = None) -> str:
    """One text for equal values: sorted keys, arrays in order, no blanks unless indented."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False, indent=indent, separators=(",", ":") if indent is None else None)


def identity(text: str) -> str:
    """SHA-256 of a JSON text's canonical form, as for a tokenizer's file: its layout and the order of its keys don't matter."""
    return hashlib.sha256(canonical(parse(text)).encode()).hexdigest()


def sorted_counts(counts: Mapping[str, int]) -> str:
    return canonical(dict(counts))


def counts_column(keys: Column, values: Column) -> Column:
    """A map in order of its keys, from arrays."""
    return F.map_from_entries(F.array_sort(F.arrays_zip(keys, values)))


@F.pandas_udf(StringType())
def problem(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What is wrong with each JSON text; null if nothing is. Spark's own parsers keep one of two equal keys without a word."""

    def of(text: str | None) -> str | None:
        try:
            parse(text or "")
        except (ValueError, RecursionError) as e:
            return str(e) or "invalid"
        return None

    for s in parts:
        yield s.map(of).astype(object)
