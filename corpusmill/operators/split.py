"""Leakage-free assignment of records to train, validation and test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates this split's hash from other uses of the same anchors.
DOMAIN = "corpusmill-split-v1"


def unit_rank(anchor: Column, seed: int, domain: str = DOMAIN) -> Column:
    """53 uniform bits in [0, 1): SHA-256 over the domain, a NUL, the seed (8 bytes, little-endian) and the anchor."""
    head = domain.encode() + b"\0" + (seed % 2**64).to_bytes(8, "little")
    digest = F.sha2(F.concat(F.lit(bytearray(head)), F.encode(anchor, "UTF-8")), 256)
    bits = F.shiftright(F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint"), 3)
    return bits.cast("double") / F.lit(float(2**53))


def partition_of(anchor: Column, seed: int, train: float, validation: float, domain: str = DOMAIN) -> Column:
    rank = unit_rank(anchor, seed, domain)
    return F.when(rank < train, "train").when(rank < train + validation, "validation").otherwise("test")
