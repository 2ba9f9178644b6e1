"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

The rows, in a total order, are numbered 0 to n-1. A balanced Feistel network permutes the
smallest even-bit domain holding n; numbers that land outside [0, n) walk the cycle until
they are inside, which keeps it a permutation of [0, n). Place p goes to shard
``p mod shards``, slot ``p div shards``: shard sizes differ by one row at most, slots have
no gaps, and both can be computed from the row number alone, or inverted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import number_rows, stable

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class FeistelPermutation:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            base = np.uint64(seed % 2**64) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            self.keys = _mix(base)

    def _pass(self, value: np.ndarray, keys: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = value >> self.half, value & self.mask
        if inverse:
            left, right = right, left
        with np.errstate(over="ignore"):
            for key in keys:
                left, right = right, left ^ (_mix(right + key) & self.mask)
        if inverse:
            left, right = right, left
        return (left << self.half) | right

    def _walk(self, index, keys: np.ndarray, inverse: bool) -> np.ndarray:
        out = self._pass(np.atleast_1d(np.asarray(index, dtype=np.uint64)), keys, inverse)
        while (outside := out >= self.n).any():
            out[outside] = self._pass(out[outside], keys, inverse)
        return out.astype(np.int64).reshape(np.shape(index))

    def place(self, row) -> np.ndarray:
        """Where each row number goes."""
        return self._walk(row, self.keys, False)

    def row(self, place) -> np.ndarray:
        """Which row number stands at each place."""
        return self._walk(place, self.keys[::-1], True)


def locate(row, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers, without any data."""
    place = FeistelPermutation(n, seed).place(row)
    return place % shards, place // shards


def row_at(shard, slot, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The row number that stands at a shard and slot."""
    return FeistelPermutation(n, seed).row(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Every row of ``docs`` as (id, size, text_crc32, row, shard, slot).

    Rows are ordered by id, then by text checksum and size, so the result doesn't depend on
    files or partitions. Null ids come first; null text counts as empty (size 1, checksum
    0); repeated rows keep a place each; other columns of ``docs`` are not read. An empty
    table gives no rows. Texts themselves are never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered, n = number_rows(stable(small), "id", "text_crc32", "size")

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(FeistelPermutation(n, seed).place(row.to_numpy()))

    at = numbered.withColumn("_place", place("row"))
    return at.select(
        "id", "size", "text_crc32", "row",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {int(shards)}").alias("slot"),
    )
