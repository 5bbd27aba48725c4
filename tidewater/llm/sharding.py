"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Every row gets a global row number (its rank by id), a keyed permutation of
``0..n-1`` turns that into a place, and shard and slot follow by division. Law:
``rows`` - shard sizes differ by one row at most. The permutation is a function of
``(row number, n, seed)`` alone, so a shard or a slot can be computed or inverted
without reading any data.

Nulls: a null text has no bytes, a null id sorts first. Rows that agree in all
columns returned are interchangeable. An empty table gives an empty result. Of a text only its
length and checksum are kept, whatever its length. Columns other than id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Fixed values of the round function: multipliers below 2**31 and the prime 2**31 - 1.
PRIME = 2147483647
ROUND_A = (1103515245, 1664525001, 214013269, 1140671485)
ROUND_B = (69621037, 48271111, 16807253, 630360016)


def halves(n: int) -> tuple[int, int]:
    """Sides ``a * b >= n`` of the smallest near-square box around ``n`` rows."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    t = ((x % PRIME) * ROUND_A[k] + seed % PRIME + k) % PRIME
    t ^= t >> 15
    t = (t * ROUND_B[k]) % PRIME
    return t ^ (t >> 13)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number: a bijection of ``0..n-1``.

    The Feistel network works on ``a * b >= n`` values; whoever leaves ``0..n-1``
    walks on along its cycle until it is back (fewer than ``sqrt(n)`` values lie outside).
    """
    a, b = halves(n)

    def once(v):
        left, right = v // b, v % b
        for k in range(0, 4, 2):
            left = (left + _round(right, k, seed)) % a
            right = (right + _round(left, k + 1, seed)) % b
        return left * b + right

    out = once(rows.astype(np.int64))
    while (away := np.flatnonzero(out >= n)).size:
        out[away] = once(out[away])
    return out


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number at each place: the inverse of :func:`permute`."""
    a, b = halves(n)

    def once(v):
        left, right = v // b, v % b
        for k in (2, 0):
            right = (right - _round(left, k + 1, seed)) % b
            left = (left - _round(right, k, seed)) % a
        return left * b + right

    out = once(places.astype(np.int64))
    while (away := np.flatnonzero(out >= n)).size:
        out[away] = once(out[away])
    return out


def number_rows(df: DataFrame, keys: list[str], into: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Number rows from 0 by ``keys`` without bringing them to one task.

    Rows are dealt by range, numbered inside a partition, and shifted by the rows of the
    partitions before; only the partition sizes (one row a partition) are broadcast.
    Ties are dealt by position as well, so that one key may hold any share of the rows.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # without ties in the range keys, a hot key is cut at any place
    dealt = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(partitions, *keys, "_at")
    dealt = settle(dealt.sortWithinPartitions(*keys, "_at").drop("_at").withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.collect()  # one row a partition
    starts, at = [], 0
    for p, c in sorted((r["_p"], r["_n"]) for r in before):
        starts.append((p, at))
        at += c
    offsets = spark.createDataFrame(starts, "_p long, _before long")
    local = F.col("_m").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(into, F.col("_before") + local).drop("_p", "_m", "_before")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: ``(id, size, text_crc32, law, shard, slot, grown_shard, row_no)``.

    The text itself is not shuffled, only its size and checksum.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    numbered = settle(number_rows(slim, ["doc_id", "text_crc32", "size"]))
    n = numbered.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    out = numbered.withColumn("_place", place("row_no"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
