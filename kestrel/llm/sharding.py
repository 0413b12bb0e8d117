"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in ascending key order.  A keyed Feistel network permutes the
smallest power of two that holds n; values outside 0..n-1 are walked on through the
network until they fall inside, which gives a permutation of 0..n-1.  The permuted number
p is the place in a reproducible shuffle: ``shard = p % shards`` and ``slot = p // shards``.
Both can be computed (and inverted) from a row number alone, without reading any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import LOWEST, bucket_of, fresh, missing, range_bounds, shuffle_partitions

ROUNDS = 8


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """Round function: a 64-bit avalanche mix of the half block and the round key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    step = 0x9E3779B97F4A7C15
    return [int(_mix(np.array([(seed + i * step) % 2**64], dtype=np.uint64), step)[0])
            for i in range(1, ROUNDS + 1)]


def _network(x: np.ndarray, bits: int, seed: int, inverse: bool) -> np.ndarray:
    """One pass of the (unbalanced) Feistel network over ``bits`` bits; the two halves
    change width each round, and an even number of rounds restores the layout."""
    lo_bits, hi_bits = (bits + 1) // 2, bits // 2
    keys = _keys(seed)
    with np.errstate(over="ignore"):
        if not inverse:
            for k in keys:
                hi, lo = x >> np.uint64(lo_bits), x & np.uint64((1 << lo_bits) - 1)
                hi ^= _mix(lo, k) & np.uint64((1 << hi_bits) - 1)
                x = (lo << np.uint64(hi_bits)) | hi
                lo_bits, hi_bits = hi_bits, lo_bits
        else:
            for k in reversed(keys):
                lo_bits, hi_bits = hi_bits, lo_bits
                lo, hi = x >> np.uint64(hi_bits), x & np.uint64((1 << hi_bits) - 1)
                hi = hi ^ (_mix(lo, k) & np.uint64((1 << hi_bits) - 1))
                x = (hi << np.uint64(lo_bits)) | lo
    return x


def permute(rows, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """Permutation of 0..n-1 (or its inverse) applied to an array of row numbers."""
    x = np.asarray(rows, dtype=np.uint64).copy()
    if n <= 1:
        return x.astype(np.int64)
    bits = max(2, (n - 1).bit_length())
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _network(x[todo], bits, seed, inverse)
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def place(rows, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each global row number."""
    p = permute(rows, n, seed)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Global row number that sits at a place of the shuffle."""
    p = slot * shards + shard
    if not (0 <= shard < shards and 0 <= p < n):
        raise ValueError("no such place")
    return int(permute([p], n, seed, inverse=True)[0])


def number_rows(df: DataFrame, key: str, ties: list[str], name: str) -> tuple[DataFrame, int]:
    """Append gapless global row numbers 0..n-1 in ascending ``key`` order (null first, then
    ``ties``) and return them with n.

    Keys are cut into ranges; a window numbers the rows inside each range, and the counts of
    the ranges before it (one number per shuffle partition) come from one aggregation over
    the key column.  No step orders the whole table in one task.
    """
    spark = df.sparkSession
    bucket = fresh(df, "__bucket")
    parts = shuffle_partitions(spark)
    bounds = range_bounds(df, key, parts)
    at = bucket_of(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)), bounds)
    counts = {r[0]: r[1] for r in df.select(at.alias(bucket)).groupBy(bucket).count().collect()}
    before, total = [], 0
    for b in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(b, 0)
    starts = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    w = Window.partitionBy(bucket).orderBy(F.col(key).asc_nulls_first(), *[F.col(t) for t in ties])
    out = df.withColumn(bucket, at).withColumn(
        name, F.row_number().over(w).cast("long") - 1 + F.get(starts, F.col(bucket)))
    return out.drop(bucket), total


def shard_rows(df: DataFrame, key: str, ties: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Append ``shard`` int, ``slot`` long and ``row_number`` long to every row.

    Law: shards hold counts at most one apart and slots of a shard are gapless from 0.
    Null keys come first, equal keys are ordered by ``ties``; rows equal in both are
    interchangeable.  An empty table stays empty.  Columns of those three names must not
    exist in the input (rename them first), other columns pass through.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    missing(df, key, *ties)
    for c in ("shard", "slot", "row_number"):
        if c in df.columns:
            raise ValueError(f"column {c} exists already")
    numbered, n = number_rows(df, key, ties, "row_number")

    @F.pandas_udf("shard int, slot long")
    def places(rows: pd.Series) -> pd.DataFrame:
        shard, slot = place(rows.to_numpy(), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    at = fresh(numbered, "__place")
    return (numbered.withColumn(at, places("row_number"))
            .select(*numbered.columns, F.col(f"{at}.shard"), F.col(f"{at}.slot")))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 8) -> DataFrame:
    """Place every document: doc_id, size (UTF-8 bytes of the text, null none, plus 16),
    text_crc32 (unsigned, of the UTF-8 text, null as empty), law, shard, slot, grown_shard
    (null: the law is ``rows``) and row_number.  The text itself is never shuffled."""
    missing(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"),
                        F.xxhash64(text).alias("text_hash"))
    placed = shard_rows(small, "doc_id", ["text_crc32", "size", "text_hash"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
