"""A uniform sample of fixed size: dense numbers through partition offsets, a seeded Feistel permutation with
cycle walking over 0..N-1, and the records whose permuted position is below k.

The number of records is known only after they were numbered, so they may arrive in any number of pieces. The
numbers follow the sorted keys, hence the sample depends on the set of keys and the seed alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.runtime import cut, number_rows

#: Rounds of the Feistel network.
ROUNDS = 7


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser; uint64 arithmetic wraps."""
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The images of 0 <= x < n under a seeded permutation of 0..n-1."""
    x = np.asarray(x, dtype=np.uint64)
    if n < 2:
        return x
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [int.from_bytes(np.random.default_rng([seed, r]).bytes(8), "little") for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(x)
        while (far := out >= np.uint64(n)).any():  # cycle walking: the domain is less than 4 n
            out[far] = once(out[far])
    return out


def permuted(pos: Column, n: int, seed: int) -> Column:
    """Spark column of permuted positions (Arrow batches)."""

    @F.pandas_udf("long")
    def f(s: pd.Series) -> pd.Series:
        return pd.Series(permute(s.to_numpy(), n, seed).astype("int64"))

    return f(pos)


def fixed_sample(rows: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """(key, position): min(k, N) of the N distinct non-null keys, each equally likely; position is the rank
    in the drawn order, 0..k-1. Repeated keys count once; an empty table gives an empty sample; k <= 0 too."""
    numbered = cut(number_rows(rows.where(F.col(key).isNotNull()).select(key).distinct(), [F.col(key)]))
    n = numbered.count()
    return numbered.withColumn("position", permuted(F.col("pos"), n, seed)).where(F.col("position") < max(k, 0)).select(key, "position")


def sample_rows(rows: DataFrame, key: str, k: int, order: str, seed: int = 7) -> DataFrame:
    """The sampled records with all their columns: of repeated deliveries the one first by ``order``. A column that is called
    position already is replaced by the place in the sample."""
    rows = rows.drop("position")
    drawn = F.broadcast(fixed_sample(rows, key, k, seed)) if k <= 200_000 else fixed_sample(rows, key, k, seed)
    picked = rows.join(drawn, key)
    others = [c for c in rows.columns if c != key]
    first = picked.groupBy(key, "position").agg(F.min_by(F.struct(*others), F.struct(F.col(order), F.xxhash64(*others))).alias("_r"))
    return first.select(key, "position", *[F.col(f"_r.`{c}`").alias(c) for c in others])
