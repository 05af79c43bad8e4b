"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to N - 1 in the order of (doc_id, size, crc32), whatever the layout. A keyed Feistel network permutes the
next power of four; a value of N or more is permuted again (cycle walking) until it falls below N, so the network permutes the
row numbers themselves. Position p of the shuffle lies in shard p mod S at slot p div S: both are computable from the row number
alone, and any row's place can be inverted. Shard sizes differ by one at most.

Numbering: range partitions, sorted; a partition's rows are counted once and an offset for each partition (a few numbers)
goes back. Equal rows are told apart by their place in the input, so a key that holds a third of all rows is still split.

Defined results: null or empty text has size 16 and crc32 0; a null doc_id comes first; repeated rows each get a place of
their own; a text is only measured, whatever its length; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .hashing import mix

ROUNDS, SEED = 6, 20_240_917


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(x: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The place of each row number (or with ``inverse``, the row number of each place) in the shuffle of n rows."""
    bits = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    keys = _keys(seed)
    out = x.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> bits, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        v = left << bits | right
        out[todo] = v
        todo = todo[v >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with their global number as column ``row_no``, and how many there are."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tie.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie")
    here = C.stored(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = sorted((r["p"], r["n"]) for r in here.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    total, start = 0, {}
    for p, n in sizes:
        start[p] = total
        total += n
    if not start:
        return here.withColumn("row_no", F.lit(0).cast("long")).drop("__at"), 0
    offsets = spark.sparkContext.broadcast(start)

    @F.pandas_udf("long")
    def number(at: pd.Series) -> pd.Series:
        a = at.to_numpy()
        p, where = np.unique(a >> 33, return_inverse=True)
        return pd.Series(np.array([offsets.value[int(x)] for x in p], np.int64)[where] + (a & ((1 << 33) - 1)))

    return here.withColumn("row_no", number("__at")).drop("__at"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """A shard and slot for each row, by the law ``rows``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    with_no, n = numbered(rows, ["doc_id", "size", "text_crc32"])

    @F.pandas_udf("long")
    def place(no: pd.Series) -> pd.Series:
        return pd.Series(permute(no.to_numpy(), n, seed))

    p = with_no.withColumn("place", place("row_no"))
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no")
