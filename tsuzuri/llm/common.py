"""What the operators of this subpackage share: shared-folder tables, batched Arrow maps and word splitting.

Texts are handled whole. A null text counts as empty. Words are runs of bytes other than
0x20 and 0x09-0x0D, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one step of an Arrow map holds as Python objects.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one set here for tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import os
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "tsuzuri-checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut, and no executor's loss can undo it.

    The files go by ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tsuzuri-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = hpath
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``stored`` that nothing reads any more, and let Spark delete shuffle files of dropped data frames."""
    for t in tables:
        t._stored_at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(t._stored_at, True)
    if tables:
        release(tables[0].sparkSession)


#: Keys that make up 1 / HOT of a total or more are broadcast in ``join_hot``: at most HOT of them.
HOT = 100_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """An equi-join in which no key's rows meet in one task. ``right`` has unique keys, of which ``count`` bounds the rows of ``left``
    (summing to about ``total``): the frequent ones are broadcast, at most HOT by their definition, and only the others are shuffled."""
    hot, cold = right.where(F.col(count) * HOT >= total), right.where(F.col(count) * HOT < total)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of data frames that are no longer referred to."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: Rows that ``small`` lets go to every task.
SMALL = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most SMALL rows of a few numbers; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= SMALL else df


def row_key() -> Column:
    """128 bits of doc_id and text: rows with equal keys are copies in both."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit("")))))


@dataclass
class Bloom:
    """A filter of long keys: two bits of each. What is in is always found; what is not may be found too, the more often the fuller it is."""

    mask: int
    cells: np.ndarray

    LISTED = 4_000_000

    @classmethod
    def of(cls, keys: DataFrame, most: int = 1 << 28) -> Bloom:
        """``keys``: (key), well mixed, stored. At most ``most`` bits. Up to LISTED keys reach the driver; of more, only the bits."""
        n, count = 1024, keys.count()
        while n < min(16 * count, most):
            n *= 2
        out = np.zeros(n // 64, np.uint64)
        if count <= cls.LISTED:
            for chunk in keys.toArrow().column(0).chunks:
                k = np.asarray(chunk, np.int64).view(np.uint64)
                for b in (k & np.uint64(n - 1), (k >> np.uint64(32)) & np.uint64(n - 1)):
                    np.bitwise_or.at(out, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
            return cls(n - 1, out)
        bits = keys.select(F.col("key").bitwiseAND(n - 1).alias("b")).union(keys.select(F.shiftrightunsigned("key", 32).bitwiseAND(n - 1).alias("b")))
        cells = bits.select(F.shiftright("b", 6).alias("i"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("x")).groupBy("i").agg(F.bit_or("x").alias("x")).toArrow()
        out[np.asarray(cells.column(0).combine_chunks(), np.int64)] = np.asarray(cells.column(1).combine_chunks(), np.int64).view(np.uint64)
        return cls(n - 1, out)

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        ok = np.ones(len(k), bool)
        for b in (k & np.uint64(self.mask), (k >> np.uint64(32)) & np.uint64(self.mask)):
            ok &= (self.cells[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)) == 1
        return ok


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about SLICE_CHARS bytes of text (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    cut = np.cumsum(size) // SLICE_CHARS
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str, text: str = "text", setup: Callable | None = None) -> DataFrame:
    """``mapInArrow`` in bounded pieces. ``setup()`` runs once in each task; its result goes to ``fn`` as second argument."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = (setup(),) if setup else ()
        for batch in batches:
            for piece in pieces(batch, text):
                out = fn(piece, *extra)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null becomes empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (as long) and text (as string), whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def hashed_sample(df: DataFrame, by: list[str], rows: int, most: int) -> DataFrame:
    """At most ``most`` of about ``rows`` rows, those of the least hash; of rows that agree in ``by`` any one. A threshold leaves few to sort, and no task sends more than its share."""
    hash_ = F.xxhash64(*by)
    cut = -(1 << 63) + min(1.0, 0.9 * most / max(rows, 1)) * float(1 << 64)
    return (df.where(hash_.cast("double") <= cut) if 0.9 * most < rows else df).orderBy(hash_).limit(most)


def span_string(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))
