"""Connected components by alternating large-star and small-star steps over a stored edge table, and one document of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long): root is the least node that it reaches; stored. Each step keeps at most a row per edge and works by minima, so a node with very many edges is pre-aggregated and then joined by ``common.join_hot``."""
    now = C.stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        size = now.count()
        if not size:
            break
        both = now.union(now.select("v", "u"))
        least = C.stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n"))
        large = C.stored(C.join_hot(both.where("v > u"), least, ["u"], "n", 2 * size).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = C.stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = C.join_hot(large, low, ["u"], "n", size)
        nxt = C.stored(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        C.discard(least, large, low)
        # a star forest stays as it is
        same = nxt.count() == size and not nxt.join(now, ["u", "v"], "left_anti").limit(1).count()
        C.discard(now)
        now = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def one_of_each(docs: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, the one of the least doc_id (a null one only if there is no other); columns as they were.

    ``rows``: doc_id, rk (common.row_key) and key of each row, stored; ``groups``: (node, root) of the keys that have others. What goes is
    listed, not what stays, so texts move only if there are more such rows than go to every task."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("best")
    keys = rows.groupBy("key").agg(best, F.count("*").alias("n"))
    keys = C.stored(keys.join(groups, keys["key"] == groups["node"], "left").select("key", "best", "n", F.coalesce("root", "key").alias("root")))
    many = C.stored(keys.groupBy("root").agg(F.min("best").alias("top"), F.sum("n").alias("rows"), F.count("*").alias("keys")).where("rows > 1").select("root", "keys", F.col("top.rk").alias("keep")))
    mine = C.stored(C.join_hot(keys.select("key", "n", "root"), many, ["root"], "keys", max(keys.count(), 1)).select("key", "n", "keep"))
    gone = C.stored(C.join_hot(rows.select("key", "rk"), mine, ["key"], "n", max(rows.count(), 1)).where("rk != keep").select(F.col("rk").alias("__rk")).distinct())
    twice = C.stored(rows.groupBy("rk").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rk").alias("__rk")))
    left = docs.withColumn("__rk", C.row_key()).join(C.small(gone), "__rk", "left_anti")
    if twice.count():
        copies = left.join(C.small(twice), "__rk", "left_semi").dropDuplicates(["__rk"])
        left = left.join(C.small(twice), "__rk", "left_anti").union(copies)
    return left.select(*docs.columns)
