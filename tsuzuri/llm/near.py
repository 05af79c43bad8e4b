"""Near-duplicates by the Jaccard similarity of word shingles, for the pipeline.

Texts of which the sets of ``WIDTH``-word shingles have a Jaccard similarity of ``LEAST`` or more are linked, and so are texts whose
SimHash fingerprints the ``simhash`` module links; links are transitive. A 64-bit SimHash differs in about 10 bits at 0.8, so it alone
needs a radius of about 17 bits for 99 % of the pairs, and no split of 64 bits into parts tells texts apart at that radius.

Candidates share one of ``BANDS`` bands of ``ROWS`` MinHash values: a pair at 0.8 shares none with a probability of 3e-6, a more similar
pair with less. Groups of candidates are then searched by the exact similarity of their sets, and only a spanning forest of the links
leaves a task. A group of over ``GROUP`` sets is cut into blocks, each pair of blocks a task of its own.

Defined results: words are as in ``common``, lower-cased; a text of fewer than ``WIDTH`` words is one shingle; null, empty and white
texts are equal; a pair at exactly ``LEAST`` is linked; repeated rows count once, and one of them stays; texts are read whole, whatever their
length; an empty table gives an empty result; columns, whatever their names, are kept.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components, one_of_each
from .hashing import mix, prefixes, windows
from .simhash import fingerprint, roots

WIDTH, LEAST = 5, 0.8
BANDS, ROWS, GROUP = 32, 5, 2048
_RNG = np.random.default_rng(5)
_MUL, _ADD = (_RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = text.encode().lower().split()
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), words), np.uint64, len(words))
    return np.unique(windows(prefixes(h), min(width, len(h)))) if len(h) else h


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band of the set's MinHash values."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i : i + 512] * _MUL + _ADD).min(axis=1), out=low)
    key = np.zeros(BANDS, np.uint64)
    for col in low.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + col + _SALT)
    return key


def linked(ids: list[int], sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs of sets that are similar enough, by breadth-first search."""
    out: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.cumsum(size) - size
    mark = np.zeros(len(names), bool)
    rest, cells = np.arange(len(sets)), flat
    todo: list[int] = []
    while len(rest):
        if not todo:
            todo = [int(rest[0])]
            cells, rest = cells[size[rest[0]] :], rest[1:]
        a = todo.pop()
        if not len(rest):
            break
        mine = flat[edge[a] : edge[a] + size[a]]
        mark[mine] = True
        n = size[rest]
        both = np.add.reduceat(mark[cells], np.cumsum(n) - n, dtype=np.int64)
        mark[mine] = False
        near = both / (size[a] + n - both) >= least
        if near.any():
            found = rest[near].tolist()
            out += [(ids[a], ids[b]) for b in found]
            todo += found
            cells, rest = cells[np.repeat(~near, n)], rest[~near]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, rk from common.row_key(), SimHash fingerprint, a hash of the shingle set and its bands, for each row; stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = C.texts(batch)
        sets = [shingles(t) for t in texts]
        fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        of = np.array([xxhash.xxh64_intdigest(s.tobytes(), 3) for s in sets], np.uint64).view(np.int64)
        keys = np.array([bands(s) for s in sets], np.uint64).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp), pa.array(of), lists], ["doc_id", "rk", "fp", "of", "bands"])

    return C.stored(C.arrow_map(C.id_text(docs).withColumn("rk", C.row_key()), run, "doc_id long, rk binary, fp long, of long, bands array<long>"))


def links(docs: DataFrame, rows: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): links that connect all sets that are similar enough, without those that others imply. ``rows``: from measured()."""
    one = C.stored(rows.groupBy("of").agg(F.min("rk").alias("rk"), F.first("bands").alias("bands")))
    spread = one.select("of", F.explode("bands").alias("band"))
    shared = C.stored(spread.groupBy("band").agg(F.min("of").alias("to"), F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    if shared.count() <= C.SMALL:
        met = spread.join(F.broadcast(shared.select("band", "to")), "band")
    else:
        met = C.join_hot(spread, shared, ["band"], "n", total)
    found = components(met.where("of != to").select(F.col("of").alias("a"), F.col("to").alias("b")))
    member = C.stored(found.select("node", "root").union(found.select("root", "root")).distinct())
    sizes = C.stored(member.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.count("*") / group).cast("int").alias("blocks")))
    cut = C.join_hot(member, sizes, ["root"], "n", max(member.count(), 1))
    pick = C.stored(cut.join(one.select("of", "rk"), F.col("node") == F.col("of")).select("root", "blocks", "of", F.col("rk").alias("pick")))
    C.discard(one, shared, member, sizes)

    text = docs.select(F.col("text").cast("string").alias("text"), C.row_key().alias("rk")).join(C.small(pick), F.col("rk") == F.col("pick")).select("text", "root", "blocks", "of")
    own = text.withColumn("own", F.pmod(F.xxhash64("of"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = own.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "of", "text")

    def verify(batches):
        key, held = None, {}

        def out():
            # equal hashes stand for equal sets
            found = linked(list(held), list(held.values()))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for k, of, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != key and len(held) > 1:
                    yield out()
                if k != key:
                    key, held = k, {}
                held[of] = shingles(t.as_py() or "")
        if len(held) > 1:
            yield out()

    return task.repartition("task").sortWithinPartitions("task").mapInArrow(verify, "a long, b long")


def deduplicated(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row of each group, the one of the least doc_id (a null one only if there is no other); columns as they were."""
    rows = measured(docs)
    sets = C.stored(rows.select("fp", "of").distinct())
    fps = C.stored(sets.select("fp").distinct())
    alike = sets.join(roots(fps), "fp").select("root", "of").distinct()
    star = C.stored(alike.groupBy("root").agg(F.min("of").alias("b"), F.count("*").alias("n")).where("n > 1"))
    total = star.agg(F.sum("n")).first()[0] or 0
    linked_ = C.join_hot(C.stored(alike), star, ["root"], "n", max(total, 1)).where("of != b").select(F.col("of").alias("a"), "b")
    return one_of_each(docs, rows.select("doc_id", "rk", F.col("of").alias("key")), components(links(docs, rows, group).union(linked_)))
