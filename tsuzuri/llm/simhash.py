"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints that differ in at most T of 64 bits must, for any split of the bits into parts with thresholds that sum to
T - parts + 1, differ in at most its threshold in some part. Correlated bits are grouped into one part, the parts' unequal
thresholds (-1 leaves a part out) come from dynamic programming over estimated costs of candidates and probes, for several
numbers of parts, and the cheapest plan is taken. A fingerprint is put into a bucket for each choice of ``threshold`` bits of a
part left out; two that agree elsewhere in the part meet there. Pairs in a bucket are verified, and only a spanning forest of the links leaves a
task, so a large group of near copies costs rows in proportion to its size. A bucket of over ``BUCKET`` fingerprints is cut
into blocks, each pair of blocks a task of its own.

Only the plan is estimated, from a bounded sample of fingerprints: any plan finds every link.

Defined results: null or empty text, or white space alone, has fingerprint zero, linked like any other; a null doc_id gets a
component_id from the others (null if there is none); repeated rows give equal rows; a bit that exactly half of the
shingles set is 0; texts are read whole, whatever their length; an empty table gives an empty result; other columns, whatever their names, are kept by ``deduplicated`` and ignored by ``fingerprints`` and ``near_copies``.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components, one_of_each
from .hashing import mix

BUCKET, SAMPLE = 4096, 4096
#: Relative costs of a bucket row and of a compared pair.
ROW_COST, PAIR_COST = 3e-6, 6e-9


def fingerprint(text: str, width: int = 4) -> int:
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    n = len(words) - width + 1
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        ones += np.add.reduce(np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp, rk) for each row, fp as a signed 64-bit number, rk from common.row_key(); stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, width) for t in C.texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["doc_id", "fp", "rk"])

    return C.stored(C.arrow_map(C.id_text(docs).withColumn("rk", C.row_key()), run, "doc_id long, fp long, rk binary"))


def grouped_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Split the 64 bits into parts of nearly equal size, each filled with the bits most correlated to those it has."""
    with np.errstate(all="ignore"):
        c = np.nan_to_num(np.abs(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.zeros((64, 64))
    free, out = list(range(64)), []
    for p in range(parts):
        size = (64 - sum(map(len, out))) // (parts - p)
        mine = [max(free, key=lambda b: c[b, free].sum())]
        free.remove(mine[0])
        while len(mine) < size:
            b = max(free, key=lambda b: c[b, mine].sum())
            mine.append(b)
            free.remove(b)
        out.append(sorted(mine))
    return out


def plan(sample: np.ndarray, n: int, bits: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of the least estimated cost for n fingerprints, from a sample of them."""
    cells = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(sample) else np.zeros((0, 64), np.uint8)
    rng = np.random.default_rng(7)
    i, j = (rng.integers(0, max(len(sample), 1), 400_000) for _ in range(2))
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, bits + 2):
        groups = grouped_bits(cells, parts)
        cost = []
        for g in groups:
            m = np.uint64(sum(1 << b for b in g))
            d = np.bitwise_count((sample[i] ^ sample[j])[i != j] & m) if len(sample) > 1 else np.zeros(0, np.uint8)
            seen = np.bincount(d, minlength=65)[: len(g) + 1] if len(d) else np.zeros(len(g) + 1)
            even = np.array([comb(len(g), t) / 2 ** len(g) for t in range(len(g) + 1)])
            p = (seen + even) / (len(d) + 1)
            of = [0.0]
            for t in range(bits + 1):
                rows = comb(len(g), t) if t <= len(g) else float("inf")
                pairs = sum(p[x] * comb(len(g) - x, t - x) for x in range(min(t, len(g)) + 1))
                of.append(n * rows * ROW_COST + n * n / 2 * pairs * PAIR_COST)
            cost.append(of)  # cost of threshold t at t + 1
        # state: sum of (threshold + 1); it must reach bits + 1
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for of in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in state.items():
                for t, x in enumerate(of):
                    k = min(s + t, bits + 1)
                    if c + x < new.get(k, (float("inf"),))[0]:
                        new[k] = (c + x, [*ts, t - 1])
            state = new
        if bits + 1 in state and state[bits + 1][0] < best[0]:
            best = (state[bits + 1][0], list(zip(groups, state[bits + 1][1])))
    return [(g, t) for g, t in best[1] if t >= 0]


@lru_cache(maxsize=16)
def masks(how: tuple) -> np.ndarray:
    """For each bucket row of a fingerprint, the bits that count."""
    out = []
    for g, t in how:
        whole = sum(1 << b for b in g)
        out += [whole - sum(1 << b for b in left) for left in combinations(g, t)]
    return np.array(out, np.uint64)


class Forest:
    """Union-find that says which links join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def linked(fp: np.ndarray, start: np.ndarray, bits: int, forest: Forest) -> list[tuple[int, int]]:
    """New links within runs of ``fp``; start: where each run begins. Small runs are compared shift by shift, large ones by breadth-first search."""
    out = []
    n = len(fp)
    size = np.diff(np.append(start, n))
    big = size > 512
    run = np.repeat(np.arange(len(start)), size)
    pick = ~big[run]
    x, g = fp[pick], run[pick]
    for s in range(1, int(size[~big].max(initial=1))):
        at = np.flatnonzero(g[s:] == g[:-s])
        if not len(at):
            break
        at = at[np.bitwise_count(x[at] ^ x[at + s]) <= bits]
        for a, b in zip(x[at].tolist(), x[at + s].tolist()):
            if forest.join(a, b):
                out.append((a, b))
    for r in np.flatnonzero(big):
        rest = fp[start[r] : start[r] + size[r]]
        todo: list[np.ndarray] = []
        while len(rest):
            todo.append(rest[0])
            rest = rest[1:]
            while todo and len(rest):
                a = todo.pop()
                near = np.bitwise_count(rest ^ a) <= bits
                if near.any():
                    found = rest[near]
                    for b in found.tolist():
                        if forest.join(int(a), b):
                            out.append((int(a), b))
                    todo.extend(found)
                    rest = rest[~near]
    return out


def links(fps: DataFrame, bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``bits`` bits of one another, without those that others imply. ``fps``: (fp), distinct and stored."""
    n = fps.count()
    few = C.hashed_sample(fps.select("fp"), ["fp"], n, SAMPLE)
    how = tuple((tuple(g), t) for g, t in plan(np.array([r["fp"] for r in few.collect()], np.int64).view(np.uint64), n, bits))

    def spread(batches):
        m = masks(how)
        salt = mix(np.arange(1, len(m) + 1, dtype=np.uint64))
        for batch in batches:
            fp = np.array(batch.column(0), np.int64)
            for i in range(0, len(fp), 1 << 13):
                part = fp[i : i + (1 << 13)]
                key = mix((part.view(np.uint64)[:, None] & m) * np.uint64(0x9E3779B97F4A7C15) + salt).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part, len(m)))], ["bucket", "fp"])

    rows = fps.select("fp").mapInArrow(spread, "bucket long, fp long")
    large = rows.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket", F.ceil(F.col("count") / bucket).cast("int").alias("blocks"))
    large = C.stored(large)
    if large.limit(1).count():
        both = rows.join(large, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
        both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = both.select(F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).alias("bucket"), "fp")

    def verify(batches):
        forest, keys, vals = Forest(), np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, v):
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
            found = linked(v, start, bits, forest)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, np.array(batch.column(0), np.int64)])
            vals = np.concatenate([vals, np.array(batch.column(1), np.int64).view(np.uint64)])
            if len(keys):
                cut = int(np.flatnonzero(keys == keys[-1])[0]) if keys[0] != keys[-1] else 0
                if cut:
                    yield out(keys[:cut], vals[:cut])
                    keys, vals = keys[cut:], vals[cut:]
        yield out(keys, vals)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "a long, b long")


def roots(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, root) of all fingerprints: the least one that each reaches; stored. ``fps``: (fp), distinct and stored."""
    found = components(links(fps, bits))
    return C.stored(fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_copies(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row."""
    rows = fingerprints(docs, width)
    fps = C.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    of = C.stored(fps.join(roots(fps, bits), "fp"))
    least = C.stored(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    named = C.stored(C.join_hot(of.select("fp", "n", "root"), least, ["root"], "fps", max(of.count(), 1)).select("fp", "n", "component_id"))
    out = C.join_hot(rows.select("doc_id", "fp"), named, ["fp"], "n", max(rows.count(), 1))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """One row of each component, the one of the least doc_id (a null one only if there is no other); columns as they were."""
    rows = fingerprints(docs, width)
    fps = C.stored(rows.select("fp").distinct())
    return one_of_each(docs, rows.select("doc_id", "rk", F.col("fp").alias("key")), components(links(fps, bits)))
