"""Where a corpus repeats itself: sampled k-grams, which of them recur, and their nonbranching paths.

Of all k-grams of units (words or bytes), winnowing keeps local hash minima: any ``length`` units in a row hold one, and equal
stretches hold equal ones. The kept k-grams are nodes of a de Bruijn graph; the text from one to the next is an edge, named by
its hash. Nodes that occur once are dropped by a count on hashes alone. A node whose every occurrence is followed by the same
edge, and whose successor is always preceded by it, lies on a nonbranching path; pointer doubling by Spark joins finds each
node's path and place. Occurrences of a path are then equal texts by construction, and only one of them needs a closer look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

_TABLE = H.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BLOCK = 1 << 19
#: The kind of an edge, in its hash's low bits: between anchors, or at a document's begin or end.
_KIND, _BEGIN, _INNER, _END = (np.uint64(x) for x in (3, 1, 2, 3))
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Spec:
    unit: str  # words or bytes
    length: int  # units in a window
    k: int  # units in a sampled k-gram

    @property
    def w(self) -> int:
        return self.length - self.k + 1


def units(text: str, spec: Spec):
    """The text's units: an array of word hashes, or of bytes."""
    data = text.encode()
    if spec.unit == "bytes":
        return np.frombuffer(data, np.uint8)
    import xxhash

    words = data.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def values(u: np.ndarray) -> np.ndarray:
    return u if u.dtype == np.uint64 else _TABLE[u]


def sample(u: np.ndarray, ends: np.ndarray, spec: Spec, edges: bool = True):
    """Anchors of concatenated documents: positions, hashes, hashes of the edges that leave and enter (0: none), and documents.

    Works in blocks with margins, so memory does not grow with a text's length."""
    k, w = spec.k, spec.w
    margin, n = 3 * w + 2, len(u)
    out = []
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        lo, hi = max(0, a - margin), min(n, b + margin + k)
        p = H.prefixes(values(u[lo:hi]))
        x = H.windows(p, k)
        if not len(x):
            continue
        ok = np.ones(len(x), bool)
        for e in ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, hi + k, "right")].tolist():
            ok[max(0, e - k + 1 - lo) : max(0, e - lo)] = False
        x[~ok] = _MAX
        sel = H.anchors(x, w) & ok
        at = np.flatnonzero(sel)
        if not len(at):
            continue
        doc = np.searchsorted(ends, at + lo, "right")
        # of a run of equal anchors, as periodic text has, the first and the last are kept
        same = (x[at[1:]] == x[at[:-1]]) & (doc[1:] == doc[:-1]) & (at[1:] - at[:-1] <= w)
        keep = np.ones(len(at), bool)
        keep[1:-1] = ~(same[1:] & same[:-1])
        at, doc = at[keep], doc[keep]
        if not edges:
            core = (at + lo >= a) & (at + lo < b)
            none = np.zeros(core.sum(), np.uint64)
            out.append((at[core] + lo, x[at[core]], none, none, doc[core]))
            continue
        joined = doc[1:] == doc[:-1]
        edge, enter = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        i = np.flatnonzero(joined & (at[1:] - at[:-1] <= w))
        edge[i] = H.span_hash(p, at[i], at[i + 1] + k) & ~_KIND | _INNER
        enter[i + 1] = edge[i]
        # what lies before a document's first anchor and after its last one is an edge too
        top, end = np.where(doc > 0, ends[doc - 1], 0) - lo, ends[doc] - lo
        i = np.flatnonzero(np.concatenate([[True], ~joined]) & (top >= 0) & (at - top <= w))
        enter[i] = H.span_hash(p, top[i], at[i] + k) & ~_KIND | _BEGIN
        i = np.flatnonzero(np.concatenate([~joined, [True]]) & (end <= hi - lo) & (end - at - k <= w))
        edge[i] = H.span_hash(p, at[i], end[i]) & ~_KIND | _END
        core = (at + lo >= a) & (at + lo < b)
        out.append((at[core] + lo, x[at[core]], edge[core], enter[core], doc[core]))
    if not out:
        z = np.zeros(0, np.uint64)
        return z.astype(np.int64), z, z, z, z.astype(np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def at_positions(u: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """What windows() gives at some positions."""
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(pos), 1 << 14):
        m = values(u[pos[i : i + (1 << 14), None] + np.arange(k)])
        out.append(H.mix((m * H._powers(H._B, k)[:k]).sum(1, dtype=np.uint64) + np.uint64(k)))
    return np.concatenate(out)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), ``ord`` (doc_id, a null one before all others) and ``rk``, a hash of the text. Rows that agree in ord and rk are equal and get equal results."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"ord": F.coalesce("doc_id", F.lit(-(1 << 63))), "rk": F.xxhash64("text")})


def occurrences(rows: DataFrame, spec: Spec, wanted=None) -> DataFrame:
    """(a, rk, ord, pos, leave, enter): each anchor of each document; ``ord`` is doc_id, a null one before all others. ``wanted``: a broadcast filter of anchors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        us = [units(t, spec) for t in C.texts(batch)]
        keep = [i for i, x in enumerate(us) if len(x) >= spec.length]
        if not keep:
            return None
        us = [us[i] for i in keep]
        ends = np.cumsum([len(x) for x in us])
        at, x, leave, enter, doc = sample(np.concatenate(us), ends, spec)
        if wanted is not None:
            some = wanted.value.has(x)
            at, x, leave, enter, doc = (c[some] for c in (at, x, leave, enter, doc))
        start = (ends - np.array([len(x) for x in us]))[doc]
        ids, rk = (np.array(batch.column(i), np.int64)[keep][doc] for i in (0, 2))
        cols = [x.view(np.int64), rk, ids, (at - start).astype(np.int64), leave.view(np.int64), enter.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "rk", "ord", "pos", "leave", "enter"])

    return C.arrow_map(rows.select("ord", "text", "rk"), run, "a long, rk long, ord long, pos long, leave long, enter long")


def recurring(rows: DataFrame, spec: Spec) -> DataFrame:
    """The occurrences of anchors found in two documents or more, with their number ``n``; stored. A filter of these anchors, of bounded size, thins out the second pass."""
    first = occurrences(rows, spec).select("a", "ord")
    often = C.stored(first.groupBy("a").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("a", "n"))
    C.release(rows.sparkSession)
    total = often.agg(F.sum("n")).first()[0] or 0
    wanted = rows.sparkSession.sparkContext.broadcast(C.Bloom.of(often.select(F.col("a").alias("key"))))
    occ = C.stored(occurrences(rows, spec, wanted))
    out = C.stored(C.join_hot(occ, often, ["a"], "n", max(total, 1)))
    C.discard(often, occ)
    return out


def nodes(occ: DataFrame) -> DataFrame:
    """For each recurring anchor: its first occurrence, and the one edge by which all occurrences leave or enter, if there is one."""
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c))
    return C.stored(occ.groupBy("a").agg(F.min(F.struct("ord", "rk", "pos")).alias("first"), F.max("n").alias("n"), one("leave").alias("out"), one("enter").alias("into")))


def paths(graph: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, head, place): the nonbranching path of each node, by its first node, and the node's place on it. Pointer doubling; stored."""
    left = graph.where(F.col("out").isNotNull()).select(F.col("a").alias("up"), F.col("out").alias("edge"))
    right = graph.where(F.col("into").isNotNull()).select("a", F.col("into").alias("edge"))
    link = right.join(left, "edge").where("a != up").select("a", F.col("up"), F.lit(1).cast("long").alias("hops"))
    at = C.stored(graph.select("a").join(link, "a", "left").select("a", F.coalesce("up", "a").alias("head"), F.coalesce("hops", F.lit(0)).alias("place")))
    for _ in range(rounds):
        nxt = at.where("place > 0").select(F.col("a").alias("head"), F.col("head").alias("up"), F.col("place").alias("hops"))
        was, at = at, C.stored(at.join(nxt, "head", "left").select("a", F.coalesce("up", "head").alias("head"), (F.col("place") + F.coalesce("hops", F.lit(0))).alias("place"), F.col("up").isNotNull().alias("moved")))
        C.discard(was)
        if at.where("moved").limit(1).count() == 0:
            break
    return at.select("a", "head", "place")


def visits(occ: DataFrame, graph: DataFrame, path: DataFrame) -> DataFrame:
    """(ord, rk, found): for each document its recurring anchors, stored; ``state`` says of the windows within an anchor's path: 2, found in a document with a smaller id, or 1.

    at_begin, at_end: the path reaches the document's begin or end in all its occurrences."""
    node = C.stored(graph.join(path, "a").select("a", "n", F.col("first.ord").alias("least"), "head", "place", F.coalesce(F.col("into").bitwiseAND(3) == 1, F.lit(False)).alias("at_begin"), F.coalesce(F.col("out").bitwiseAND(3) == 3, F.lit(False)).alias("at_end")))
    total = node.agg(F.sum("n")).first()[0] or 0
    state = F.when(F.col("least") < F.col("ord"), 2).otherwise(1)
    rows = C.join_hot(occ.select("a", "rk", "ord", "pos"), node, ["a"], "n", max(total, 1)).select("ord", "rk", F.struct("pos", "head", "place", state.cast("tinyint").alias("state"), "at_begin", "at_end").alias("v"))
    out = C.stored(rows.groupBy("ord", "rk").agg(F.collect_set("v").alias("found")))
    C.discard(node)
    return out


def least_anchors(u: np.ndarray, spec: Spec) -> Iterator[tuple[int, np.ndarray]]:
    """In blocks: the first window's start, and each window's least k-gram."""
    for a in range(0, len(u) - spec.length + 1, BLOCK):
        b = min(a + BLOCK, len(u) - spec.length + 1)
        yield a, H.sliding(H.windows(H.prefixes(values(u[a : b + spec.length - 1])), spec.k), spec.w, np.minimum)


def doc_windows(u: np.ndarray, found: pa.StructArray, spec: Spec):
    """Of one document: spans that are copies of an earlier text as a whole, and in blocks the starts of open windows.

    A window within a path's text holds an anchor of the path, so whoever else has the window has the whole path: the path's first occurrence keeps it,
    all others lose it, and only windows over a path's ends are left to compare."""
    pos = np.asarray(found.field("pos"), np.int64)
    o = np.argsort(pos, kind="stable")
    pos, head, place, state, at_begin, at_end = (np.asarray(found.field(c))[o].astype(np.int64) for c in ("pos", "head", "place", "state", "at_begin", "at_end"))
    n, k, length = len(u), spec.k, spec.length
    cut = np.flatnonzero(~((head[1:] == head[:-1]) & (place[1:] == place[:-1] + 1) & (state[1:] == state[:-1]))) + 1
    first, last = np.concatenate([[0], cut]).astype(int), np.concatenate([cut - 1, [len(pos) - 1]]).astype(int)
    a, b = np.where(at_begin[first] > 0, 0, pos[first]), np.where(at_end[last] > 0, n, pos[last] + k)
    whole = b - a >= length
    settled = np.stack([a[whole], b[whole]], 1)
    spans = settled[state[first][whole] == 2]
    open_: list[np.ndarray] = []
    known = np.unique(at_positions(u, pos, k))
    for s0, low in least_anchors(u, spec):
        where = np.minimum(np.searchsorted(known, low), len(known) - 1)
        mine = known[where] == low
        for p, q in settled[np.searchsorted(settled[:, 1], s0) : np.searchsorted(settled[:, 0], s0 + len(low))].tolist():
            mine[max(0, p - s0) : max(0, q - length + 1 - s0)] = False
        at = np.flatnonzero(mine)
        if len(at):
            open_.append(at + s0)
    return spans, open_
