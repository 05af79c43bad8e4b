"""Suffix-array dedup of bytes.

Candidates: of the k-grams in each window of 100 bytes the one of least hash is its anchor, so equal windows have equal anchors, and only
windows whose anchor is found twice or more in the corpus can recur. The stretch of bytes that consecutive windows of one anchor
make up goes to the shard of the anchor's hash, so equal windows meet. This only picks candidates: a filter that lets more pass costs
work, and changes nothing. Up to ``BLOOM_KEYS`` recurring anchors go to all tasks as a Bloom filter; more are joined to the documents.

Each shard sorts all suffixes of its distinct stretches by Larsson-Sadakane refinement in numpy (prefix doubling in which only
unsorted groups are refined), takes common prefixes of neighbours by Kasai's inequality in its vectorised form (irreducible values
by comparison, the others by counting down), and so finds the groups of equal windows; all but a group's earliest occurrence go.

Shards hold about ``SHARD_BYTES``. An anchor whose stretches exceed that is salted over several shards. Of each window these keep the
earliest occurrences, and the sorted windows are merged across shards: a range partitioner places each by binary search among
sampled windows, and neighbours in the sorted ranges are compared.

Defined results: null or empty text has no bytes (digest of the empty string); a null doc_id comes before all others; rows with
one doc_id never count as earlier than one another, a row's own earlier bytes do; repeated rows get equal rows; a text is read whole in
blocks, whatever its length; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R
from .debruijn import covered

SPEC = R.Spec("bytes", 100, 32)
SHARD_BYTES, LEAST_SHARDS, BLOOM_KEYS = 1 << 20, 256, 10_000_000


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: ranks by the first 7 bytes, then groups with equal ranks refined by the rank h further on, h doubling."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(8, np.int64)])
    for j in range(7):
        key = key * 257 + padded[j : j + n]
    sa = np.argsort(key)
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    h = 7
    while True:
        single = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~single)  # slots of suffixes in unsorted groups
        if not len(at):
            return sa
        own = sa[at]
        nxt = own + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        both = start[at] * (n + 2) + second
        o = np.argsort(both)
        sa[at] = own[o]
        both = both[o]
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        new[at] = fresh
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa[at]] = start[at]
        h *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: of the suffixes at sa[i - 1] and sa[i] (0 for i = 0)."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = np.zeros(n, bool)
    j = before[1:]
    ok = (j > 0) & (before[:-1] >= 0)
    reducible[1:] = ok & (t[:-1] == t[np.maximum(j - 1, 0)])
    plcp = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = sum((padded[j : j + n] << np.uint64(8 * j) for j in range(1, 8)), padded[:n])
    todo = np.flatnonzero(~reducible & (before >= 0))
    a, b = todo, before[todo]
    while len(todo):  # eight bytes at a time; what lies beyond the end is cut off below
        differ = eight[a] ^ eight[b]
        low = differ & (~differ + np.uint64(1))
        plcp[todo] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        go = (differ == 0) & (a + 8 < n) & (b + 8 < n)
        todo, a, b = todo[go], a[go] + 8, b[go] + 8
    plcp = np.minimum(plcp, np.where(before >= 0, n - np.maximum(i, before), 0))
    anchor = np.maximum.accumulate(np.where(reducible, 0, i))
    plcp = np.where(reducible, plcp[anchor] - (i - anchor), plcp)
    out = plcp[sa]
    out[0] = 0
    return out


def equal_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes within the parts: (group, part, offset), groups numbered, by suffix array and common prefixes."""
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z
    sizes = np.array([len(p) for p in parts], np.int64)
    t = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no UTF-8 text holds 0xFF
    starts = np.cumsum(sizes + 1) - sizes - 1
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa)
    part = np.repeat(np.arange(len(parts)), sizes + 1)[sa]
    offset = sa - starts[part]
    whole = offset + length <= sizes[part]
    # between two whole windows in the order stand only suffixes that share their prefix, or none does
    group = np.cumsum(lcp < length)
    return group[whole], part[whole], offset[whole]


def recurring_anchors(rows: DataFrame, spec: R.Spec) -> DataFrame:
    """(key, n) of the anchors found twice or more; stored. Counted in each piece of a batch first, so the shuffle comes before the sums."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        us = [u for t in C.texts(batch) if len(u := R.units(t, spec)) >= spec.length]
        if not us:
            return None
        x = np.sort(R.sample(np.concatenate(us), np.cumsum([len(u) for u in us]), spec, edges=False)[1].view(np.int64))
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(np.diff(np.append(first, len(x))))], ["key", "n"])

    each = C.arrow_map(rows.select("text"), run, "key long, n long").repartition("key")
    return C.stored(each.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))


def stretches(rows: DataFrame, spec: R.Spec, bloom_keys: int = BLOOM_KEYS) -> DataFrame:
    """(a, ord, rk, s, data): the bytes of consecutive windows whose anchor ``a`` recurs, from byte s of a document; stored."""
    often = recurring_anchors(rows, spec)
    small = often.count() <= bloom_keys
    shared = rows.sparkSession.sparkContext.broadcast(C.Bloom.of(often.select("key"))) if small else None

    def found(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        """Anchors, rows, starts, sizes and bytes of stretches, by block."""
        ids, rks = (np.array(batch.column(i), np.int64) for i in (0, 2))
        for i, text in enumerate(C.texts(batch)):
            u = R.units(text, spec)
            mine = None if small else np.sort(np.asarray(batch.column(3)[i].values, np.int64))
            for s0, low in R.least_anchors(u, spec):
                first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                key = low[first].view(np.int64)
                ok = np.flatnonzero(shared.value.has(key) if small else mine[np.minimum(np.searchsorted(mine, key), len(mine) - 1)] == key)
                if len(ok):
                    size = np.append(first[1:], len(low))[ok] - first[ok] + (spec.length - 1)
                    at = np.repeat(first[ok] + s0 - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    yield [key[ok], np.full(len(ok), ids[i]), np.full(len(ok), rks[i]), first[ok] + s0, size, u[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            *cols, size, data = (np.concatenate(c) for c in zip(*held))
            edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), data], ["a", "ord", "rk", "s", "data"])

        total = 0
        for batch in batches:
            for piece in C.pieces(batch):
                for x in found(piece):
                    held.append(x)
                    total += len(x[-1])
                    if total > 16 << 20:
                        yield out()
                        held, total = [], 0
        if held:
            yield out()

    source = rows.select("ord", "text", "rk")
    if not small:
        occ = R.occurrences(rows, spec).select(F.col("a").alias("key"), "ord", "rk").distinct()
        total = often.agg(F.sum("n")).first()[0]
        of = C.join_hot(C.stored(occ), often, ["key"], "n", total).groupBy("ord", "rk").agg(F.collect_list("key").alias("keys"))
        source = rows.join(of, ["ord", "rk"]).select("ord", "text", "rk", "keys")
    out = C.stored(source.mapInArrow(run, "a long, ord long, rk long, s long, data binary"))
    C.discard(often)
    return out


def as_spans(ids: tuple[np.ndarray, np.ndarray], pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of windows of one row that touch; sorted by row and position."""
    if not len(pos):
        return np.zeros(0, int), np.zeros(0, int)
    cut = np.flatnonzero((ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]) | (pos[1:] > pos[:-1] + length)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]]) - 1


def later(group: np.ndarray, o: np.ndarray, r: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which occurrences, sorted by group, row and position, have an earlier one in their group."""
    at = np.arange(len(group))
    head = np.concatenate([[True], group[1:] != group[:-1]])
    own = head | np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1])])
    first, mine = (np.maximum.accumulate(np.where(x, at, 0)) for x in (head, own))
    return (o > o[first]) | (pos > pos[mine])


def sorted_by(*keys: np.ndarray) -> np.ndarray:
    """The order by non-negative keys, the first one leading."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 62:
        return np.lexsort(keys[::-1])
    both = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits):
        both = (both << b) | k
    return np.argsort(both)


def within_shard(table: pa.Table, length: int) -> pa.Table:
    """Spans to remove (window null), and of a salted shard the windows that stay, with their bytes."""
    o, r, s = (table.column(c).to_numpy() for c in ("ord", "rk", "s"))
    data = table.column("data").combine_chunks().dictionary_encode()
    salted = table.column("salted")[0].as_py()
    parts, which = data.dictionary.to_pylist(), np.asarray(data.indices)
    # equal stretches are sorted once
    group, part, offset = equal_windows(parts, length)
    order = np.argsort(which, kind="stable")
    held = np.bincount(which, minlength=len(parts))
    begin = np.cumsum(held) - held
    if not salted:
        many = np.bincount(group, held[part]) > 1
        pick = many[group]
        group, part, offset = group[pick], part[pick], offset[pick]
    n = held[part]
    row = order[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    group, part, offset = (np.repeat(x, n) for x in (group, part, offset))
    # rows of the shard by ord and rk, so that one number names a row
    by = np.lexsort((r, o))
    code = np.empty(len(o), np.int64)
    code[by] = np.cumsum(np.concatenate([[False], (o[by][1:] != o[by][:-1]) | (r[by][1:] != r[by][:-1])]))
    pos, who = s[row] + offset, code[row]
    order = sorted_by(group, who, pos)
    group, part, offset, pos, who, o, r = (x[order] for x in (group, part, offset, pos, who, o[row], r[row]))
    gone = later(group, o, r, pos) if len(group) else np.zeros(0, bool)
    left = np.flatnonzero(~gone) if salted else np.zeros(0, int)
    at = np.flatnonzero(gone)
    at = at[sorted_by(who[at], pos[at])]
    f, g = as_spans((o[at], r[at]), pos[at], length)
    keys = pa.array([parts[part[i]][offset[i] : offset[i] + length] for i in left.tolist()], pa.binary())
    cols = [np.concatenate([x[at][f], x[left]]) for x in (o, r, pos)] + [np.concatenate([pos[at][g], pos[left]]) + length]
    return pa.table([*(pa.array(c.astype(np.int64)) for c in cols), pa.concat_arrays([pa.nulls(len(f), pa.binary()), keys])], names=["ord", "rk", "s", "e", "window"])


def merged(kept: DataFrame) -> DataFrame:
    """(ord, rk, s, e) of windows that also start earlier, in another shard: sorted ranges, in which neighbours are compared."""

    def run(batches):
        last: dict | None = None  # of the window that the last batch ended in: its bytes, least ord, and its last row with that row's first position
        for batch in batches:
            if not batch.num_rows:
                continue
            o, r, s, e = (np.array(batch.column(i), np.int64) for i in range(4))
            w = batch.column(4)
            new = np.concatenate([[last is None or w[0].as_py() != last["window"]], np.asarray(pc.not_equal(w.slice(1), w.slice(0, len(w) - 1)))])
            own = new | np.concatenate([[last is None or (o[0], r[0]) != last["row"]], (o[1:] != o[:-1]) | (r[1:] != r[:-1])])
            at = np.arange(len(o))
            head, mine = (np.maximum.accumulate(np.where(x, at, -1)) for x in (new, own))
            least, start = o[np.maximum(head, 0)], s[np.maximum(mine, 0)]
            if last is not None:
                least[head < 0], start[mine < 0] = last["least"], last["start"]
            gone = (o > least) | (s > start)
            last = {"window": w[-1].as_py(), "least": least[-1], "row": (o[-1], r[-1]), "start": start[-1]}
            yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (o, r, s, e)], ["ord", "rk", "s", "e"])

    ranges = kept.repartitionByRange("window").sortWithinPartitions("window", "ord", "rk", "s")
    return ranges.mapInArrow(run, "ord long, rk long, s long, e long")


def later_windows(open_: DataFrame, spec: R.Spec, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(ord, rk, s, e): spans of the windows whose bytes also start earlier. ``open_`` from stretches()."""
    sizes = open_.groupBy("a").agg(F.sum(F.length("data")).alias("size")).where(F.col("size") > shard_bytes)
    hot = C.stored(sizes.select("a", "size", F.ceil(F.col("size") / shard_bytes).cast("long").alias("salts")))
    total = open_.agg(F.sum(F.length("data"))).first()[0] or 0
    shards, length = max(LEAST_SHARDS, int(total // shard_bytes) + 1), spec.length
    salted = F.col("salts").isNotNull()
    salt = F.xxhash64("a", F.pmod(F.xxhash64("ord", "rk", "s"), F.col("salts")))
    both = C.join_hot(open_, hot, ["a"], "size", max(total, 1), "left") if hot.count() else open_.withColumn("salts", F.lit(None).cast("long"))
    placed = both.select("ord", "rk", "s", "data", salted.alias("salted"), F.when(salted, salt).otherwise(F.pmod(F.xxhash64("a"), F.lit(shards))).alias("shard"))
    out = C.stored(placed.groupBy("shard", "salted").applyInArrow(lambda t: within_shard(t, length), "ord long, rk long, s long, e long, window binary"))
    gone = out.where("window is null").drop("window")
    return gone.union(merged(out.where("window is not null"))) if hot.count() else gone


def repeated_spans(rows: DataFrame, spec: R.Spec = SPEC) -> DataFrame:
    """(ord, rk, spans): for each document the byte spans to remove; stored. ``rows`` from ``repeats.keyed``."""
    open_ = stretches(rows, spec)
    gone = later_windows(open_, spec)
    out = C.stored(gone.groupBy("ord", "rk").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    C.discard(open_)
    return out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: bytes, bytes removed, maximal removed runs, and the digest of the rest."""
    rows = R.keyed(docs)
    spans = repeated_spans(rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, runs, sha = [], [], [], []
        for i, text in enumerate(C.texts(batch)):
            data, mine = text.encode(), batch.column(2)[i]
            n.append(len(data))
            if mine.is_valid and len(data):
                cut = covered(len(data), mine.values)
                gone.append(int(cut.sum()))
                runs.append(int((cut & ~np.concatenate([[False], cut[:-1]])).sum()))
                data = np.frombuffer(data, np.uint8)[~cut].tobytes()
            else:
                gone.append(0)
                runs.append(0)
            sha.append(hashlib.sha256(data).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return C.arrow_map(rows.join(spans, ["ord", "rk"], "left").select("doc_id", "text", "spans"), run, OUT)
