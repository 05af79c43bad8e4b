"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased. A seed is ``MIN_MATCH`` tokens in a row that a document shares with a benchmark item; documents
without one are done. For the others, the longest unmarked common substring is marked again and again, until none of ``MIN_MATCH`` tokens is
left: running Karp-Rabin hashes of s tokens find matches of at least s, s falling. Tiles do not overlap, in the document or in
the item, but their order is free, so reordered passages are caught. If tiles cover at least ``COVERAGE`` of an item's tokens, the document is contaminated.

Up to ``BROADCAST_CHARS`` of benchmark text go to every task; beyond that, seeds of both sides meet in a join of hashes.

Defined results: null or empty text has no tokens and is clean; items with fewer tokens than a seed, or null ones, match nothing; a null
doc_id stays null; repeated rows give equal rows; of items covered equally the least item_id is named, and of tiles of one length the first found is
marked first; texts are read whole, whatever their length; an empty table or benchmark gives no matches; other columns, whatever their
names, are kept by ``cleaned`` and ignored by ``matches``.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

MIN_MATCH, COVERAGE, BROADCAST_CHARS = 5, 0.5, 8_000_000
_TOKEN = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    return _TOKEN(text.lower())


def tiles(item: list[int], text: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first. Negative tokens match nothing."""
    out: list[tuple[int, int, int]] = []
    free_a, free_b = [x >= 0 for x in item], [x >= 0 for x in text]
    s = max(least, 20)
    while True:
        longest, found = _scan(item, text, free_a, free_b, s)
        if longest > 2 * s:
            s = longest
            continue
        _mark(found, free_a, free_b, s, out)
        if s > 2 * least:
            s //= 2
        elif s > least:
            s = least
        else:
            return out


def _grams(x: list[int], free: list[bool], s: int):
    """(start, running Karp-Rabin hash) of each s unmarked tokens in a row."""
    mod, base = (1 << 61) - 1, 1_000_003
    lead = pow(base, s, mod)
    run = h = 0
    for i, v in enumerate(x):
        if not free[i]:
            run = h = 0
            continue
        h = (h * base + v + 1) % mod
        run += 1
        if run > s:
            h = (h - (x[i - s] + 1) * lead) % mod
        if run >= s:
            yield i - s + 1, h


def _scan(a: list[int], b: list[int], free_a: list[bool], free_b: list[bool], s: int) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    """Maximal matches of s or more unmarked tokens, by length. Stops at one longer than 2 s."""
    at = defaultdict(list)
    for i, h in _grams(a, free_a, s):
        at[h].append(i)
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    longest = 0
    for j, h in _grams(b, free_b, s) if at else ():
        for i in at.get(h, ()):
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of a match that begins earlier
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                k += 1
            if k > 2 * s:
                return k, found
            if k >= s:
                found[k].append((i, j))
                longest = max(longest, k)
    return longest, found


def _mark(found: dict[int, list[tuple[int, int]]], free_a: list[bool], free_b: list[bool], s: int, out: list[tuple[int, int, int]]) -> None:
    while found:
        k = max(found)
        for i, j in found.pop(k):
            # of a match that tiles have cut, the longest unmarked rest
            best, run = (0, 0), 0
            for x in range(k + 1):
                if x < k and free_a[i + x] and free_b[j + x]:
                    run += 1
                    best = max(best, (run, -(x - run + 1)))
                else:
                    run = 0
            n, x = best[0], -best[1]
            if n < s:
                continue
            if n < k:
                found.setdefault(n, []).append((i + x, j + x))
                continue
            free_a[i : i + k] = [False] * k
            free_b[j : j + k] = [False] * k
            out.append((i, j, k))


class Index:
    """The benchmark's items as tokens, and its seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_MATCH) -> None:
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.items = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)] for _, t in items]
        hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n, x in enumerate(self.items):
            if len(x) >= least:
                h = np.unique(H.windows(H.prefixes(H.mix(np.array(x, np.uint64) + np.uint64(1))), least))
                hashes.append(h)
                owner.append(np.full(len(h), n))
        h, o = np.concatenate(hashes), np.concatenate(owner)
        order = np.lexsort((o, h))
        self.seeds, self.owner = h[order], o[order]

    def match(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(item, tokens in tiles, tokens of the item) of each item that shares a seed."""
        k, get = self.least, self.vocabulary.get
        x = np.array([get(w, -1) for w in tokens], np.int64)
        if len(x) < k or not len(self.seeds):
            return []
        bad = np.concatenate([[0], np.cumsum(x < 0)])
        at = np.flatnonzero(bad[k:] == bad[:-k])
        if not len(at):
            return []
        p = H.prefixes(H.mix((x + 1).astype(np.uint64)))
        h = H.span_hash(p, at, at + k)
        lo, hi = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, "right")
        hits: dict[int, list[int]] = defaultdict(list)
        for i in np.flatnonzero(hi > lo).tolist():
            for n in self.owner[lo[i] : hi[i]].tolist():
                hits[n].append(int(at[i]))
        out = []
        for n, starts in sorted(hits.items()):
            text: list[int] = []
            last = -1
            for s in starts:  # only where seeds are
                if s > last:
                    text.append(-1)
                    text += x[s : s + k].tolist()
                else:
                    text += x[last : s + k].tolist()
                last = s + k
            out.append((n, sum(t[2] for t in tiles(self.items[n], text, k)), len(self.items[n])))
        return out


def _verdict(found: list[tuple[int, int, int]], ids: list[int], coverage: float) -> tuple[int, int | None, int, float, bool]:
    """Items covered, and the one covered most (ties: the least id) with its tokens in tiles and share."""
    if not found:
        return 0, None, 0, 0.0, False
    hit = sum(m >= coverage * n for _, m, n in found)
    n, m, size = min(found, key=lambda f: (-f[1] / f[2], ids[f[0]]))
    return hit, ids[n], m, m / size, hit > 0


OUT = "doc_id long, n_items long, item_id long, n_matched long, covered double, contaminated boolean"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).distinct()


def _index(benchmark: DataFrame, least: int, most: int) -> Index | None:
    """None if the benchmark is larger than ``most`` characters."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.length("item"))).first()[0] or 0) > most:
        return None
    return Index(sorted((r["item_id"], r["item"]) for r in items.collect()), least)


def _joined(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """(rk, found): tiles with items by a join of seed hashes; only documents that share one. A filter of the benchmark's seeds goes to all tasks, and seeds that very many documents hold are joined apart."""

    def seeds(batch: pa.RecordBatch, wanted: C.Bloom | None = None) -> pa.RecordBatch:
        hs = []
        for text in C.texts(batch):
            x = np.fromiter(map(xxhash.xxh64_intdigest, words(text)), np.uint64)
            h = np.unique(H.windows(H.prefixes(x), least)).view(np.int64)
            hs.append(h[wanted.has(h)] if wanted else h)
        who = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(np.concatenate(hs))], ["key", "seed"])

    rows = C.id_text(docs).select(C.row_key().alias("rk"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["rk"])
    items = _items(benchmark).withColumn("ik", F.xxhash64("item_id", "item"))
    b = C.stored(C.arrow_map(items.select("ik", F.col("item").alias("text")), seeds, "key long, seed long").groupBy("seed").agg(F.collect_set("key").alias("iks")))
    shared = docs.sparkSession.sparkContext.broadcast(C.Bloom.of(C.stored(b.select(F.col("seed").alias("key")))))
    a = C.stored(C.arrow_map(rows, lambda batch: seeds(batch, shared.value), "key binary, seed long"))
    often = C.stored(b.join(a.groupBy("seed").agg(F.count("*").alias("n")), "seed"))
    pairs = C.stored(C.join_hot(a, often, ["seed"], "n", max(a.count(), 1)).select(F.col("key").alias("rk"), F.explode("iks").alias("ik")).distinct())

    def tile(batch: pa.RecordBatch) -> pa.RecordBatch:
        rk, item_id, m, size = [], [], [], []
        for key, text, i, item in zip(*(batch.column(c).to_pylist() for c in range(4))):
            found = Index([(i, item)], least).match(words(text))
            for _, matched, n in found:
                rk.append(key), item_id.append(i), m.append(matched), size.append(n)
        return pa.RecordBatch.from_arrays([pa.array(rk, pa.binary()), *(pa.array(x, pa.int64()) for x in (item_id, m, size))], ["rk", "item_id", "m", "size"])

    return C.arrow_map(pairs.join(items, "ik").join(rows, "rk").select("rk", "text", "item_id", "item"), tile, "rk binary, item_id long, m long, size long")


def matches(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, most: int = BROADCAST_CHARS) -> DataFrame:
    """A row for each document: items covered, the one covered most, its tokens in tiles, its covered share, and the verdict."""
    index = _index(benchmark, least, most)
    if index is not None:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [_verdict(shared.value.match(words(t)), shared.value.ids, coverage) for t in C.texts(batch)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], [x.split()[0] for x in OUT.split(", ")])

        return C.arrow_map(C.id_text(docs), run, OUT)
    best = F.min(F.struct((-F.col("m") / F.col("size")).alias("c"), "item_id", "m", "size")).alias("b")
    of = _joined(docs, benchmark, least).groupBy("rk").agg(F.sum((F.col("m") >= coverage * F.col("size")).cast("long")).alias("n"), best)
    rows = C.id_text(docs).select("doc_id", C.row_key().alias("rk")).join(of, "rk", "left")
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_items"), F.col("b.item_id").alias("item_id"), F.coalesce("b.m", F.lit(0)).alias("n_matched"), F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("covered"), (F.coalesce("n", F.lit(0)) > 0).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, most: int = BROADCAST_CHARS) -> DataFrame:
    """The documents that are not contaminated; columns as they were."""
    index, schema = _index(benchmark, least, most), docs.schema
    if index is not None:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([not _verdict(shared.value.match(words(t)), shared.value.ids, coverage)[-1] for t in C.texts(batch)], pa.bool_()))

        return C.arrow_map(docs, run, schema)
    bad = _joined(docs, benchmark, least).where(F.col("m") >= coverage * F.col("size")).select(F.col("rk").alias("__rk")).distinct()
    return docs.withColumn("__rk", C.row_key()).join(bad, "__rk", "left_anti").select(*docs.columns)
