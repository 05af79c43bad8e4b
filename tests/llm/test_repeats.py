import hashlib
import random

import numpy as np
import pytest

from tsuzuri.llm import common as C
from tsuzuri.llm import debruijn, suffix_array
from tsuzuri.llm import repeats as R

from .util import copies, table


def key(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def brute_words(rows, length=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            first[g] = min(first.get(g, 1 << 62), key(d))
    out = []
    for d, w in split:
        cut = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < key(d):
                cut[i : i + length] = [True] * length
        kept = [x for x, c in zip(w, cut) if not c]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def brute_bytes(rows, length=100):
    first, mine = {}, {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for r, (d, b) in enumerate(data):
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            first[g] = min(first.get(g, 1 << 62), key(d))
            mine.setdefault((r, g), i)
    out = []
    for r, (d, b) in enumerate(data):
        cut = [False] * len(b)
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            if first[g] < key(d) or mine[r, g] < i:
                cut[i : i + length] = [True] * length
        kept = bytes(x for x, c in zip(b, cut) if not c)
        runs = sum(c and not p for c, p in zip(cut, [False, *cut]))
        out.append((d, len(b), sum(cut), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (key(r[0]), *map(str, r[1:])))
    assert order([tuple(r) for r in got]) == order(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    rows = copies(seed)
    same(debruijn.dedup(table(spark, rows)).collect(), brute_words(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed):
    rows = copies(seed, 25)
    same(suffix_array.dedup(table(spark, rows)).collect(), brute_bytes(rows))


def test_small_blocks(spark, monkeypatch):
    """Texts longer than a block, in this process."""
    monkeypatch.setattr(R, "BLOCK", 64)
    rng = random.Random(5)
    u = np.array([rng.randrange(1 << 63) for _ in range(3000)], np.uint64)
    u[1000:1400] = u[100:500]
    u[2000:2300] = u[2000]
    at, x, leave, enter, _ = R.sample(u, np.array([3000]), debruijn.SPEC)
    monkeypatch.setattr(R, "BLOCK", 1 << 19)
    want = R.sample(u, np.array([3000]), debruijn.SPEC)
    assert (at == want[0]).all() and (x == want[1]).all()
    assert (R.at_positions(u, at, 16) == x).all()


def test_words_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 4)
    rows = copies(5)
    same(debruijn.dedup(table(spark, rows)).collect(), brute_words(rows))


@pytest.mark.parametrize("bloom,shard", [(0, 1 << 20), (10_000_000, 300), (0, 1)])
def test_bytes_joined_and_merged(spark, monkeypatch, bloom, shard):
    """Anchors joined instead of filtered; every anchor's stretches over several shards, so that the merge decides."""
    rng = random.Random(3)
    core = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + core + rng.choice(["u", "v"]) * 90) for i in range(40)] + copies(8, 8)
    monkeypatch.setattr(C, "HOT", 5)
    monkeypatch.setattr(suffix_array.stretches, "__defaults__", (bloom,))
    monkeypatch.setattr(suffix_array.later_windows, "__defaults__", (shard,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # windows go on over batches
    try:
        same(suffix_array.dedup(table(spark, rows)).collect(), brute_bytes(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_merge_is_one_exchange(spark):
    rows = [(i, i, 0, 3, bytearray([i % 5] * 3)) for i in range(50)]
    df = suffix_array.merged(spark.createDataFrame(rows, "ord long, rk long, s long, e long, window binary"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(window" in plan
    assert sorted(r["ord"] for r in df.collect()) == list(range(5, 50))


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    t = bytes(rng.choice(b"ab" if seed % 2 else b"abcdefgh\xff") for _ in range(400)) * (1 + seed % 3)
    a = np.frombuffer(t, np.uint8)
    sa = suffix_array.suffix_array(a)
    want = sorted(range(len(t)), key=lambda i: t[i:])
    assert sa.tolist() == want
    lcp = suffix_array.common_prefixes(a, sa)
    for i in range(1, len(t)):
        x, y = t[want[i - 1] :], t[want[i] :]
        n = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert lcp[i] == n


def test_empty(spark):
    empty = table(spark, [(1, "x")]).where("doc_id = 0")
    assert debruijn.dedup(empty).count() == 0 and suffix_array.dedup(empty).count() == 0
