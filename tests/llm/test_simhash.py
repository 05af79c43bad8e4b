import random

import numpy as np
import pytest
import xxhash

from tsuzuri.llm import common as C
from tsuzuri.llm import simhash as S

from .util import copies, table


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    """Root of each fingerprint by search over all pairs."""
    fps, out = sorted(set(fps)), {}
    a = np.array(fps, np.uint64)
    for f in fps:
        if f in out:
            continue
        todo, out[f] = [f], f
        while todo:
            x = todo.pop()
            for y in a[np.bitwise_count(a ^ np.uint64(x)) <= bits].tolist():
                if y not in out:
                    out[y] = f
                    todo.append(y)
    return out


def brute(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fp)
    least = {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    return [(d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(rows, fp)]


def test_against_brute_force(spark):
    rows = copies(4, 60) + [(5000 + i, " ".join(f"q{(j * (i == k)) }r{j}" for j in range(90))) for i in range(6) for k in (0,)]
    got = [tuple(r) for r in S.near_copies(table(spark, rows)).collect()]
    order = lambda x: sorted(x, key=str)
    assert order(got) == order(brute(rows))


@pytest.mark.parametrize("bucket", [S.BUCKET, 50])
@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_skewed_fingerprints(spark, seed, bucket):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(200):
            y = x
            for _ in range(rng.randrange(0, 6)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    df = C.stored(spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long"))
    forest = S.Forest()
    for a, b in S.links(df, 4, bucket).collect():
        a, b = int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))
        assert (a ^ b).bit_count() <= 4
        forest.join(a, b)
    want = brute_components(fps)
    assert {f: forest.root(f) for f in fps} == want


def test_large_run_by_search():
    rng = random.Random(8)
    x = rng.getrandbits(64)
    fps = list({x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(900)} | {rng.getrandbits(64) for _ in range(100)})
    forest = S.Forest()
    found = S.linked(np.array(fps, np.uint64), np.array([0]), 4, forest)
    assert {f: forest.root(f) for f in fps} == brute_components(fps) and len(found) < len(fps)


def test_plans_cover_every_distance():
    rng = np.random.default_rng(1)
    for n in (10, 10**5, 10**8, 10**11):
        how = S.plan(rng.integers(0, 1 << 63, 500).astype(np.uint64), n, 4)
        assert sum(t + 1 for _, t in how) >= 5
        bits = [b for g, _ in how for b in g]
        assert len(bits) == len(set(bits))


def test_one_row_of_each_component_stays(spark):
    rows = copies(4, 30)
    kept = S.deduplicated(table(spark, rows))
    root = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for d, t in rows:
        k = (d is None, d)
        f = root[brute_fingerprint(t)]
        least[f] = min(least.get(f, k), k)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for _, d in least.values()), key=str)
    assert kept.columns == table(spark, rows).columns


def test_empty(spark):
    assert S.near_copies(table(spark, [(1, "x")]).where("doc_id = 0")).count() == 0
