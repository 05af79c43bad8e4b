import random

import corpus_pipeline as P
import numpy as np
import pytest
from tsuzuri.llm import near

from .test_simhash import brute_fingerprint
from .util import copies, table


def plain(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_kept(rows):
    """Least doc_id of each group, by search over all pairs."""
    sets = [(plain(t), brute_fingerprint(t)) for _, t in rows]
    seen, kept = set(), []
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, group = [i], [i]
        seen.add(i)
        while todo:
            x = todo.pop()
            for y in range(len(rows)):
                if y not in seen and (jaccard(sets[x][0], sets[y][0]) >= 0.8 or (sets[x][1] ^ sets[y][1]).bit_count() <= 4):
                    seen.add(y)
                    todo.append(y)
                    group.append(y)
        kept.append(min((rows[g][0] is None, rows[g][0]) for g in group)[1])
    return sorted(kept, key=str)


def planted(seed, n, low, high):
    """Pairs of texts with a similarity from low to high."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        a = [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(120, 400))]
        b = list(a)
        for _ in range(rng.randrange(1, 30)):
            b[rng.randrange(len(b))] = f"e{rng.randrange(10**6)}"
        if low <= jaccard(plain(" ".join(a)), plain(" ".join(b))) <= high:
            out.append((" ".join(a), " ".join(b)))
    return out


def test_pipeline_stage_finds_planted_copies(spark):
    pairs = planted(1, 60, 0.8, 0.95)
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = {r["doc_id"] for r in P.near_dedup(spark, table(spark, rows), "").collect()}
    assert kept == {2 * i for i in range(60)}


def test_less_similar_texts_stay(spark):
    pairs = planted(2, 40, 0.4, 0.6)
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    assert P.near_dedup(spark, table(spark, rows), "").count() == 80


@pytest.mark.parametrize("group", [near.GROUP, 3])
def test_against_search_over_all_pairs(spark, group):
    rows = copies(4, 40) + [(9000 + i, t) for i, p in enumerate(planted(3, 20, 0.7, 0.9)) for t in p]
    got = near.deduplicated(table(spark, rows), group)
    assert got.columns == table(spark, rows).columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == plain_kept(rows)


def test_bands_of_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 1000, np.uint64)
        a, b = np.sort(s[:900]), np.sort(s[100:])
        assert (near.bands(a) == near.bands(b)).any()


def test_empty(spark):
    assert near.deduplicated(table(spark, [(1, "x")]).where("doc_id = 0")).count() == 0


def test_search_links_all_that_are_similar_enough():
    texts = [" ".join(x) for p in planted(5, 30, 0.6, 0.95) for x in (p[0].split(), p[1].split())]
    sets = [near.shingles(t) for t in texts]
    got = near.linked(list(range(60)), sets)
    assert all(jaccard(plain(texts[a]), plain(texts[b])) >= 0.8 for a, b in got)
    assert len(got) == sum(jaccard(plain(texts[2 * i]), plain(texts[2 * i + 1])) >= 0.8 for i in range(30))
