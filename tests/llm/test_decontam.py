import random

import pytest

from tsuzuri.llm import decontam as D

from .util import prose, table


def brute_tiles(a, b, least):
    """Longest common unmarked substring again and again, by search over all pairs of starts."""
    fa, fb, total = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        fa[i : i + k] = [False] * k
        fb[j : j + k] = [False] * k
        total.append(k)


@pytest.mark.parametrize("seed", range(8))
def test_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    a = [rng.randrange(4 if seed % 2 else 50) for _ in range(60)]
    b = [rng.randrange(4 if seed % 2 else 50) for _ in range(80)]
    for _ in range(3):
        i, j, n = rng.randrange(40), rng.randrange(50), rng.randrange(5, 20)
        b[j : j + n] = a[i : i + n]
    got = D.tiles(a, b, 5)
    assert all(a[i : i + k] == b[j : j + k] for i, j, k in got)
    for s in (0, 1):
        covered = [p for t in got for p in range(t[s], t[s] + t[2])]
        assert len(covered) == len(set(covered))
    if seed % 2 == 0:  # without ties any greedy order gives the same lengths
        assert sorted(k for _, _, k in got) == sorted(brute_tiles(a, b, 5))


def cases():
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng, rng.randrange(12, 60)))) for i in range(30)] + [(100, "too short"), (101, None), (102, ""), (None, "a b c d e f g"), (5, "w1 w2 w3 w4 w5 w6")]
    docs = [(i, " ".join(prose(rng, 120))) for i in range(40)]
    w = items[3][1].split()
    docs += [
        (100, docs[0][1] + " " + items[0][1].upper() + "! " + docs[1][1]),
        (101, " ".join(prose(rng, 30) + w[len(w) // 2 :] + prose(rng, 9) + w[: len(w) // 2])),
        (102, " ".join(prose(rng, 30) + items[4][1].split()[:5] + prose(rng, 30))),
        (103, (items[6][1] + ". ") * 20),
        (104, None), (105, ""), (None, items[7][1]), (100, docs[0][1] + " " + items[0][1].upper() + "! " + docs[1][1]),
    ]
    return docs, items


@pytest.mark.parametrize("most", [D.BROADCAST_CHARS, 0])
def test_documents(spark, most):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.matches(table(spark, docs), bench, most=most).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    bad = {d for d, rs in by.items() if rs[0]["contaminated"]}
    assert bad == {100, 101, 103, None}
    assert by[101][0]["item_id"] == 3 and by[101][0]["covered"] > 0.8 and len(by[100]) == 2
    index = D.Index(sorted((i, t) for i, t in items if i is not None and t is not None))
    for d, t in docs:
        want = D._verdict([(n, sum(brute_tiles(x, [index.vocabulary.get(w, -1) for w in D.words(t or "")], 5)), len(x)) for n, x in enumerate(index.items) if x and brute_tiles(x, [index.vocabulary.get(w, -1) for w in D.words(t or "")], 5)], index.ids, D.COVERAGE)
        r = by[d][0]
        assert (r["n_items"], r["item_id"], r["n_matched"], r["contaminated"]) == (want[0], want[1], want[2], want[4])
    kept = D.cleaned(table(spark, docs), bench, most=most)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad) and len(kept.columns) == 8


def test_empty(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.matches(table(spark, docs).where("doc_id = -1"), bench).count() == 0
    assert not any(r["contaminated"] for r in D.matches(table(spark, docs), bench.where("item_id = -1")).collect())
