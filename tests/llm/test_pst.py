import math
import random
import zlib
from collections import Counter

import pytest

from tsuzuri.llm import common as C
from tsuzuri.llm import pst

from .util import copies, prose, table


def words(t):
    return [*(t or "").encode().lower().split(), None]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0


def base(rows):
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {(d, t): (held(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for d, t in rows}


def check_base(spark, rows):
    got = pst.scored(table(spark, rows)).collect()
    want = base(rows)
    assert len(got) == len(rows)
    key = lambda r: tuple(map(str, r))
    a = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key)
    b = sorted(((d, *want[d, t][:4], round(want[d, t][4], 6)) for d, t in rows), key=key)
    assert a == b
    return got


def test_base_counts(spark):
    check_base(spark, copies(6, 40))


def markov(rng, n):
    out, follow = [], {f"s{i}": [f"s{(i * 7 + j) % 30}" for j in range(3)] for i in range(30)}
    w = "s0"
    for _ in range(n):
        w = rng.choice(follow[w]) if rng.random() < 0.9 else f"s{rng.randrange(30)}"
        out.append(w)
    return " ".join(out)


def brute_tree(rows, depth=pst.DEPTH):
    """Retained contexts with their share for the suffix and their entries, by counting word tuples; and the probability of a word after others."""
    texts = [words(t) for d, t in rows if not held(d)]
    n = Counter(tuple(t[i : i + k]) for t in texts for k in range(1, depth + 2) for i in range(len(t) - k + 1))
    total, distinct = sum(map(len, texts)), len({w for t in texts for w in t})
    size = lambda c: n[c] if c else total
    tree = {}
    for k in range(1, depth + 1):
        follow = {}
        for g, c in n.items():
            if len(g) == k + 1 and c >= pst.MIN_ENTRY and n[g[:-1]] >= pst.MIN_CONTEXT:
                follow.setdefault(g[:-1], []).append((g[-1], c))
        for ctx, found in follow.items():
            ratio = sum(c * math.log(c / size(ctx) / (n[(*ctx[1:], w)] / size(ctx[1:]))) for w, c in found)
            if ratio - len(found) > math.log(total):
                tree[ctx] = (1 - sum((c - 0.5) / size(ctx) for _, c in found), {w: (c - 0.5) / size(ctx) for w, c in found})

    def p(before, w):
        out = (n[(w,)] + 0.1) / (total + 0.1 * (distinct + 1))
        for k in range(1, min(depth, len(before)) + 1):
            if (ctx := tuple(before[-k:])) in tree:
                rest, entries = tree[ctx]
                out = entries.get(w, 0.0) + rest * out
        return out

    return tree, p


def check_scores(spark, rows):
    tree, p = brute_tree(rows)
    got = check_base(spark, rows)
    want = sorted((str(d), sum(math.log10(p(w[:i], w[i])) for i in range(len(w)))) for d, t in rows for w in [words(t)])
    for (d, x), (e, y) in zip(sorted((str(r["doc_id"]), r["score"]) for r in got), want):
        assert d == e and abs(x - y) < 1e-6 * max(1, abs(y)), (d, x, y)
    return tree, got


@pytest.mark.parametrize("cache", [pst.CACHE, 0])
def test_scores_against_brute_force(spark, monkeypatch, cache):
    """A tree that goes to the tasks, and one that is joined; with hot keys, and with a filter too small to tell."""
    monkeypatch.setattr(pst, "CACHE", cache)
    rng = random.Random(1)
    rows = [(i, markov(rng, 60)) for i in range(80)] + copies(6, 25) + [(None, markov(rng, 9)), (90, "x " * 4000)]
    rows += [(9000 + i, f"{'ab'[i % 2]} m n out{i % 2}") for i in range(90)]
    if not cache:
        monkeypatch.setattr(C, "HOT", 20)
        monkeypatch.setattr(pst, "BLOOM_BITS", 64)
        monkeypatch.setattr(pst, "SYMBOLS", 10)
        monkeypatch.setattr(pst, "TASKS", 0)
        monkeypatch.setattr(C.Bloom, "LISTED", 0)
    tree, _ = check_scores(spark, rows)
    assert {len(c) for c in tree} == {1, 2, 3}


def test_contexts_help_on_held_out_text(spark):
    rng = random.Random(1)
    rows = [(i, markov(rng, 150)) for i in range(200)]
    got = check_base(spark, rows)
    out = [r for r in got if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out)
    assert gain > 0.3


def test_unrelated_words_retain_little(spark):
    rng = random.Random(2)
    rows, _, model = pst.numbered(pst.split(table(spark, [(i, " ".join(prose(rng, 150, 40))) for i in range(100)])))
    pst.grow(rows.where("not held_out").select("t"), model, 3)
    assert model.contexts.count() <= 40


def test_lookup():
    rng = random.Random(7)
    for n in (0, 1, 5, 3000):
        import numpy as np

        keys = np.array([rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)], np.int64)
        x = np.concatenate([keys, np.array([rng.randrange(-(1 << 63), 1 << 63) for _ in range(50)] + [0, -1], np.int64)])
        table_ = pst.Lookup(keys, np.arange(n))
        i = table_.find(x)
        assert (table_.values[i[:n]] == np.arange(n)).all() and (i[n:] == -1).all()


def test_rare_contexts_count_in_a_large_corpus(spark):
    """A phrase found a few times is kept, however many other tokens there are."""
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 400, 3000))) for i in range(120)]
    rows += [(1000 + i, " ".join([*prose(rng, 20, 3000), "alpha w1 beta gamma", *prose(rng, 20, 3000)])) for i in range(24)]
    tree, got = check_scores(spark, rows)
    assert (b"alpha",) in tree
    by = {r["doc_id"]: r for r in got}
    assert all((by[1000 + i]["score"] - by[1000 + i]["base_score"]) > 1 for i in range(24))


def test_probabilities_sum_to_one():
    rng = random.Random(3)
    rows = [(i, markov(rng, 100)) for i in range(60)]
    _, p = brute_tree(rows)
    known = {w for d, t in rows if not held(d) for w in words(t)}
    for before in (["s1"], ["s1", "s2", "s3"], ["nothing"]):
        assert abs(sum(p(before, w) for w in known) + p(before, "unseen") - 1) < 1e-9


def test_no_training_and_empty(spark):
    rows = [(d, "one two") for d in range(100) if held(d)]
    got = pst.scored(table(spark, rows)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 for r in got) and got
    assert pst.scored(table(spark, [(1, "x")]).where("doc_id = 0")).count() == 0


def test_a_large_tree_joins_rare_keys_only(spark, monkeypatch):
    """Of a tree beyond the cache, frequent keys stay with the tasks, the others are joined in slices, and the scores are the same."""
    rng = random.Random(6)
    rows = [(i, markov(rng, 60)) for i in range(200)]
    tree, _ = brute_tree(rows)
    keys = len(tree) + sum(len(entries) for _, entries in tree.values())
    every = sum(tuple(w[i - k : i]) in tree for _, t in rows for w in [words(t)] for i in range(len(w)) for k in range(1, min(i, pst.DEPTH) + 1))
    opened, write = [], C.stored

    def stored(df, *codec):
        out = write(df, *codec)
        if "open" in out.columns:
            opened.append(out.selectExpr("coalesce(sum(size(open)), 0)").first()[0])
        return out

    monkeypatch.setattr(C, "stored", stored)
    monkeypatch.setattr(pst, "CACHE", keys // 2)
    monkeypatch.setattr(pst, "SLICE", 100, raising=False)
    check_scores(spark, rows)
    assert 0 < sum(opened) < every / 2
