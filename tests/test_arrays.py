import random

import pyarrow as pa
import pytest

from tsuzuri.functions import arrays as A
from tsuzuri.functions import plain as P
from tsuzuri.functions import tables as T
from tsuzuri.functions import text as X

POOLS = ["國會學經濟辨郧卜衠", "ノハニヲモガトヘシテヨリマデカラミ", "かうせうてふいうヰゑクヮグくゎ", "テフヤウニウセウカウー", " \n\r　\t#-.,。、12٣", "\U0001b002\U0001b006𠮷", "aあア①ｶﾞＡ", "\n\n\n   \x0b#---", ",.、。1"]
KINDS = ("kanji", "hentaigana", "kana", "particle")


def texts(n, rng):
    return ["".join(rng.choice(rng.choice(POOLS)) for _ in range(rng.randrange(40))) if rng.random() > 0.03 else None for _ in range(n)]


def found(kinds, chars=(), names=()):
    return lambda p: A.findings(p, kinds, chars, names)


t = T.defaults()
TWINS = [
    (found(("kana", "particle"), (t.kanji, t.hentaigana), KINDS), P.find),
    (found(("kana",)), P.find_historical_kana),
    (found(("particle",)), P.find_katakana_particles),
    (found(("normal",)), P.find_normalizations),
    (A.kana_count, lambda s: len(P.find_historical_kana(s))),
    (lambda p: A.convert(p, t.kanji + t.hentaigana), P.convert),
    (lambda p: A.normalize_query(p, t.kanji), P.normalize_query),
    (lambda p: A.normalize_text(p, t.kanji), P.normalize_text),
    (lambda p: A.normalize_body(p, t.kanji), P.normalize_body),
    (A.nfkc, P.nfkc),
]


@pytest.mark.parametrize("fn, twin", TWINS)
def test_slices_equal_single_texts(fn, twin):
    rng = random.Random(7)
    for n in [0, 1, 1, 2, *[5] * 40, *[150] * 10]:
        values = texts(n, rng) + rng.choice([[], [""], [None], ["", "う", "か", "う", "ニ", "シテ", "卜", "ア"]])
        got = [[tuple(f.values()) for f in x] if isinstance(x, list) else x for x in fn(pa.array(values, pa.string())).to_pylist()]
        assert got == [None if v is None else twin(v) for v in values]


def test_other_tables():
    odd = T.Tables.of({"國": "か", "甲": "①", "乙": "゙"}, {})  # values that NFKC changes or joins
    for s in ("國゙う", "甲國", "か乙う乙", "國゙甲乙"):
        assert A.normalize_query(pa.array([s]), odd.kanji).to_pylist() == [P.normalize_query(s, odd)]
        assert A.normalize_text(pa.array([s]), odd.kanji).to_pylist() == [P.normalize_text(s, odd)]


def test_a_batch_is_cut_into_slices(spark):
    """Workers hold a slice's findings, not those of all texts that they are sent at once."""
    values = ["國ノ" * (A.SLICE // 60)] * 40 + ["國"] + [None] * 3 + ["ノ" * A.SLICE]
    parts = [p for (p,) in A.slices(pa.array(values))]
    assert [v for p in parts for v in p.to_pylist()] == values
    assert len(parts) >= 5 and all(len(p) == 1 or sum(len((v or "").encode()) for v in p.to_pylist()) <= 2 * A.SLICE for p in parts)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string").coalesce(1)
    got = [r[0] for r in df.orderBy("i").select(X.find("text")).collect()]
    assert [None if g is None else [tuple(f) for f in g] for g in got] == [None if v is None else P.find(v) for v in values]


def brute_totals(rows):
    n, docs = {}, {}
    for i, title, modern in rows:
        for t in (title, modern):
            low = (t or "").lower()
            for k in range(len(low) - 2):
                n[low[k : k + 3]] = n.get(low[k : k + 3], 0) + 1
                docs.setdefault(low[k : k + 3], set()).update({i} - {None})
    return {(g, c, len(docs[g])) for g, c in n.items()}


def test_trigrams_are_counted_before_the_shuffle(spark, monkeypatch):
    from tsuzuri.operators import search

    rng = random.Random(3)
    rows = [(str(i // 2 if i < 6 else i), rng.choice(["", "ABa", None]), rng.choice(["", None, "x", "aba" * 3, "\U0001b002國aé" * 4])) for i in range(60)] + [(None, "aba", "ABAB")]
    docs = spark.createDataFrame(rows, "id string, title string, modern string")
    assert {tuple(r) for r in search.gram_totals(docs).collect()} == brute_totals(rows)
    unique = docs.where("id is not null").dropDuplicates(["id"])
    assert sorted(map(tuple, search.gram_sets(unique).collect())) == sorted(map(tuple, search.postings(unique).select("gram", "id").distinct().collect()))


def test_many_letters_are_counted_in_halves():
    import numpy as np

    texts = ["".join(map(chr, range(0x20000 + 40_000 * i, 0x20000 + 40_000 * (i + 1)))) for i in range(18)] + ["a" * 5] * 200_000
    parts = list(A._counted(texts, np.arange(len(texts))))
    assert len(parts) > 1 and sum(int(p[2].sum()) for p in parts) == sum(len(x) - 2 for x in texts) and sorted({int(r) for p in parts for r in p[1]}) == list(range(len(texts)))


def test_rewriting_and_recognition_see_slices(spark):
    import pandas as pd

    from tsuzuri.operators import rewrite
    from tsuzuri.plans import ocr

    docs = spark.createDataFrame([(i, "國" * 1999) for i in range(200)], "id int, text string").coalesce(1)
    out = rewrite.modernized(docs, lambda s: pd.Series([str(len(s))] * len(s)))
    assert max(int(r["modern"]) for r in out.collect()) <= 2 * A.SLICE // 6000
    pages = spark.createDataFrame([(bytearray(b"x" * 6000),)] * 200, "image binary").coalesce(1)
    read = ocr.recognized(pages, lambda s: pd.DataFrame({"text": [str(len(s))] * len(s), "elapsed_seconds": 0.5, "error": None}))
    assert max(int(r["ocr"]["text"]) for r in read.collect()) <= 2 * A.SLICE // 6000
