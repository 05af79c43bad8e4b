"""A text of a million characters, and one line of as many, through the operators that take texts whole."""

import random
import zlib

from tsuzuri.llm import debruijn, decontam, pst, quality, sharding, simhash, suffix_array

from .test_pst import base
from .test_repeats import brute_bytes, brute_words, same
from .test_simhash import brute_fingerprint
from .util import prose, table


def rows():
    rng = random.Random(12)
    long = " ".join(prose(rng, 150_000, 30_000))
    return [(1, long), (2, long + " tail"), (3, "short text"), (4, "x" * 1_000_000), (None, None)]


def test_long_texts(spark):
    docs = rows()
    df = table(spark, docs)
    item = " ".join(docs[0][1].split()[149_950:])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontam.matches(df, bench).collect()} == {1: True, 2: True, 3: False, 4: False, None: False}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard(df, 3).collect()} == {d: (len(t or "") + 16, zlib.crc32((t or "").encode())) for d, t in docs}
    near = {r["doc_id"]: r for r in simhash.near_copies(df).collect()}
    assert all(near[d]["fingerprint"] == f"{brute_fingerprint(t or ''):016x}" for d, t in docs) and near[2]["component_id"] == 1
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(df).collect()} == {d: len((t or "").split()) for d, t in docs}
    want = base(docs)
    for r, (d, t) in zip(sorted(pst.scored(df).collect(), key=lambda r: r["doc_id"] or 9), sorted(docs, key=lambda x: x[0] or 9)):
        assert (r["doc_id"], r["n_tokens"], r["n_known"]) == (d, *want[d, t][1:3]) and abs(r["base_score"] - want[d, t][4]) < 1e-6 * abs(want[d, t][4]) + 1e-9
    same(debruijn.dedup(df).collect(), brute_words(docs))


def test_long_bytes(spark):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    docs = [(1, long + long[:5000]), (2, long[150_000:]), (3, "ab" * 60_000)]
    same(suffix_array.dedup(table(spark, docs)).collect(), brute_bytes(docs))
