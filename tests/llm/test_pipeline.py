import hashlib
import random

import corpus_pipeline as P
from tsuzuri.llm import common as C
from tsuzuri.llm import decontam, pii, quality, simhash
from tsuzuri.llm.queries import tokenizer_files

from .test_simhash import brute_components, brute_fingerprint
from .test_text_operators import plain_pii, quality_rows, sample_texts
from .util import table


def rows():
    items = [(1, " ".join(f"item{j}" for j in range(30))), (2, " ".join(f"other{j}" for j in range(20)))]
    docs = quality_rows() + [(600 + i, t + " " + " ".join(f"x{i}y{j}" for j in range(60)), "hostA") for i, t in enumerate(sample_texts()[:20])]
    docs += [(700, " ".join(f"u{j}" for j in range(60)) + " " + items[0][1], "hostA"), (701, None, "hostA")]
    base = [f"n{j}" for j in range(900)]
    docs += [(800 + i, " ".join([*base[:i], "changed", *base[i:]]), "hostB") for i in range(4)]
    return docs, items


def test_stages_and_run(spark, tmp_path):
    docs, items = rows()
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = C.documents(spark, str(tmp_path))
    seen = [now.collect()]
    for _, stage in P.STAGES:
        now = C.stored(stage(spark, now, str(tmp_path)))
        seen.append(now.collect())
    assert [set(r.asDict()) for s in seen[1:-1] for r in s[:1]] == [set(seen[0][0].asDict())] * 4
    by = [{r["doc_id"]: r for r in s} for s in seen]
    # quality: verdicts of the query
    kept = {r["doc_id"] for r in quality.judge(C.documents(spark, str(tmp_path)), by="texts").collect() if r["kept"]}
    assert set(by[1]) == kept and all(r["n_chars"] == len(r["text"]) for r in seen[1])
    # one of each group, by search over all pairs
    fp = {d: brute_fingerprint(r["text"]) for d, r in by[1].items()}
    root = brute_components(fp.values())
    assert set(by[2]) == {min(d for d in fp if root[fp[d]] == g) for g in set(root.values())}
    assert 400 in by[2] and 401 not in by[2]
    # benchmark items
    index = decontam.Index(items)
    assert set(by[3]) == {d for d, r in by[2].items() if not any(m >= 0.5 * n for _, m, n in index.match(decontam.words(r["text"])))} and 700 not in by[3]
    # personal data
    assert set(by[4]) == set(by[3]) and any(plain_pii(r["text"]) for r in seen[3]) and not any(plain_pii(r["text"]) for r in seen[4])
    assert all(by[4][d]["text"] == r["text"] for d, r in by[3].items() if not plain_pii(r["text"]) and not pii.candidates(r["text"], []))
    # encoding
    import tiktoken

    from tsuzuri.llm.bpe import read_ranks

    path, pattern = tokenizer_files()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    want = sorted((d, len(ids := enc.encode_ordinary(r["text"])), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for d, r in by[4].items())
    assert sorted(map(tuple, seen[5])) == want
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).collect())) == want
    assert simhash.BUCKET and 4 <= len(P.STAGES) <= 5


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, a very long text, an empty table and an empty benchmark."""
    rng = random.Random(6)
    body = lambda k, n=80: " ".join(f"k{k}w{rng.randrange(10**6)}" for _ in range(n))
    copy, null_only = body(1), body(2)
    docs = [(None, copy), (5, copy), (5, copy), (None, null_only, None), (None, null_only, None), (6, None), (7, ""), (8, " \n "), (9, body(3, 60_000), None), (None, body(4), "hostA"), (10, body(5) + " mail a.b@c.de " + "x" * 5000)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = C.documents(spark, str(tmp_path))
    columns = now.columns
    for _, stage in P.STAGES[:-1]:
        now = C.stored(stage(spark, now, str(tmp_path)))
        assert now.columns == columns
    left = sorted((str(r["doc_id"]), r["text"][:20]) for r in now.collect())
    assert left == sorted((str(d), t[:20]) for d, t in [(5, copy), (None, null_only), (9, docs[8][1]), (None, docs[9][1]), (10, docs[10][1])])
    assert all(r["n_chars"] == len(r["text"]) and "a.b@c.de" not in r["text"] for r in now.collect())
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(d for d, _ in left)
    empty = table(spark, docs).where("n_chars = -1")
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
