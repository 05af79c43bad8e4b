import difflib
import json
import os
import random
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsuzuri.operators import diff, images, index, library, rewrite, search
from tsuzuri.plans import ocr
from tsuzuri.sources import config, files
from tsuzuri.streaming import watch

BODIES = ["大日本帝國憲法は国会の定める所", "関東大震災の記録。震災後の復興。" * 4, "ABC abc ÉCOLE école", "aaaaaa", "", "短い", "国会議事堂と国会図書館と関東大震災"]


def corpus(spark, extra=()):
    rows = [(f"d{i}", "lib", f"題{i} 記録", b, "", float(i)) for i, b in enumerate([*BODIES, *extra])]
    return spark.createDataFrame(rows, "id string, dir string, title string, modern string, created_at string, mtime double"), rows


@pytest.mark.parametrize("query", ["国会議", "関東大震災", "abc", "école", "aaa", "震災後 関東大"])
def test_search_against_fts5(spark, query):
    rng = random.Random(5)
    docs, rows = corpus(spark, ["".join(rng.choice("国会関東大震災の記録abc ") for _ in range(80)) for _ in range(25)])
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table s using fts5(id unindexed, title, modern, tokenize='trigram')")
    con.executemany("insert into s values (?, ?, ?)", [(r[0], r[2], r[3]) for r in rows])
    terms = [t for t in query.split(" ") if len(t) >= 3]
    match = " AND ".join(f'"{t}"' for t in terms)
    want = {i: s for i, s in con.execute("select id, bm25(s) from s where s match ?", (match,))}
    got = {r["id"]: r["score"] for r in search.ranked(docs, terms).select("id", "score").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for i, s in con.execute("select id, snippet(s, 2, '[', ']', '...', 16) from s where s match ?", (match,)):
        body = next(r[3] for r in rows if r[0] == i)
        assert search.snippet(body, terms) == s or shared_characters(body, terms)


def shared_characters(text, terms):
    """Hits that share characters but no trigram: some versions of FTS5 then write a stretch twice."""
    at = sorted((m, m + len(t)) for t in terms for m in range(len(text)) if text.startswith(t, m))
    return any(b - 2 <= c < b for (_, b), (c, _) in zip(at, at[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_snippets_against_fts5(seed):
    rng = random.Random(seed)
    tried = 0
    while tried < 100:
        text = "".join(rng.choice(["国会関東大震災の記録abc ", "ab. :", "aあ。\n .", "abcdefgh. "][seed]) for _ in range(rng.choice([5, 17, 18, 19, 30, 80, 200])))
        terms = [t for _ in range(rng.choice([1, 1, 2])) for p in [rng.randrange(len(text))] if len(t := text[p : p + rng.randrange(3, 6)]) >= 3]
        con = sqlite3.connect(":memory:")
        con.execute("create virtual table s using fts5(title, modern, tokenize='trigram')")
        con.execute("insert into s values ('', ?)", (text,))
        row = con.execute("select snippet(s, 1, '[', ']', '...', 16) from s where s match ?", (" AND ".join(f'"{t}"' for t in terms),)).fetchone() if terms else None
        if row and not shared_characters(text, terms):
            assert search.snippet(text, terms) == row[0], (text, terms)
            tried += 1
    assert search.snippet("fgggf.dd", ["ggg", "ggf.d"]) == "f[gggf.d]d"


def test_queries(spark):
    docs, _ = corpus(spark)
    assert search.parse("關東大震災　國會議") == ["関東大震災", "国会議"]
    for bad in ("", "  　", "ab"):
        with pytest.raises(search.QueryError):
            search.parse(bad)
    hits = search.search(docs, "關東大震災").collect()
    assert [r["id"] for r in hits] == [r["id"] for r in search.ranked(docs, ["関東大震災"]).orderBy("score", "id").collect()]
    assert all("[関東大震災]" in r["snippet"] for r in hits)
    assert "[" not in search.snippet("本文だけ" * 20, ["題"])
    table = spark.createDataFrame([(1, "關東大震災"), (2, "ab"), (3, None), (4, "震災後 関東大"), (5, 'a"b\\E')], "query_id int, query string")
    got = sorted(map(tuple, search.query_matches(docs, search.postings(docs), table).collect()))
    assert got == [(1, "d1"), (1, "d6"), (4, "d1")]
    assert {r["query_id"]: r["status"] for r in search.query_terms(table).collect()} == {1: "ok", 2: "short", 3: "empty", 4: "ok", 5: "ok"}
    assert search.ranked(docs, ["a\\E(b"]).count() == 0


def write(root, doc_id, body="本文です", title="題", meta=None, raw="本文"):
    os.makedirs(f"{root}/{doc_id}", exist_ok=True)
    with open(f"{root}/{doc_id}/meta.json", "w", encoding="utf-8") as f:
        f.write(json.dumps({"title": title, "created_at": "2026-01-01T00:00:00+09:00"}, ensure_ascii=False) if meta is None else meta)
    for name, text in (("modern.txt", body), ("ocr_raw.txt", raw)):
        if text is not None:
            with open(f"{root}/{doc_id}/{name}", "w", encoding="utf-8") as f:
                f.write(text)


def test_index(spark, tmp_path):
    root = tmp_path / "library"
    lib = index.LibraryIndex(spark, str(root), str(tmp_path / "index"))
    assert lib.update() == index.IndexStats()
    assert lib.stat().first()["latest_doc_mtime"] is None
    for d in ("a", "b", "記録 1"):
        write(root, d, "関東大震災の記録")
    write(root, ".hidden")
    write(root, "broken", meta="not json")
    write(root, "nobody", body=None)
    assert lib.update() == index.IndexStats(added=3, skipped=2)
    assert lib.update() == index.IndexStats(skipped=2)
    write(root, "b", "新しい本文の記録")
    os.utime(root / "b" / "meta.json", (2_000_000_000, 2_000_000_000))
    os.remove(root / "a" / "meta.json")
    assert lib.update() == index.IndexStats(updated=1, removed=1, skipped=2)
    assert {r["id"] for r in lib.documents().collect()} == {"b", "記録 1"}
    assert [r["id"] for r in lib.search("關東大震災").collect()] == ["記録 1"]
    stat = lib.stat().first()
    assert stat["document_count"] == 2 and stat["db_size_bytes"] > 0 and stat["latest_doc_mtime"] == 2e9
    assert lib.rebuild() == index.IndexStats(added=2, skipped=2)
    assert "2 件" in library.stat_text(stat.asDict())


def test_index_touches_only_what_changed(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    root = tmp_path / "library"
    lib = index.LibraryIndex(spark, str(root), str(tmp_path / "index"))
    for i in range(12):
        write(root, f"d{i}", "".join(rng.choice("国会関東大震災の記録abc ") for _ in range(60)) + " 関東大震災 aaaa ABC", f"題{i}の記録")
    lib.update()
    first = set(os.listdir(tmp_path / "index"))
    write(root, "d[3]", "新しい関東大震災の記録")
    write(root, "d4", "関東大震災と国会議事堂")
    os.utime(root / "d4" / "meta.json", (2_000_000_000, 2_000_000_000))
    assert lib.update() == index.IndexStats(added=1, updated=1)
    (new,) = (x for x in os.listdir(tmp_path / "index") if x.startswith("s-") and x not in first)
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/index/{new}/documents").collect()} == {"d[3]", "d4"}
    docs = lib.documents()

    def check():
        for q in ("關東大震災", "aaa", "abc 関東大震災", "の記録"):
            got, want = (x.collect() for x in (lib.search(q, 5), search.search(docs, q, 5)))
            assert [(r["id"], round(r["score"], 9), r["snippet"], r["title"]) for r in got] == [(r["id"], round(r["score"], 9), r["snippet"], r["title"]) for r in want]

    check()
    plan = search.ranked_by_index(lib.postings(), lib.live(), ["関東大"])._jdf.queryExecution().executedPlan().toString()
    assert "modern" not in plan and "In(gram" in plan or "EqualTo(gram" in plan
    monkeypatch.setattr(index, "MOST_SEGMENTS", 1)
    assert lib.update() == index.IndexStats() and len(lib._segments()) == 1
    docs = lib.documents()
    check()
    monkeypatch.setattr(index, "LISTED", 0)
    assert lib.rebuild() == index.IndexStats(added=13)
    check()


def test_index_changes(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "id string, mtime double")
    new = spark.createDataFrame([("a", 1.0, True), ("b", 2.0, True), ("d", 1.0, True)], "id string, mtime double, readable boolean")
    assert index.counts(index.changes(old, new)).first()[:] == (1, 1, 1, 0)
    new = spark.createDataFrame([("a", 1.0, True), ("b", 2.0, False), ("d", 1.0, True)], "id string, mtime double, readable boolean")
    assert index.counts(index.changes(old, new)).first()[:] == (1, 0, 1, 1)


@pytest.mark.parametrize("small", [0, 40_000])
def test_segments_against_difflib(monkeypatch, small):
    monkeypatch.setattr(diff, "SMALL", small)
    rng = random.Random(2)
    for _ in range(60):
        a = "".join(rng.choice("国會ab") for _ in range(rng.randrange(90)))
        b = "".join(rng.choice(["", "x", c, c, c]) for c in a)
        want = [{"kind": k, "before": a[i:j], "after": b[m:n]} for k, i, j, m, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]
        assert diff.segments_of(a, b) == want


def test_diff(spark):
    df = spark.createDataFrame([("國", "国"), ("國民ノ義務", "国民の義務"), ("あ" * 100 + "國", "あ" * 100 + "国"), ("", ""), (None, "x")], "a string, b string").withColumn("s", diff.segments("a", "b"))
    rows = df.select(diff.deleted(F.col("s")), diff.added(F.col("s")), diff.rendered(F.col("s"), 10)).collect()
    assert rows[0][:] == (1, 1, "[-國-]{+国+}") and rows[1][:2] == (2, 2) and "中略80字" in rows[2][2] and rows[3][2] == "" and rows[4][2] is None
    stages = diff.stages(spark.createDataFrame([("x", "國民", "国民達")], "id string, ocr_raw string, modern string")).orderBy("stage").collect()
    assert [tuple(r)[1:] for r in stages] == [(1, 1, 1, "[-國-]{+国+}民"), (2, 0, 1, "国民{+達+}")]
    assert not diff.use_color(True, True, True)


def brute_chunks(s, size):
    if len(s) <= size:
        return [s]
    out, now = [], ""
    for x in (p + "。" for p in s.split("。") if p.strip()):
        if now and len(now) + len(x) > size:
            out.append(now)
            now = ""
        now += x
    return out + [now] * bool(now)


def test_chunks_and_rewriting(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("ab。 ") for _ in range(n)) for n in (0, 5, 30, 31, 80, 200)] + [" " * 50, "x" * 90]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")
    assert [r[0] for r in df.orderBy("id").select(rewrite.chunks(F.col("text"), 30)).collect()] == [brute_chunks(v, 30) for v in values]
    docs = spark.createDataFrame([(1, "# 題\n" + "あ。" * 30), (2, "#x"), (3, "い。")], "id int, text string")
    out = {r["id"]: r["modern"] for r in rewrite.modernized(docs, lambda s: s.str.upper() + " ", size=20).collect()}
    assert out == {1: "# 題\n\n" + "\n".join(["あ。" * 10] * 3), 2: "#x", 3: "い。"}
    m = df.select(rewrite.messages(F.col("text"), examples=[("a", "b")] * 3)).first()[0]
    assert len(m) == 8 and [x["role"] for x in m[:3]] == ["system", "user", "assistant"]


def test_records(spark):
    rows = [(i, b, i) for i, b in enumerate(["X", "X", "X-2", "Y", "X"])]
    ids = library.unique_ids(spark.createDataFrame(rows, "k int, base string, arrival int"), spark.createDataFrame([("X",), ("Y",), ("Y-2",)], "id string"))
    assert [r["id"] for r in ids.orderBy("k").collect()] == ["X-2", "X-3", "X-2-2", "Y-3", "X-4"]
    rows = [(i, b, i) for i, b in enumerate(["a", "b-7", "a", "a", "c", "b-7", "a"])]
    taken = spark.createDataFrame([(x,) for x in ("a-1", "a-2", "a-3", "a-05", "a-x", "a-5-2", "b", "b-7-2", "a-5")], "id string")
    ids = library.unique_ids(spark.createDataFrame(rows, "k int, base string, arrival int"), taken)
    assert [r["id"] for r in ids.orderBy("k").collect()] == ["a", "b-7", "a-4", "a-6", "c", "b-7-3", "a-7"]
    docs = spark.sql("select array('input/a b.png', 'input/c.png') source_paths, '\n題\n本文' ocr_raw, '本文' modern, named_struct('model', 'm', 'prompt', 'p', 'elapsed_seconds', 1.239D) ocr, named_struct('old_kanji', true, 'historical_kana', true, 'ocr_misread_correction', true) normalization, named_struct('enabled', false, 'model', '') modernize, cast(null as array<string>) tags, cast(null as string) note, 1 arrival")
    rec = library.records(docs, F.lit("2026-05-24 01:00:00").cast("timestamp"), spark.createDataFrame([], "id string"))
    r = rec.first()
    assert r["id"] == "2026-05-24_a-b" and r["meta"]["title"] == "題" and r["meta"]["sources"] == ["source_01.png", "source_02.png"] and r["meta"]["ocr"]["elapsed_seconds"] == 1.24
    with pytest.raises(Exception, match="source image"):
        library.records(docs.withColumn("source_paths", F.array().cast("array<string>")), F.current_timestamp(), spark.createDataFrame([], "id string")).collect()


def test_export(spark, tmp_path):
    docs = spark.sql("select 'x' id, 'r' ocr_raw, 'm' modern, named_struct('id', 'x', 'title', '題') meta, array('in/a.png', 'in/b.png') source_paths, array('source_01.png', 'source_02.png') sources")
    pages = spark.createDataFrame([("in/a.png", bytearray(b"A")), ("in/b.png", bytearray(b"B")), ("in/c.png", bytearray(b"C"))], "path string, content binary")
    assert library.export(docs, library.folder(str(tmp_path)), pages) == 1
    assert json.load(open(f"{tmp_path}/x/meta.json", encoding="utf-8")) == {"id": "x", "title": "題"}
    assert sorted(os.listdir(tmp_path / "x")) == ["meta.json", "modern.txt", "ocr_raw.txt", "source_01.png", "source_02.png"] and (tmp_path / "x" / "source_02.png").read_bytes() == b"B"
    texts = spark.createDataFrame([("a_modern.txt", "一\n二")], "name string, result string")
    assert library.write_texts(texts, library.folder(str(tmp_path)), where="out") == 1 and (tmp_path / "out" / "a_modern.txt").read_text(encoding="utf-8") == "一\n二"


def test_text_files_and_postprocessing(spark, tmp_path):
    for n, t in (("b.txt", "國ノ卜カ"), ("a.txt", "x\r\ny"), ("a_modern.txt", "z")):
        (tmp_path / n).write_bytes(t.encode())
    df = files.text_files(spark, str(tmp_path))
    assert [(r["stem"], r["value"]) for r in df.collect()] == [("a", "x\ny"), ("b", "國ノ卜カ")]
    out = {r["stem"]: r for r in library.change_counts(library.postprocess(df)).collect()}
    assert out["b"]["result"] == "国ノトカ" and out["b"]["n_misread"] == 2 and out["a"]["n_particle"] == 0
    assert files.text_files(spark, str(tmp_path / "none")).count() == 0


def bars(angle=0.0):
    g = np.full((120, 160), 255, np.uint8)
    for y in range(20, 100, 16):
        g[y : y + 6, 20:140] = 0
    return images.rotate(g, angle) if angle else g


def test_images(spark):
    png = images.encode_png(np.repeat(bars()[:, :, None], 3, axis=2))
    assert (images.decode(png)[:, :, 0] == bars()).all()
    out, steps, _ = images.preprocess(png, images.Options(binarize="otsu"))
    assert steps == ["grayscale", "denoise", "clahe", "binarize:otsu"] and set(np.unique(images.decode(out))) <= {0, 255}
    assert 2 <= abs(images.skew_angle(bars(5))) <= 8 and images.skew_angle(np.full((50, 50), 255, np.uint8)) == 0
    straight, steps, _ = images.preprocess(images.encode_png(bars(5)), images.Options(denoise=False, contrast=False))
    assert steps[1].startswith("deskew:") and abs(images.skew_angle(images.gray(images.decode(straight)))) < 1.5
    df = spark.createDataFrame([(bytearray(png),), (bytearray(b"x"),)], "content binary")
    rows = images.preprocessed(df, images.Options(denoise=False)).collect()
    assert rows[0]["prep"]["error"] is None and rows[1]["prep"]["error"]


def engine(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"text": [f" 國{len(x) % 7} " for x in s], "elapsed_seconds": 0.5, "error": [None if len(x) > 5 else "unreadable" for x in s]})


def test_pages_to_documents(spark, tmp_path):
    for s, names in (("s1", ("p001.png", "p002.PNG", "note.txt")), ("s2", ("p001.png",))):
        os.makedirs(tmp_path / s)
        for n in names:
            (tmp_path / s / n).write_bytes(images.encode_png(bars()) if s == "s1" else b"bad")
    pages = files.images(spark, f"{tmp_path}/*/*")
    assert [(r["session"], r["page"]) for r in pages.orderBy("session", "page").collect()] == [("s1", 1), ("s1", 2), ("s2", 1)]
    docs = ocr.run(pages, engine, images.Options(denoise=False), rewriter=lambda s: s + "!").collect()
    assert len(docs) == 1 and docs[0]["session"] == "s1" and docs[0]["ocr_raw"].count("\n\n") == 1 and docs[0]["modern"].startswith("国") and docs[0]["modern"].endswith("!") and docs[0]["elapsed_seconds"] == 1.0
    assert ocr.run(pages, engine, separate=True, normalize=False).count() == 2
    more = spark.createDataFrame([("s", i, f"p{i}", bytearray(b"x" * (3 if i == 3 else 9))) for i in range(1, 6)], "session string, page int, path string, content binary")
    assert sorted(r["session"] for r in ocr.run(more, engine, separate=True, normalize=False).collect()) == ["p1", "p2"]
    assert files.validated(spark.createDataFrame([("a.webp",), ("a.gif",)], "path string")).where("image_error is null").count() == 1


def test_streams(spark, tmp_path):
    root = tmp_path / "library"
    write(root, "a", "関東大震災")
    watch.keep_index(spark, str(root), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)
    assert index.LibraryIndex(spark, str(root), str(tmp_path / "index")).documents().count() == 1
    assert watch.new_images(spark, f"{root}/*").isStreaming


def test_diff_sources(spark, tmp_path):
    write(tmp_path, "a", "国", raw="國")
    write(tmp_path, "b", body=None)
    good, bad = files.diff_pairs(spark, str(tmp_path), ["a", "b", "c"])
    assert [r["id"] for r in good.collect()] == ["a"]
    assert {r["id"]: r["missing"] for r in bad.collect()} == {"b": ["modern.txt"], "c": ["ocr_raw.txt", "modern.txt"]}


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[search]\nlimit = 5\n")
    c = config.load(str(p))
    assert c.get("search.limit") == 5 and c.get("search.min_query_chars") == 3 and c.get("x.y", 1) == 1 and c.get("llm")["top_k"] == 40
    assert c.get("search") == {"limit": 5, "min_query_chars": 3} and c.get("search.limit.x", "no") == "no" and c.get("searc") is None
    p.write_text("[broken")
    with pytest.raises(config.ConfigError):
        config.load(str(p))
    assert config.load(str(tmp_path / "none")).get("chunk.size") == 2000


def test_empty_files_and_line_ends(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for n, t in (("a b.txt", ""), ("c.txt", "x\r\ny\rz"), ("d.txt", "é")):
        (tmp_path / "in" / n).write_bytes(t.encode())
    assert [(r["stem"], r["value"]) for r in files.text_files(spark, str(tmp_path / "in"), line_ends=False).collect()] == [("a%20b", ""), ("c", "x\r\ny\rz"), ("d", "é")]
    assert [r["value"] for r in files.text_files(spark, str(tmp_path / "in")).collect()] == ["", "x\ny\nz", "é"]
    write(tmp_path / "lib", "a", body="", raw="")
    write(tmp_path / "lib", "b")
    assert [tuple(r) for r in files.library(spark, str(tmp_path / "lib")).select("id", "modern", "ocr_raw").orderBy("id").collect()] == [("a", "", ""), ("b", "本文です", "本文")]


def test_text_files_of_odd_rows(spark, tmp_path):
    import hashlib

    from tsuzuri.plans import file_queries

    rows = [(1, "a"), (2, ""), (4, None), (5, "x\r\ny"), (7, "a\rb"), (8, "﻿bom"), (3, "c"), (None, "n"), (10, "\n"), (11, "nul\x00")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, file_queries.text_files(spark, str(tmp_path)).collect()))
    assert got == sorted((f"d{i}", None if x is None else hashlib.md5(x.encode()).hexdigest()) for i, x in rows if i is not None and i % 3)
