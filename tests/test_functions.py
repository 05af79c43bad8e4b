import random

import pytest
from pyspark.sql import functions as F

from tsuzuri.functions import plain as P
from tsuzuri.functions import tables as T
from tsuzuri.functions import text as X

CONVERT = [("國會ニ於テ", "国会に於テ"), ("日本臣民ハ法律ノ定ムル所ニ從ヒ納稅ノ義務ヲ有ス", "日本臣民は法律の定ムル所に従ヒ納税の義務を有ス"), ("クヮウ", "コー"), ("ヰウ", "ユー"), ("という", "とゆう"), ("キウイ", "キューイ"), ("カウンター", "コーンター"), ("東京カラノミ", "東京からのみ"), ("東京ノミカラ", "東京のみカラ"), ("東京ニテ", "東京にて"), ("東京ヨリモ", "東京よりも"), ("彼ニハ", "彼ニハ"), ("さうだ、京都へ行かう", "そうだ、京都へ行こう"), ("テフテフ", "チョーチョー"), ("てふてふ", "ちょうちょう"), ("グヮイ", "ガイ"), ("辨瓣辯", "弁弁弁"), ("髙橋𠮷田﨑", "高橋吉田崎"), ("國會", "国会"), ("學問", "学問"), ("經濟", "経済"), ("劍法ニシテ", "剣法にして"), ("基礎トシテ", "基礎として"), ("東京ヨリ", "東京より"), ("\U0001b002\U0001b0e7ｶﾞｸ", "い\U0001b0e7ｶﾞｸ")]
NORMAL = [("# 題\n\n國民ノ義務,", "# 題\n\n\n国民の義務、"), ("忽然卜シテ", "忽然として"), ("コ卜卜", "コト卜"), ("郧衠", "郎術"), ("1,000圓", "1、000円"), ("…", "。"), ("①", "1"), ("3.14 a.b. ...", "3.14 a。b。 。"), ("第１號　ｶﾞｽ", "第1号 ガス"), ("　一\r\n\r\n\r\n\r\n二　", "一\n\n二"), ("#only\n", "#only\n"), ("", ""), ("---\n# a", "---\n# a"), ("\U0001b002", "\U0001b002"), ("\U0001b0e7", "\U0001b0e7")]


def column(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(fn("text")).collect()]


def test_golden_conversions(spark):
    got = column(spark, X.convert, [a for a, _ in CONVERT] + [None])
    assert got == [b for _, b in CONVERT] + [None]
    assert [P.convert(a) for a, _ in CONVERT] == got[:-1]


def test_golden_normalisation(spark):
    got = column(spark, X.normalize_text, [a for a, _ in NORMAL] + [None])
    assert got == [b for _, b in NORMAL] + [None]
    assert [P.normalize_text(a) for a, _ in NORMAL] == got[:-1]


def strings(n=120, seed=3):
    rng = random.Random(seed)
    pools = ["國會學經濟辨郧卜", "ノハニヲモガトヘシテヨリマデカラミ", "かうせうてふいうヰゑクヮ", "テフヤウニウセウカウ", " \n\r　\t#-.,。、12٣", "\U0001b002\U0001b006𠮷", "aあア①ｶﾞＡ"]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["convert_old_kanji", "convert_hentaigana", "convert_historical_kana", "convert_katakana_particles", "convert", "nfkc", "correct_misreads", "correct_context", "punctuation", "whitespace", "normalize_text", "normalize_query"])
def test_columns_equal_their_twins(spark, name):
    values = strings()
    assert column(spark, getattr(X, name), values) == [getattr(P, name)(v) for v in values]


@pytest.mark.parametrize("name", ["find_old_kanji", "find_hentaigana", "find_historical_kana", "find_katakana_particles", "find_normalizations", "find"])
def test_findings_equal_their_twins(spark, name):
    values = strings()
    got = [[tuple(f) for f in r] for r in column(spark, getattr(X, name), values)]
    assert got == [getattr(P, name)(v) for v in values]


def test_counts_equal_findings(spark):
    values = strings()
    assert column(spark, X.count_historical_kana, values) == [len(P.find_historical_kana(v)) for v in values]
    assert column(spark, X.count_katakana_particles, values) == [len(P.find_katakana_particles(v)) for v in values]
    assert column(spark, X.count_normalizations, values) == [len(P.find_normalizations(v)) for v in values]


def test_find_and_convert_differ():
    assert [f[0] for f in P.find_katakana_particles("東京カラノミ")] == ["カラ"] and P.convert("東京カラノミ") == "東京からのみ"
    assert len(P.find_normalizations("ア卜イ")) == 2


def test_types(spark):
    for bad in (123, None):
        with pytest.raises(TypeError):
            P.convert_old_kanji(bad)
    with pytest.raises(TypeError):
        X.checked(spark.range(1), "id")


def test_header(spark):
    df = spark.createDataFrame([("# a\n---\nb\n# c",), ("x",), ("# a",)], "text string")
    h, b = X.split_header("text")
    assert [tuple(r) for r in df.select(h, b).collect()] == [("# a\n---", "b\n# c"), ("", "x"), ("# a", "")]


def test_tables(spark, tmp_path):
    assert all(len(k) == len(v) == 1 and k != v for k, v in T.default_kanji().items())
    assert len(T.default_kanji()) == 384 and len(T.default_hentaigana()) == 259 and "\U0001b0e7" not in T.default_hentaigana()
    for old, new in ("爲為", "黑黒", "澁渋", "徵徴", "綠緑", "虛虚", "歷歴", "戀恋", "步歩", "每毎", "淚涙", "瀧滝", "擔担", "\uFA19神", "\uF9D0類", "\uFA57練", "\uFA67逸", "髙高", "﨑崎", "𠮷吉"):
        assert T.default_kanji()[old] == new
    assert [T.default_hentaigana()[c] for c in "\U0001b002\U0001b003\U0001b004"] == ["い"] * 3 and "\uFA46" not in T.default_kanji()
    assert sum(map(len, T.kana_rules())) == 92
    (tmp_path / "a.json").write_text('{"甲": "乙", "x": "yz", "丙": "丙"}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"甲": "丁"}', encoding="utf-8")
    t = T.Tables.read([str(tmp_path / "a.json"), str(tmp_path / "b.json")], [str(tmp_path / "a.json")])
    assert dict(t.kanji) == {"甲": "丁"} and P.convert("甲", t) == "丁" and T.default_hentaigana()["\U0001b002"] == "い"
    assert X.kanji_table(spark, t).collect() == [("甲", "丁")]


def test_names_and_titles(spark):
    paths = ["input/a b.png", "x/3.tar.png", "/", "a/--.png", "noext", "p/第一.JPG"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(X.slug_from_image("p")).collect()] == ["a-b", "3.tar", "untitled", "untitled", "noext", "第一"]
    titles = column(spark, X.extract_title, ["\n 　\n 題 \nx", "", None, "a\x0bb", "é" * 60])
    assert titles == ["題", "", None, "a", "é" * 40]
    row = spark.sql("select timestamp'2026-01-01 20:00:00' ts, 1.005D e").select(X.created_at("ts"), X.date_part("ts"), X.elapsed("e")).first()
    assert row[0] == "2026-01-02T05:00:00+09:00" and row[1] == "2026-01-02"


def test_sql_functions(spark):
    X.register(spark)
    assert spark.sql("select convert_text('國會ニ於テ'), normalize_query('關東大震災')").first()[:] == ("国会に於テ", "関東大震災")
    rows = spark.sql("select f.* from (select '國ノ' as t) d, lateral find_conversions(d.t) f").collect()
    assert [tuple(r) for r in rows] == [("國", "国", 0, "kanji"), ("ノ", "の", 1, "particle")]
    assert spark.range(1).select(F.lit(1)).count() == 1
