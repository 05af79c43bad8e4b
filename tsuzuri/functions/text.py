"""Text functions as column expressions. Null gives null; a column that is no string raises TypeError where a data frame is at hand."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from . import arrays, plain
from . import tables as T

FINDING = T_.ArrayType(T_.StructType([T_.StructField("old", T_.StringType()), T_.StructField("new", T_.StringType()), T_.StructField("pos", T_.IntegerType())]))
FINDING_IN = T_.ArrayType(T_.StructType([*FINDING.elementType.fields, T_.StructField("category", T_.StringType())]))


def checked(df: DataFrame, name: str) -> Column:
    """The column, if it holds strings."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T_.StringType):
        raise TypeError(f"column {name} holds {kind.simpleString()}, not strings")
    return F.col(name)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _translate(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.translate(c, "".join(k for k, _ in pairs), "".join(v for _, v in pairs))


def convert_old_kanji(c: Column | str, tables: T.Tables | None = None) -> Column:
    return _translate(_col(c), (tables or T.defaults()).kanji)


def convert_hentaigana(c: Column | str, tables: T.Tables | None = None) -> Column:
    return _translate(_col(c), (tables or T.defaults()).hentaigana)


def convert_historical_kana(c: Column | str) -> Column:
    """The rules of one tail character (う, ウ) need one pass: the text is cut after each, and a piece's last two characters are looked up.

    The other rules come before. A text without any of the rules' tail characters is left as it is."""
    c = out = _col(c)
    first, second = T.kana_rules()
    out = _translate(out, tuple(p for p in first if len(p[0]) == 1))
    for old, new in (*first, *second):
        if len(old) > 1 and old[-1] not in "うウ":
            out = F.replace(out, F.lit(old), F.lit(new))
    ends = F.create_map(*(F.lit(x) for old, new in second if old[-1] in "うウ" for x in (old, new)))

    def piece(p: Column) -> Column:
        new = F.try_element_at(ends, F.substring(p, -2, 2))
        return F.when(new.isNull(), p).otherwise(F.concat(F.substring(p, F.lit(1), F.length(p) - 2), new))

    out = F.array_join(F.transform(F.split(out, "(?<=[うウ])", -1), piece), "")
    return F.when(c.rlike("[うウふフゎヮゐゑヰヱ]"), out).otherwise(c)


def convert_katakana_particles(c: Column | str) -> Column:
    out = _col(c)
    for pattern, _, new in plain.particle_rules():
        out = F.regexp_replace(out, pattern, new)
    return out


def convert(c: Column | str, tables: T.Tables | None = None) -> Column:
    """Old forms and variant kana in one pass (their tables share no key and make no chain), then kana and particles."""
    t = tables or T.defaults()
    return arrays.over(partial(arrays.convert, pairs=t.kanji + t.hentaigana), T_.StringType(), _col(c))


def nfkc(c: Column | str) -> Column:
    return arrays.over(arrays.nfkc, T_.StringType(), _col(c))


def correct_misreads(c: Column | str) -> Column:
    return _translate(_col(c), T.MISREADS)


def correct_context(c: Column | str) -> Column:
    out = _col(c)
    for pattern in plain.context_rules():
        out = F.regexp_replace(out, pattern, T.CONTEXT_MISREAD[1])
    return out


def punctuation(c: Column | str) -> Column:
    out = F.regexp_replace(F.translate(_col(c), ",", "、"), r"(?<!\p{Nd})\.(?!\p{Nd})", "。")
    return F.regexp_replace(F.regexp_replace(out, "。{2,}", "。"), "、{2,}", "、")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(T.WHITE))


def whitespace(c: Column | str) -> Column:
    lines = F.split(F.translate(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), "\r", "\n"), "\n", -1)
    return F.regexp_replace(F.array_join(F.transform(lines, strip), "\n"), "\n{3,}", "\n\n")


def split_header(c: Column | str) -> tuple[Column, Column]:
    """The leading lines that begin with # or are ---, and what follows."""
    lines = F.split(_col(c), "\n", -1)
    other = F.array_position(F.transform(lines, lambda x: x.startswith("#") | (strip(x) == "---")), False)
    n = F.when(other > 0, other - 1).otherwise(F.size(lines)).cast("int")
    return F.array_join(F.slice(lines, 1, n), "\n"), F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n")


def normalize_body(c: Column | str, tables: T.Tables | None = None) -> Column:
    return arrays.over(partial(arrays.normalize_body, kanji=(tables or T.defaults()).kanji), T_.StringType(), _col(c))


def normalize_text(c: Column | str, tables: T.Tables | None = None) -> Column:
    return arrays.over(partial(arrays.normalize_text, kanji=(tables or T.defaults()).kanji), T_.StringType(), _col(c))


def normalize_query(c: Column | str, tables: T.Tables | None = None) -> Column:
    return arrays.over(partial(arrays.normalize_query, kanji=(tables or T.defaults()).kanji), T_.StringType(), _col(c))


def _find_chars(c: Column | str, pairs: tuple[tuple[str, str], ...]) -> Column:
    """No table maps a character to itself, so what translation changes is a finding."""
    chars = F.transform(F.split(_col(c), ""), lambda x, i: F.struct(x.alias("old"), _translate(x, pairs).alias("new"), i.cast("int").alias("pos")))
    return F.filter(chars, lambda x: x["old"] != x["new"])


def find_old_kanji(c: Column | str, tables: T.Tables | None = None) -> Column:
    return _find_chars(c, (tables or T.defaults()).kanji)


def find_hentaigana(c: Column | str, tables: T.Tables | None = None) -> Column:
    return _find_chars(c, (tables or T.defaults()).hentaigana)


def find_historical_kana(c: Column | str) -> Column:
    return arrays.over(partial(arrays.findings, kinds=("kana",)), FINDING, _col(c))


def find_katakana_particles(c: Column | str) -> Column:
    return arrays.over(partial(arrays.findings, kinds=("particle",)), FINDING, _col(c))


def find_normalizations(c: Column | str) -> Column:
    return arrays.over(partial(arrays.findings, kinds=("normal",)), FINDING, _col(c))


def find(c: Column | str, tables: T.Tables | None = None) -> Column:
    t = tables or T.defaults()
    return arrays.over(partial(arrays.findings, kinds=("kana", "particle"), chars=(t.kanji, t.hentaigana), names=("kanji", "hentaigana", "kana", "particle")), FINDING_IN, _col(c))


def count_historical_kana(c: Column | str) -> Column:
    return arrays.over(arrays.kana_count, T_.IntegerType(), _col(c))


def count_katakana_particles(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(plain.any_particle()))


def count_chars(c: Column | str, pairs: tuple[tuple[str, str], ...]) -> Column:
    """How many characters are keys of a table."""
    keys = "".join(k for k, _ in pairs)
    return F.length(c) - F.length(F.translate(_col(c), keys, ""))


def count_normalizations(c: Column | str) -> Column:
    return count_chars(c, T.MISREADS) + sum((F.regexp_count(_col(c), F.lit(p)) for p in plain.context_rules()), F.lit(0))


def slug_from_image(path: Column | str) -> Column:
    """The file name without its last suffix; separators and blanks become hyphens."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), "([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")
    return F.coalesce(F.nullif(F.trim(F.translate(stem, "/\\ \x00\n\r\t", "-------"), F.lit("-")), F.lit("")), F.lit("untitled"))


def extract_title(c: Column | str, most: int = 40) -> Column:
    """The first line that is not blank, stripped, cut to ``most`` characters; else empty."""
    lines = F.transform(F.split(_col(c), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), strip)
    first = F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1))
    return F.when(_col(c).isNotNull(), F.coalesce(F.substring(first, 1, most), F.lit("")))


def created_at(ts: Column | str) -> Column:
    """ISO seconds in Japan's time of a UTC timestamp."""
    return F.date_format(F.from_utc_timestamp(_col(ts), "Asia/Tokyo"), "yyyy-MM-dd'T'HH:mm:ss'+09:00'")


def date_part(ts: Column | str) -> Column:
    return F.date_format(F.from_utc_timestamp(_col(ts), "Asia/Tokyo"), "yyyy-MM-dd")


def elapsed(seconds: Column | str) -> Column:
    return F.bround(_col(seconds), 2)


def image_name(base: str, i: Column, n: Column, suffix: Column) -> Column:
    """One image: base and suffix; several: numbered from 01."""
    return F.when(n == 1, F.concat(F.lit(base), suffix)).otherwise(F.format_string(f"{base}_%02d%s", i, suffix))


def kanji_table(spark: SparkSession, tables: T.Tables | None = None) -> DataFrame:
    return spark.createDataFrame(list((tables or T.defaults()).kanji), "old string, new string")


def hentaigana_table(spark: SparkSession, tables: T.Tables | None = None) -> DataFrame:
    return spark.createDataFrame(list((tables or T.defaults()).hentaigana), "old string, new string")


def register(spark: SparkSession, tables: T.Tables | None = None) -> None:
    """The scalar functions and a table function for SQL: convert(text), normalize_text(text), normalize_query(text), ..., and LATERAL find_conversions(text)."""
    t = tables or T.defaults()
    scalar = {"convert_old_kanji": lambda s: plain.convert_old_kanji(s, t), "convert_hentaigana": lambda s: plain.convert_hentaigana(s, t), "convert_historical_kana": plain.convert_historical_kana, "convert_katakana_particles": plain.convert_katakana_particles, "convert_text": lambda s: plain.convert(s, t), "normalize_text": lambda s: plain.normalize_text(s, t), "normalize_query": lambda s: plain.normalize_query(s, t), "nfkc": plain.nfkc}
    def over(fn):
        def run(s: pd.Series) -> pd.Series:
            return s.map(fn, na_action="ignore")

        return F.pandas_udf(run, "string")

    for name, fn in scalar.items():
        spark.udf.register(name, over(fn))

    class FindConversions:
        def eval(self, text: str):
            if text is not None:
                yield from plain.find(text, t)

    spark.udtf.register("find_conversions", F.udtf(FindConversions, returnType="old string, new string, pos int, category string"))
