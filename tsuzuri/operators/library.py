"""Documents as records: unique folder names, meta.json, export, and post-processing of text files."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from . import rewrite

SCHEMA_VERSION = 1


def unique_ids(records: DataFrame, existing: DataFrame, base: str = "base", order: str = "arrival") -> DataFrame:
    """``records`` with ``id``: the base name, or with -2, -3, ... where that is taken by an existing id or an earlier record.

    A base's k-th record takes the k-th number that no existing id has. Only where one base looks like another one with a number do their
    records see each other's names; these few names are given in turn."""
    root = lambda c: F.regexp_replace(c, r"(-[0-9]+)+$", "")
    rows = records.withColumn("__root", root(F.col(base)))
    taken = existing.select(root(F.col("id")).alias("__root"), F.col("id").alias("__taken"))
    mixed = rows.groupBy("__root").agg(F.min(base).alias("a"), F.max(base).alias("b")).where("a <> b").select("__root")

    plain = rows.join(mixed, "__root", "left_anti")
    digits = F.regexp_extract(F.expr("substr(__taken, length(__base) + 2)"), "^([2-9]|[1-9][0-9]{1,8})$", 1)
    number = F.when(F.col("__taken") == F.col("__base"), 1).when(F.col("__taken").startswith(F.concat("__base", F.lit("-"))), digits.try_cast("int"))
    numbers = plain.select("__root", F.col(base).alias("__base")).distinct().join(taken, "__root").select("__base", number.alias("n")).where("n is not null")
    # free numbers below each taken one
    free = numbers.groupBy("__base").agg(F.transform(F.array_sort(F.collect_set("n")), lambda n, i: n - i - 1).alias("__free"))
    given = plain.withColumn("__k", F.row_number().over(Window.partitionBy(base).orderBy(order))).join(free.withColumnRenamed("__base", base), base, "left")
    n = F.col("__k") + F.coalesce(F.size(F.filter("__free", lambda f: f < F.col("__k"))), F.lit(0))
    given = given.withColumn("id", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string"))))

    def place(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        used, ids, last = set(right["__taken"]), [], {}
        left = left.sort_values(order, kind="stable")
        for b in left[base]:
            n, name = last.get(b, 1), b if last.get(b, 1) == 1 else f"{b}-{last[b]}"
            while name in used:
                n += 1
                name = f"{b}-{n}"
            used.add(name)
            last[b] = n
            ids.append(name)
        return left.drop(columns="__root").assign(id=ids)

    schema = records.drop("id").schema.add("id", "string")
    few = rows.drop("id").join(mixed, "__root", "left_semi")
    turned = few.groupBy("__root").cogroup(taken.join(mixed, "__root", "left_semi").groupBy("__root")).applyInPandas(place, schema)
    return given.select(*schema.names).unionByName(turned)


def meta(now: Column) -> Column:
    """The record's meta.json as a struct. Columns: id, ocr_raw, sources, ocr, normalization, modernize, tags, note."""
    return F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "id", X.created_at(now).alias("created_at"), X.extract_title("ocr_raw").alias("title"), "sources", F.struct(F.col("ocr.model"), F.col("ocr.prompt"), X.elapsed("ocr.elapsed_seconds").alias("elapsed_seconds")).alias("ocr"), "normalization", "modernize", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("note", F.lit("")).alias("note"))


def records(docs: DataFrame, now: Column, existing: DataFrame, paths: str = "source_paths") -> DataFrame:
    """Documents ready to store: id, meta, ocr_raw, modern. A document without source images is an error."""
    n = F.size(paths)
    first = F.element_at(paths, 1)
    checked = docs.withColumn(paths, F.when(n > 0, F.col(paths)).otherwise(F.raise_error(F.lit("a record needs at least one source image"))))
    based = checked.withColumn("base", F.concat(X.date_part(now), F.lit("_"), X.slug_from_image(first)))
    named = unique_ids(based, existing)
    ext = lambda p: F.regexp_extract(p, r"(\.[^./]+)$", 1)
    return named.withColumn("sources", F.transform(paths, lambda p, i: X.image_name("source", i + 1, F.size(paths), ext(p)))).withColumn("meta", meta(now))


Writer = Callable[[str, str, bytes], None]


def folder(root: str) -> Writer:
    """Writes ``name`` into the folder ``id`` under ``root``, a path that all executors share."""

    def write(doc_id: str, name: str, data: bytes) -> None:
        os.makedirs(os.path.join(root, doc_id), exist_ok=True)
        with open(os.path.join(root, doc_id, name), "wb") as f:
            f.write(data)

    return write


def _each(rows: DataFrame, put: Callable[[tuple], int]) -> int:
    """``put`` for each row, in the tasks; the sum of what it gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [sum(put(r) for pdf in batches for r in pdf.itertuples(index=False))]})

    return rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def export(docs: DataFrame, write: Writer, pages: DataFrame | None = None) -> int:
    """Write each record's ocr_raw.txt, modern.txt and meta.json with ``write(id, name, data)`` from the tasks; the number of records.

    With ``pages`` (path, content) also a copy of its source images, under the names in its meta.json. A record that is written again is replaced."""

    def put(r: tuple) -> int:
        write(r.id, "ocr_raw.txt", r.ocr_raw.encode())
        write(r.id, "modern.txt", r.modern.encode())
        write(r.id, "meta.json", (json.dumps(json.loads(r.meta), ensure_ascii=False, indent=2) + "\n").encode())
        return 1

    def copy(r: tuple) -> int:
        write(r.id, r.name, bytes(r.content))
        return 1

    if pages is not None:
        names = docs.select("id", F.explode(F.arrays_zip("source_paths", "sources")).alias("x")).select("id", F.col("x.source_paths").alias("path"), F.col("x.sources").alias("name"))
        _each(names.join(pages.select("path", "content"), "path").select("id", "name", "content"), copy)
    return _each(docs.select("id", "ocr_raw", "modern", F.to_json("meta", {"ignoreNullFields": "true"}).alias("meta")), put)


def write_texts(df: DataFrame, write: Writer, name: str = "name", text: str = "result", where: str = "") -> int:
    """A text file for each row, line ends as they are; the number of files. For converted texts and joined pages, see output_name() and batch_name()."""

    def put(r: tuple) -> int:
        write(where, r.name, r.text.encode())
        return 1

    return _each(df.select(F.col(name).alias("name"), F.col(text).alias("text")), put)


def postprocess(df: DataFrame, text: str = "value", out: str = "result", normalize: bool = True, rewriter: Callable | None = None, key: str = "path", tables: T.Tables | None = None) -> DataFrame:
    """Optional normalisation, then optional rewriting."""
    df = df.withColumn(out, X.normalize_text(text, tables) if normalize else F.col(text))
    return rewrite.modernized(df, rewriter, out, out + "_new", key).drop(out).withColumnRenamed(out + "_new", out) if rewriter else df


def change_counts(df: DataFrame, text: str = "value") -> DataFrame:
    """With n_misread, n_kana and n_particle of the original text; kana are counted in Arrow slices."""
    return df.withColumns({"n_misread": X.count_normalizations(text), "n_kana": X.count_historical_kana(text), "n_particle": X.count_katakana_particles(text)})


def output_name(stem: Column, suffix: Column) -> Column:
    return F.concat(stem, F.lit("_modern"), suffix)


def batch_name(df: DataFrame, group: str, stem: str = "stem", page: str = "page") -> DataFrame:
    """(group, name): {first}-{last}_modern.txt, or {stem}_modern.txt of a single one."""
    ends = df.groupBy(group).agg(F.min_by(stem, page).alias("a"), F.max_by(stem, page).alias("b"))
    return ends.select(group, F.concat(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("-", "a", "b")), F.lit("_modern.txt")).alias("name"))


def hits_json(hits: DataFrame) -> str:
    """A limited result as a JSON array."""
    return json.dumps([r.asDict() for r in hits.collect()], ensure_ascii=False, indent=2)


def hits_text(hits: DataFrame, limit: int) -> str:
    """A limited result as text."""
    rows = hits.collect()
    out = []
    for r in rows:
        out += [f"{r['id']}  {r['title'] or '(タイトルなし)'}", f"  {r['dir']}", f"  {r['snippet']}", f"  {r['created_at']}", ""]
    return "\n".join([*out, f"{len(rows)} 件" + (f" (上限 {limit} 件)" if len(rows) >= limit else "")])


def stat_text(stat: dict) -> str:
    """A statistics row as text: size in KB, last change in local time."""
    import datetime

    last = stat["latest_doc_mtime"]
    when = "-" if last is None else datetime.datetime.fromtimestamp(last).strftime("%Y-%m-%d %H:%M:%S")
    return f"{stat['library_root']}\n{stat['document_count']} 件\n{stat['db_size_bytes'] / 1024:.1f} KB\n{when}"
