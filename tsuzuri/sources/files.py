"""Sources: a library of document folders, text files, page images, stored documents for a diff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = "schema_version int, id string, created_at string, title string, sources array<string>, ocr struct<model:string,prompt:string,elapsed_seconds:double>, normalization struct<old_kanji:boolean,historical_kana:boolean,ocr_misread_correction:boolean>, modernize struct<enabled:boolean,model:string>, tags array<string>, note string, preprocessed_sources array<string>, preprocess struct<enabled:boolean,steps:array<string>,elapsed_seconds:double>"
# Suffixes of page images in a folder, and those that recognition takes.
FOLDER_IMAGES = (".png", ".jpg", ".jpeg", ".tiff", ".bmp")
OCR_IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif")


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def spread(df: DataFrame) -> DataFrame:
    """A scan over as many tasks as there are cores, where the files give fewer (one row group is one task): for costly expressions on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _name(path: Column, up: int = 0) -> Column:
    """The path's last part, or that of its parent."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1 - up)


def _empty(files: DataFrame) -> DataFrame:
    """(path, mtime, value) of the files without content, which a scan leaves out; their time is not known here."""
    spark, jvm = files.sparkSession, files.sparkSession._jvm
    names = spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles()), jvm.org.apache.spark.sql.Encoders.STRING())
    missing = DataFrame(names.toDF(), spark).select(F.regexp_replace("value", "^(\\w+):///", "$1:/").alias("path")).join(files.select(F.col("_metadata.file_path").alias("path")), "path", "left_anti")
    return missing.select("path", F.lit(None).cast("double").alias("mtime"), F.lit("").alias("value"))


def whole_texts(spark: SparkSession, pattern: str | Sequence[str], line_ends: bool = True) -> DataFrame:
    """(path, mtime, value): each file as one text, an empty one too, line ends as LF (or as they are); none if nothing matches. A list names existing files."""
    if not (pattern if not isinstance(pattern, str) else _exists(spark, pattern)):
        return spark.createDataFrame([], "path string, mtime double, value string")
    scan = spark.read.text(pattern if isinstance(pattern, str) else list(pattern), wholetext=True)
    files = scan.select(F.col("_metadata.file_path").alias("path"), (F.unix_micros("_metadata.file_modification_time") / 1e6).alias("mtime"), "value")
    empty = _empty(scan)
    files = files if empty.isEmpty() else files.union(empty)  # looked up once: what reads the files again later does not look again
    return files.withColumn("value", F.regexp_replace("value", "\r\n?", "\n")) if line_ends else files


def _id(path: Column) -> Column:
    """The folder's name."""
    return F.url_decode(F.replace(_name(path, 1), F.lit("+"), F.lit("%2B")))


def listing(spark: SparkSession, root: str, name: str = "meta.json") -> DataFrame:
    """(id, path, mtime) of a file of each document folder directly under root, none with a dot in front. No content is read."""
    pattern = f"{root.rstrip('/')}/*/{name}"
    if not _exists(spark, pattern):
        return spark.createDataFrame([], "id string, path string, mtime double")
    found = spark.read.format("binaryFile").load(pattern).select("path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    return found.select(_name(F.col("path"), 1).alias("id"), "path", "mtime").where(~F.col("id").startswith("."))


def library(spark: SparkSession, root: str, ids: Sequence[str] | None = None) -> DataFrame:
    """(id, dir, mtime, meta, modern, ocr_raw) of each document folder directly under root that has a meta.json and no dot in front, or of some. What can't be read is null."""
    root = root.rstrip("/")

    def texts(name: str) -> DataFrame:
        pattern: str | list[str] = f"{root}/*/{name}"
        if ids is not None:
            pattern = [r["path"] for r in listing(spark, root, name).where(F.col("id").isin(*ids)).collect()] if ids else []
            if any(c in p for p in pattern for c in "[]{}*?\\"):  # names that a path pattern would read otherwise
                pattern = f"{root}/*/{name}"
        found = whole_texts(spark, pattern).withColumn("id", _id(F.col("path")))
        return found if ids is None else found.where(F.col("id").isin(*ids) if ids else F.lit(False))

    meta = texts("meta.json").where(~F.col("id").startswith("."))
    meta = meta.select("id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "mtime", F.from_json("value", META, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m"), F.col("value").rlike(r"^\s*\{").alias("obj"), F.expr("try_parse_json(value)").isNotNull().alias("json"))
    meta = meta.select("id", "dir", "mtime", F.when(F.col("obj") & F.col("json"), F.col("m")).alias("meta"))
    return meta.join(texts("modern.txt").select("id", F.col("value").alias("modern")), "id", "left").join(texts("ocr_raw.txt").select("id", F.col("value").alias("ocr_raw")), "id", "left")


def text_files(spark: SparkSession, path: str, line_ends: bool = True) -> DataFrame:
    """(path, stem, value) of a text file, or of a folder's .txt files without those already converted (stem ends in _modern)."""
    single = path.endswith(".txt")
    files = whole_texts(spark, path if single else f"{path.rstrip('/')}/*.txt", line_ends).withColumn("stem", F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", ""))
    return (files if single else files.where(~F.col("stem").endswith("_modern"))).select("path", "stem", "value").orderBy("path")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def images(spark: SparkSession, pattern: str, suffixes: Sequence[str] = FOLDER_IMAGES) -> DataFrame:
    """(session, page, path, content): images by folder, pages numbered by file name."""
    from pyspark.sql import Window

    if not _exists(spark, pattern):
        return spark.createDataFrame([], "session string, page int, path string, content binary")
    found = spark.read.format("binaryFile").load(pattern).where(suffix(F.col("path")).isin(*suffixes))
    page = F.row_number().over(Window.partitionBy("session").orderBy("path"))
    numbered = found.select(_name(F.col("path"), 1).alias("session"), "path").withColumn("page", page)  # the window moves no image bytes
    return found.select("path", "content").join(numbered, "path").select("session", "page", "path", "content")


def validated(df: DataFrame, path: str = "path") -> DataFrame:
    """With ``image_error``: null if recognition can take the file."""
    return df.withColumn("image_error", F.when(~suffix(F.col(path)).isin(*OCR_IMAGES), F.concat(F.lit("unsupported image type: "), suffix(F.col(path)))))


def diff_pairs(spark: SparkSession, root: str, ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, ocr_raw, modern) of stored documents, and (id, missing) of those asked for that lack a file."""
    docs = library_texts(spark, root)
    if ids is not None:
        docs = spark.createDataFrame([(i,) for i in ids], "id string").join(docs, "id", "left")
    missing = F.array_compact(F.array(F.when(F.col("ocr_raw").isNull(), F.lit("ocr_raw.txt")), F.when(F.col("modern").isNull(), F.lit("modern.txt"))))
    tagged = docs.withColumn("missing", missing)
    return tagged.where(F.size("missing") == 0).drop("missing"), tagged.where(F.size("missing") > 0).select("id", "missing")


def library_texts(spark: SparkSession, root: str) -> DataFrame:
    root = root.rstrip("/")
    raw, modern = (whole_texts(spark, f"{root}/*/{n}.txt").select(_name(F.col("path"), 1).alias("id"), F.col("value").alias(n)) for n in ("ocr_raw", "modern"))
    return raw.join(modern, "id", "full_outer")
