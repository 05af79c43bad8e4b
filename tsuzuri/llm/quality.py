"""Quality rules: base counts of a text, and line frequency across the documents of a host.

A line is normalised (white space collapsed, case folded by Unicode rules) and hashed. For each host, the distinct documents that
hold it are counted. A line in ``MAX_DOCS`` documents or more is boilerplate however large the host is; so is one in ``MIN_DOCS``
or more that are over ``MAX_SHARE`` of the host's documents. Such lines are removed everywhere on that host, and a document whose
words are mostly gone is rejected. ``by="texts"`` counts distinct texts instead, so that exact copies do not make their own
lines frequent: for use before a stage that removes copies.

Counting shuffles hashes, never texts: (host, line, document) is made distinct first, so a line that a third of all documents
hold is spread over as many tasks as it has documents, then pre-aggregated. To find their rows, very frequent lines are broadcast
(their number is bounded, see ``common.join_hot``), and all others are joined.

Defined results: null text has no words and fails the base rule; a null host is a host of its own; rows of one doc_id are one
document (of a null doc_id: rows of one text); repeated rows count once and give equal rows; limits are met by equality (MAX_DOCS,
MIN_DOCS), the share must be exceeded; a text is read whole, whatever its length; an empty table gives an empty result; other
columns, whatever their names, are kept by ``filtered`` and ignored by ``judge``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_DOCS, MIN_DOCS, MAX_SHARE, MIN_LEFT = 20, 5, 0.2, 0.5
_SYMBOL = re.compile(r"[#*$%&|<>]")


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == n:
        return 0
    first: dict = {}
    again = np.zeros(n, bool)
    for i, j in enumerate(map(first.setdefault, grams, range(n))):
        if i != j:
            again[i] = again[j] = True
    cover = np.zeros(n + 2, bool)
    for k in range(3):
        cover[k : n + k] |= again
    return int(cover.sum())


def line_hash(words: list[bytes]) -> int:
    """Of a line's words, as a signed 64-bit number."""
    x = xxhash.xxh64_intdigest(b" ".join(words).decode("utf-8", "replace").casefold().encode(), 7)
    return x - (1 << 64) if x >> 63 else x


def measure(text: str) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words in each distinct line hash (all its copies)."""
    data = text.encode()
    words = data.split()
    chars = len(text) - (len(data) - sum(map(len, words)))
    dup, seen, lines = 0, set(), {}
    for line in data.split(b"\n"):
        parts = line.split()
        if parts:
            if line in seen:
                dup += 1
            seen.add(line)
            h = line_hash(parts)
            lines[h] = lines.get(h, 0) + len(parts)
    return len(words), chars, len(_SYMBOL.findall(text)), dup, repeat_words(words), lines


BASE = "doc_id long, host string, row_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base counts, a hash of the text and its lines, for each row; stored, so that row_id holds."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), F.monotonically_increasing_id().alias("row_id"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for text in C.texts(batch):
            n, chars, symbols, dup, rep, lines = measure(text)
            row = (xxhash.xxh64_intdigest(text.encode(), 11) - (1 << 63), n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n, list(lines), list(lines.values()))
            for c, x in zip(cols, row):
                c.append(x)
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "host", "row_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines", "sizes"]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return C.stored(C.arrow_map(own, run, BASE + ", lines array<long>, sizes array<long>"))


def frequent_lines(rows: DataFrame, by: str = "documents", max_docs: int = MAX_DOCS, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, docs) of the lines above the limits."""
    if by not in ("documents", "texts"):
        raise ValueError(f"by must be documents or texts, not {by!r}")
    who = [F.col("text_hash").alias("t")] if by == "texts" else [F.col("doc_id").alias("d"), F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("t")]
    each = rows.select("host", *who, F.explode("lines").alias("line")).distinct()
    counts = each.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    hosts = rows.select(F.col("host").alias("h"), *who).distinct().groupBy("h").agg(F.count("*").alias("host_docs"))
    often = (F.col("docs") >= max_docs) | (F.col("docs") > max_share * F.col("host_docs"))
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(often).select("host", "line", "docs")


def holders(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(row_id, line, size): where the rows hold one of the ``lines`` (stored)."""
    mine = rows.select("row_id", F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("none"), F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("row_id", "h", "none", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    total = rows.agg(F.sum(F.size("lines"))).first()[0] or 0
    bad = lines.select(F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("none"), "line", "docs")
    return C.join_hot(mine, bad, ["h", "none", "line"], "docs", total).select("row_id", "line", "size")


def verdicts(rows: DataFrame, lines: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """Each row with n_removed_words, n_removed_lines and kept."""
    gone = holders(rows, lines).groupBy("row_id").agg(F.sum("size").alias("removed_words"), F.count("*").alias("removed_lines"))
    out = rows.drop("lines", "sizes").join(gone, "row_id", "left")
    removed = F.coalesce("removed_words", F.lit(0))
    return out.withColumns({"n_removed_words": removed, "n_removed_lines": F.coalesce("removed_lines", F.lit(0)), "kept": ~F.col("base_failed") & (F.col("n_words") - removed >= min_left * F.col("n_words"))}).drop("removed_words", "removed_lines")


def judge(docs: DataFrame, host: str = "source", by: str = "documents") -> DataFrame:
    """Base counts and the verdict for each document."""
    rows = measured(docs, host)
    return verdicts(rows, C.stored(frequent_lines(rows, by))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


def strip_lines(text: str, bad: set[int]) -> str:
    """Without the lines whose hash is in ``bad``."""
    return "\n".join(x for x in text.split("\n") if not ((w := x.encode().split()) and line_hash(w) in bad))


def filtered(docs: DataFrame, host: str = "source", by: str = "documents", broadcast_rows: int = 200_000) -> DataFrame:
    """The kept documents, without their frequent lines; columns as they were.

    The verdict needs the counts, so the table is read twice. Up to ``broadcast_rows`` frequent lines go to every task, beyond
    that they are joined to the documents.
    """
    rows = measured(docs, host)
    lines = C.stored(frequent_lines(rows, by))
    schema = docs.schema
    n = lines.count()

    def clean(batch: pa.RecordBatch, bad_of) -> pa.RecordBatch:
        i, hosts = batch.schema.get_field_index("text"), batch.column(batch.schema.get_field_index(host)).to_pylist()
        keep, new = [], []
        for t, h, bad in zip(batch.column(i).to_pylist(), hosts, bad_of(batch, hosts)):
            words, _, _, _, rep, own = measure(t or "")
            gone = sum(v for k, v in own.items() if k in bad)
            keep.append(not (words < 50 or 100 * rep > 50 * words) and words - gone >= MIN_LEFT * words)
            new.append(strip_lines(t, bad) if gone and keep[-1] else t)
        out = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type)).filter(pa.array(keep))
        return out.select([f.name for f in schema])

    if n <= broadcast_rows:
        known: dict = {}
        for r in lines.collect():
            known.setdefault(r["host"], set()).add(r["line"])
        shared = docs.sparkSession.sparkContext.broadcast(known)
        return C.arrow_map(docs, lambda b: clean(b, lambda _, hosts: [shared.value.get(None if h is None else str(h), set()) for h in hosts]), schema)
    mine = holders(rows, lines).groupBy("row_id").agg(F.collect_list("line").alias("__bad"))
    of_text = rows.select("row_id", "text_hash", "host").join(mine, "row_id").groupBy("text_hash", "host").agg(F.first("__bad").alias("__bad")).select(F.col("text_hash").alias("__t"), F.col("host").alias("__h"), "__bad")
    @F.pandas_udf("long")
    def hashed(s: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh64_intdigest((t or "").encode(), 11) - (1 << 63) for t in s], dtype="int64")

    both = docs.withColumn("__text_hash", hashed(F.col("text").cast("string"))).join(of_text, (F.col("__text_hash") == F.col("__t")) & F.col(host).cast("string").eqNullSafe(F.col("__h")), "left").drop("__t", "__h", "__text_hash")
    return C.arrow_map(both, lambda b: clean(b, lambda batch, _: [set(x or ()) for x in batch.column(batch.schema.get_field_index("__bad")).to_pylist()]), schema)
