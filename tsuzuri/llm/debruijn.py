"""Substring dedup by de Bruijn compaction.

The nodes of the graph are token k-grams sampled by winnowing (see ``repeats``), its edges the texts between them; repeated
nonbranching paths are compacted by Spark joins. A document that runs along a path which also lies in a document with a smaller
doc_id loses that stretch at once: source coordinates (document, first and last word) say which. Windows that a path does not
settle, those over a path's ends, are compared one by one, by 96 bits of hash of their 50 words.

Defined results: null or empty text has no words (digest of the empty string); a null doc_id comes before all others; rows with
one doc_id never remove from one another; repeated rows get equal rows; texts are read whole, in blocks where they are very long; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H
from . import repeats as R

SPEC = R.Spec("words", 50, 16)
_SECOND = 0xD1342543DE82EF95


def repeated_spans(rows: DataFrame, spec: R.Spec = SPEC) -> DataFrame:
    """(ord, rk, spans): for each document the starts and ends of the word spans to remove; stored. ``rows`` from ``repeats.keyed``."""
    occ = R.recurring(rows, spec)
    graph = R.nodes(occ)
    seen = R.visits(occ, graph, R.paths(graph))
    C.discard(occ, graph)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = batch.column(3)
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        ids, rks = (np.array(batch.column(i), np.int64) for i in (0, 2))
        for i, text in enumerate(C.texts(batch)):
            u = R.units(text, spec)
            spans, open_ = R.doc_windows(u, found[i].values, spec)
            if len(spans):
                for c, v in zip(out, (np.full(len(spans), rks[i]), np.full(len(spans), ids[i]), spans[:, 0], spans[:, 1], np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64))):
                    c.append(v)
            if open_:
                at = np.concatenate(open_)
                one, two = (H.span_hash(H.prefixes(u, base), at, at + spec.length, base).view(np.int64) for base in (H._B, _SECOND))
                for c, v in zip(out, (np.full(len(at), rks[i]), np.full(len(at), ids[i]), at, np.zeros(len(at), np.int64), one, two)):
                    c.append(v)
        if not out[0]:
            return None
        cols = [np.concatenate(c).astype(np.int64) for c in out]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:5]), pa.array(cols[5].astype(np.int32))], ["rk", "ord", "s", "e", "h1", "h2"])

    both = C.stored(C.arrow_map(rows.join(seen, ["ord", "rk"]).select("ord", "text", "rk", "found"), run, "rk long, ord long, s long, e long, h1 long, h2 int"))
    C.discard(seen)
    windows = both.where("e = 0").drop("e")
    least = C.stored(windows.groupBy("h1", "h2").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi"))
    total = least.agg(F.sum("n")).first()[0] or 0
    gone = C.join_hot(windows, least, ["h1", "h2"], "n", max(total, 1)).where("ord > lo").select("ord", "rk", "s", (F.col("s") + spec.length).alias("e"))
    out = C.stored(both.where("e > 0").select("ord", "rk", "s", "e").union(gone).groupBy("ord", "rk").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    C.discard(both, least)
    return out


def covered(n: int, spans) -> np.ndarray:
    """Which of n items lie in a span; spans: an Arrow list of (s, e), or None."""
    step = np.zeros(n + 1, np.int64)
    if spans is not None:
        np.add.at(step, np.asarray(spans.field("s"), np.int64), 1)
        np.add.at(step, np.asarray(spans.field("e"), np.int64), -1)
    return np.cumsum(step[:-1]) > 0


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: words, words removed, and the digest of the rest."""
    rows = R.keyed(docs)
    spans = repeated_spans(rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, sha = [], [], []
        for i, text in enumerate(C.texts(batch)):
            words, mine = text.encode().split(), batch.column(2)[i]
            if mine.is_valid:
                cut = covered(len(words), mine.values)
                kept = [words[j] for j in np.flatnonzero(~cut).tolist()]
            else:
                kept = words
            n.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return C.arrow_map(rows.join(spans, ["ord", "rk"], "left").select("doc_id", "text", "spans"), run, OUT)
