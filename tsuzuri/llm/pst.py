"""Language-model scoring by a probabilistic suffix tree.

Training counts all words of all training documents, then, for contexts of 1 to ``DEPTH`` words, what follows them: one pass a level,
over the contexts found at least ``MIN_CONTEXT`` times. A context is retained if its next-word distribution diverges from that of its
suffix (the context without its first word): over what follows it at least ``MIN_ENTRY`` times, the log likelihood ratio must exceed
the number of words and ln N. Retained distributions are smoothed by absolute discount, and what is left goes to the next shorter
retained suffix, down to the smoothed unigrams. A token is scored in the state of its longest retained context.

Nothing is capped: words, contexts and entries are tables in the shared folder whose size follows the corpus; the minimum counts are
constants. Three things only save work. Words are numbered, the ``SYMBOLS`` most frequent ones by rank, all others by their hash, and the texts
are stored as such numbers, which are small. A bounded Bloom filter (``BLOOM_BITS``) tells contexts that count; the fuller it is, the more
rows are counted in vain. The ``CACHE`` most frequent keys of the tree go to every task. The others are joined: only places that two more filters
let pass are shuffled, ``SLICE`` or a quarter of the training tokens at a time. Tables of counts hold a row for each distinct sequence, so no word has a large share of one.

A retained context holds the log of what it leaves to its suffix, an entry its gain over what its context leaves to its own suffix. So a text's
score is its base score plus these values of all contexts and entries it holds, in any order. Sequences are told apart by 64 bits of hash.

Defined results: null or empty text is one token, the end; a null doc_id counts as the empty text in the split (held out);
repeated rows count each and get equal rows; texts are read whole, whatever their length; equal counts need no order;
without training tokens every count is 0 (N = V = 0); an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .hashing import mix

MIN_CONTEXT, MIN_ENTRY, DEPTH = 16, 4, 3
DISCOUNT, ALPHA = 0.5, 0.1
#: Words whose counts go to every task (all others are joined), keys of the tree that do, and bits of a filter.
SYMBOLS, CACHE, BLOOM_BITS = 500_000, 6_000_000, 1 << 28
END = np.uint64(xxhash.xxh64_intdigest(b"\n")).astype(np.int64)  # no word holds white space
FLUSH = 2_000_000
#: Rows of counts that a task sums at once, and tasks up to which it does; with more, Spark's own aggregation sums, which spills.
ROWS, TASKS = 2_000_000, 20_000
#: Places that are joined to the tree at once, at least.
SLICE = 50_000_000
#: Numbers in a row of bytes, at most: a long document makes a large block.
LONGEST = 1 << 27
#: Steps of a doubling by which the tree's counts are told apart, and keys of it that the driver collects at once.
STEPS, COLLECTED = 8, 1_000_000


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, each text's followed by an end, as places in a list of distinct hashes; that list; and where each text begins."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten().cast(pa.binary()).dictionary_encode()
    known = words.dictionary.to_pylist()
    hashes = np.append(np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known)).view(np.int64), END)
    some = np.array([bool(w) for w in known], bool)  # white space at either end leaves empty words
    i = np.asarray(words.indices, np.int64)
    real = some[i] if len(i) else np.zeros(0, bool)
    edges = np.asarray(parts.offsets, np.int64)
    before = np.concatenate([[0], np.cumsum(real)])[edges - edges[0]]  # real words before each text
    size = np.diff(before) + 1
    start = np.cumsum(size) - size
    out = np.full(int(size.sum()), len(known), np.int32)
    at = np.ones(len(out), bool)
    at[start + size - 1] = False
    out[at] = i[real]
    return out, hashes, start


def joined(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of the words w1..wn+1 from those of w1..wn and w2..wn+1."""
    return mix(before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)).view(np.int64)


def grams(t: np.ndarray, start: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to ``most`` words before a token: the tokens that have them, the keys of these words, of them without the first but with the token, and of both."""
    inner = np.ones(len(t), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    key, ok = key_of(t), np.ones(len(t), bool)
    for _ in range(most):
        at = at[ok[at - 1]]
        before, last = key[at - 1], key[at]
        both = joined(before, last)
        yield at, before, last, both
        key, ok = np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        key[at], ok[at] = both, True


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out."""
    rows = C.id_text(docs)
    return rows.withColumn("held_out", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0)


class Lookup:
    """Well-mixed keys with values: the sorted keys, and where those of each leading bit pattern begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys.view(np.uint64))
        self.index(keys.view(np.uint64)[order], values[order])

    def index(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` as unsigned numbers, sorted."""
        self.keys, self.values = keys, values
        bits = max(len(keys).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        lead = keys >> self.shift
        self.begin = np.searchsorted(lead, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    @classmethod
    def of(cls, df: DataFrame, size: int) -> Lookup:
        """A bounded table (key, value) of ``size`` rows, which the driver collects in parts by leading bits."""
        out, found = cls.__new__(cls), []
        step = 1 << 63 >> max(size // COLLECTED, 1).bit_length() - 1
        for low in [*range(0, 1 << 63, step), *range(-(1 << 63), 0, step)]:  # in the order of unsigned numbers
            keys, values = arrays(df.where(F.col("key").between(low, low + step - 1)).select("key", "value"))
            found.append(cls(keys.astype(np.int64), values.astype(np.float64)))
        out.index(np.concatenate([x.keys for x in found]), np.concatenate([x.values for x in found]))
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, or -1."""
        x = x.view(np.uint64)
        lead = (x >> self.shift).astype(np.int64)
        i, end = self.begin[lead], self.begin[lead + 1]
        out, left = np.full(len(x), -1, np.int64), np.flatnonzero(i < end)
        i, end, x = i[left], end[left], x[left]
        while len(left):
            hit = self.keys[i] == x
            out[left[hit]] = i[hit]
            i = i + 1
            go = ~hit & (i < end)
            left, i, end, x = left[go], i[go], end[go], x[go]
        return out


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table."""
    t = df.toArrow()
    out = [np.concatenate([np.asarray(x) for x in c.chunks] or [np.zeros(0, np.int64)]) for c in t.columns]
    del t
    pa.default_memory_pool().release_unused()
    return out


def cut(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` tokens (first column); a longer document stands alone."""
    if batch.num_rows:
        place = np.cumsum(np.diff(np.asarray(batch.column(0).offsets, np.int64))) // most
        edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.ListArray]]:
    """The token lists of batches (first column), in blocks of about FLUSH tokens."""
    held, size = [], 0
    for batch in batches:
        for piece in cut(batch):
            held.append(piece.column(0))
            size += len(held[-1].flatten())
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


def flat(lists: list[pa.ListArray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, and where each document begins."""
    t = np.concatenate([np.asarray(x.flatten(), np.int64) for x in lists])
    size = np.concatenate([np.diff(np.asarray(x.offsets, np.int64)) for x in lists])
    return t, np.cumsum(size) - size


def counted(rows: DataFrame, names: list[str]) -> DataFrame:
    """Counts ``n`` summed for each key. Keys are counted in each task's blocks before, so the shuffle comes first."""
    return rows.repartition(*names).groupBy(*names).agg(F.sum("n").alias("n"))


def packed(key: np.ndarray, parts: int, /, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbers sorted by their keys, as one row of bytes for each of ``parts`` equal ranges of keys that has any (a very long one in several)."""
    bounds = np.array([(p << 64) // parts - (1 << 63) for p in range(1, parts)], np.int64)
    for i in range(0, len(key), LONGEST):
        k = key[i : i + LONGEST]
        edges = np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]])
        some = np.flatnonzero(np.diff(edges))
        at = pa.py_buffer((edges[np.append(some, some[-1] + 1)] * 8).astype(np.int32))
        cols = [pa.Array.from_buffers(pa.binary(), len(some), [None, at, pa.py_buffer(np.ascontiguousarray(x[i : i + LONGEST]))]) for x in columns.values()]
        yield pa.RecordBatch.from_arrays([pa.array(some), *cols], ["part", *columns])


def unpacked(column: pa.BinaryArray, kind: type = np.int64) -> np.ndarray:
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, (at[-1] - at[0]) // 8, at[0]) if at[-1] > at[0] else np.zeros(0, kind)


def divided(rows: int) -> tuple[int, int]:
    """Tasks for so many rows, and ranges of keys, several in each task, which evens out their sizes."""
    tasks = rows // ROWS + 1
    return tasks, min(tasks * 16, max(tasks, 1 << 16))


def summed(rows: DataFrame, find: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, ...]]], most: int) -> DataFrame:
    """(ctx, last, n, key): counts summed for each pair, of those found MIN_ENTRY times. ``find`` gives (ctx, last, n, key) of blocks of rows,
    sorted by the key; they are shuffled as bytes, by ranges of keys. ``most`` bounds the number of pairs."""
    tasks, parts = divided(most)

    def added(ctx: np.ndarray, last: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        key = joined(ctx, last)
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        total = np.add.reduceat(n[order], first)
        at = order[first[total >= MIN_ENTRY]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ctx[at], last[at], total[total >= MIN_ENTRY], key[at])], ["ctx", "last", "n", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ctx, last, n, key in find(batches):
            yield from packed(key, parts, ctx=ctx, last=last, n=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[unpacked(b.column(i)) for i in range(1, 4)] for b in batches if b.num_rows]
        if held:
            yield added(*map(np.concatenate, zip(*held)))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in find(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in block[:3]], ["ctx", "last", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield added(*(np.array(c, np.int64) for c in b.columns))

    out = "ctx long, last long, n long, key long"
    if tasks > TASKS:
        return counted(rows.mapInArrow(plain, "ctx long, last long, n long"), ["ctx", "last"]).mapInArrow(each, out)
    return rows.mapInArrow(pack, "part long, ctx binary, last binary, n binary").repartition(tasks, "part").mapInArrow(run, out)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        k, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(k[n > 0]), pa.array(n[n > 0])], ["word", "n"])

    for batch in batches:
        for piece in C.pieces(batch):
            t, hashes, _ = tokens(piece.column(0))
            held.append((hashes, np.bincount(t, minlength=len(hashes))))
            size += len(t)
            if size >= FLUSH:
                yield out()
                held, size = [], 0
    if held:
        yield out()


@dataclass
class Words:
    """The numbers of words: the rank of a frequent one, else its hash with two bits set."""

    known: Lookup
    counts: np.ndarray  # by rank

    def numbers(self, t: np.ndarray) -> np.ndarray:
        i = self.known.find(t)
        return np.where(i >= 0, self.known.values[np.maximum(i, 0)] if len(self.known.values) else 0, (t & np.int64((1 << 62) - 1)) | np.int64(1 << 62))


def key_of(number: np.ndarray) -> np.ndarray:
    """A word's key as a context."""
    return mix(number.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).view(np.int64)


@dataclass
class Model:
    """Stored tables, and what all tasks get."""

    total: int
    distinct: int
    counts: DataFrame  # number, n
    contexts: DataFrame | None = None  # key, size, rest: log10 of the share left to the suffix
    entries: DataFrame | None = None  # key, n, gain: log10 of the probability over the context's share of the suffix's

    @property
    def norm(self) -> float:
        return float(self.total + ALPHA * (self.distinct + 1))


def numbered(rows: DataFrame) -> tuple[DataFrame, Words, Model]:
    """The rows of split() with their tokens as numbers instead of the text, and a row_id; stored. The words' numbers and counts."""
    spark = rows.sparkSession
    words = C.stored(counted(rows.where("not held_out").select("text").mapInArrow(count_words, "word long, n long"), ["word"]))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least power of two above which at most SYMBOLS words count, by a histogram
    sizes = {r["p"]: r["k"] for r in words.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("k")).collect()}
    least = min(p for p in range(64) if sum(k for q, k in sizes.items() if q >= p) <= SYMBOLS)
    word, n = arrays(words.where(F.col("n") >= 1 << least))
    order = np.lexsort((word, -n))
    known = Words(Lookup(word[order].astype(np.int64), np.arange(len(word))), n[order].astype(np.int64))
    shared = spark.sparkContext.broadcast(known)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = shared.value.numbers(np.array(batch.column(0), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column(1)], ["number", "n"])

    counts = C.stored(words.mapInArrow(number, "number long, n long"))
    C.discard(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, hashes, start = tokens(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(t)).astype(np.int32)), pa.array(shared.value.numbers(hashes)[t]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], ["doc_id", "held_out", "row_id", "t"])

    source = rows.withColumn("row_id", F.monotonically_increasing_id()).select("doc_id", "text", "held_out", "row_id")
    return C.stored(C.arrow_map(source, run, "doc_id long, held_out boolean, row_id long, t array<long>")), known, Model(total, distinct, counts)


def grow(rows: DataFrame, model: Model, depth: int) -> None:
    """The tree; ``rows``: (t) of the training documents, stored."""
    spark, total = rows.sparkSession, model.total

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key_of(np.array(batch.column(0), np.int64))), batch.column(1)], ["key", "n"])

    # of each sequence found MIN_ENTRY times: its count, that of its words but the last, and its probability
    lower = model.counts.where(F.col("n") >= MIN_ENTRY).mapInArrow(keyed, "key long, n long").select("key", "n", F.lit(total).cast("long").alias("size"), ((F.col("n") + ALPHA) / model.norm).alias("p"))
    lower = C.stored(lower)
    contexts, entries = [], []
    for level in range(1, depth + 1):
        keys = C.stored(lower.where(F.col("n") >= MIN_CONTEXT).select("key"))
        if not keys.count():
            break
        # what is found MIN_ENTRY times has a context and a suffix that are; nearly all words are
        suffixes = C.Bloom.of(lower.select("key"), BLOOM_BITS) if level > 1 else None
        bloom = spark.sparkContext.broadcast((C.Bloom.of(keys, BLOOM_BITS), suffixes))
        del suffixes

        def follow(batches: Iterator[pa.RecordBatch], level: int = level, bloom=bloom) -> Iterator[tuple[np.ndarray, ...]]:
            contexts, suffixes = bloom.value
            for lists in blocks(batches):
                for _, before, last, both in grams(*flat(lists), level):  # noqa: B007
                    pass
                at = np.flatnonzero(contexts.has(before))
                if suffixes:
                    at = at[suffixes.has(last[at])]
                at = at[np.argsort(both[at])]
                k = both[at]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(k)))
                yield before[at[first]], last[at[first]], n.astype(np.int64), k[first]

        pairs = C.stored(summed(rows, follow, total))
        bloom.unpersist()
        C.discard(keys)
        of = lower.where(F.col("n") >= MIN_CONTEXT).select(F.col("key").alias("ctx"), F.col("n").alias("size"))
        suffix = lower.select(F.col("key").alias("last"), (F.col("n") / F.col("size")).alias("q"), "p")
        both = C.stored(pairs.join(of, "ctx").join(suffix, "last").select("ctx", "key", "n", "size", "q", "p"))
        C.discard(pairs, lower)
        # divergence from the suffix's distribution
        mass = F.sum((F.col("n") - DISCOUNT) / F.col("size"))
        tests = both.groupBy("ctx").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("size") / F.col("q"))).alias("ratio"), F.count("*").alias("kinds"), (1.0 - mass).alias("left"), F.max("size").alias("s"))
        passed = C.stored(tests.where(F.col("ratio") - F.col("kinds") > float(np.log(total))).select("ctx", "left", "s"))
        rest = F.col("left") * F.col("p")
        smooth = (F.col("n") - DISCOUNT) / F.col("size") + rest
        now = C.stored(both.join(passed.select("ctx", "left"), "ctx", "left").select("key", "n", "size", F.coalesce(smooth, "p").alias("p"), F.log10(smooth / rest).alias("gain")))
        C.discard(both)
        contexts.append(passed.select(F.col("ctx").alias("key"), F.col("s").alias("size"), F.log10("left").alias("rest")))
        entries.append(C.stored(now.where("gain is not null").select("key", "n", "gain")))
        lower = C.stored(now.drop("gain"))
        C.discard(now)
    C.discard(lower)
    for c, e in zip(contexts, entries):
        model.contexts, model.entries = (c, e) if model.contexts is None else (model.contexts.union(c), model.entries.union(e))


def bucket(n: str) -> Column:
    return F.floor(F.log2(n) * STEPS)


@dataclass
class Tree:
    """Values of a tree's contexts and entries: those of frequent keys, and filters of the others, if there are any."""

    contexts: Lookup
    entries: Lookup
    more_contexts: C.Bloom | None
    more_entries: C.Bloom | None

    @classmethod
    def of(cls, model: Model) -> tuple[Tree, DataFrame | None, int, int]:
        """The tree; a table (key, value) of the keys that its lookups lack, contexts by their complement; their number, and how often training texts hold them."""
        parts = model.contexts.select("key", F.col("size").alias("n"), F.col("rest").alias("value")), model.entries.select("key", "n", F.col("gain").alias("value"))
        tally = [t.groupBy(bucket("n").alias("p")).agg(F.count("*").alias("k"), F.sum("n").alias("s")).collect() for t in parts]
        least = min(p for p in range(64 * STEPS) if sum(r["k"] for t in tally for r in t if r["p"] >= p) <= CACHE)
        lookups = [Lookup.of(t.where(bucket("n") >= least), sum(r["k"] for r in sizes if r["p"] >= least)) for t, sizes in zip(parts, tally)]
        left, places = (sum(r[x] for t in tally for r in t if r["p"] < least) for x in ("k", "s"))
        if not left:
            return cls(*lookups, None, None), None, 0, 0
        rare = [t.where(bucket("n") < least).select("key", "value") for t in parts]
        table = rare[0].select(F.bitwise_not("key").alias("key"), "value").union(rare[1])
        return cls(*lookups, *(C.Bloom.of(t.select("key"), BLOOM_BITS) for t in rare)), table, left, places

    def gains(self, t: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token, the log10 of its probability over the base one, without the keys that may be in the table; these keys, and the tokens that have them."""
        out = np.zeros(len(t))
        places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def look(lookup: Lookup, more: C.Bloom | None, at: np.ndarray, k: np.ndarray, flip: int) -> np.ndarray:
            i = lookup.find(k)
            hit = i >= 0
            out[at[hit]] += lookup.values[i[hit]]
            if more:
                rest = np.flatnonzero(~hit)
                rest = rest[more.has(k[rest])]
                places.append(at[rest])
                keys.append(k[rest] ^ np.int64(flip))
                hit[rest] = True
            return hit

        for at, before, _, both in grams(t, start, depth):
            hit = look(self.contexts, self.more_contexts, at, before, -1)
            look(self.entries, self.more_entries, at[hit], both[hit], 0)  # entries have retained contexts
        places, keys = np.concatenate(places), np.concatenate(keys)
        order = np.argsort(places, kind="stable")
        return out, places[order], keys[order]


def slices(rows: DataFrame, n: int) -> list[DataFrame]:
    """A stored table in about ``n`` parts, by its files."""
    files = sorted(rows.inputFiles())
    if n <= 1 or len(files) <= 1:
        return [rows]
    return [rows.sparkSession.read.schema(rows.schema).parquet(*files[i::n]) for i in range(min(n, len(files)))]


def joined_values(part: DataFrame, table: DataFrame, left: int) -> DataFrame:
    """(row_id, more): the values of the keys in ``open``, summed for each row. Keys of rows and of the table meet by ranges, as bytes;
    the table's come first, so a task holds only them."""
    places = part.agg(F.coalesce(F.sum(F.size("open")), F.lit(0))).first()[0]
    (tasks, parts), sums = divided(2 * (places + left)), divided(2 * places)  # not bounds, as when counting

    def grouped(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rows by their keys, these keys, and the sums of their values."""
        by = mix(row.view(np.uint64)).view(np.int64)
        order = np.argsort(by)
        by, row = by[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        return row[first], by[first], np.add.reduceat(value[order], first)

    def sorted_(found: Iterator[tuple[np.ndarray, np.ndarray]], other: str) -> Iterator[pa.RecordBatch]:
        """Keys with another column, packed in blocks of about FLUSH."""
        held, size = [], 0
        for x in itertools.chain(found, [None]):
            if x:
                held.append(x)
                size += len(x[0])
            if size and (size >= FLUSH or not x):
                key, more = (np.concatenate(c) for c in zip(*held))
                order = np.argsort(key)
                yield from packed(key[order], parts, key=key[order], **{other: more[order]})
                held, size = [], 0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sorted_(((np.array(b.column(0)), np.array(b.column(1))) for b in batches), "value")

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sorted_(((t, np.repeat(np.asarray(p.column(1)), np.diff(np.append(start, len(t))))) for b in batches for p in cut(b) for t, start in [flat([p.column(0)])]), "row")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lookup = [(np.zeros(0, np.int64), np.zeros(0))], None
        for b in batches:
            kinds = np.asarray(b.column(1))
            n = int(np.searchsorted(kinds, 1))
            held.append((unpacked(b.column(2).slice(0, n)), unpacked(b.column(4).slice(0, n), np.float64)))
            if n == b.num_rows:
                continue
            if lookup is None:
                lookup = Lookup(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            i = lookup.find(unpacked(b.column(2).slice(n)))
            if not (i >= 0).any():
                continue
            row, by, value = grouped(unpacked(b.column(3).slice(n))[i >= 0], lookup.values[i[i >= 0]])
            yield from packed(by, sums[1], row=row, value=value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(unpacked(b.column(1)), unpacked(b.column(2), np.float64)) for b in batches if b.num_rows]
        if held:
            row, _, value = grouped(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(value)], ["row_id", "more"])

    nothing = F.lit(b"")
    of = table.mapInArrow(keys, "part long, key binary, value binary").select("part", F.lit(0).alias("kind"), "key", nothing.alias("row"), "value")
    at = part.where("size(open) > 0").select("open", "row_id").mapInArrow(open_, "part long, key binary, row binary").select("part", F.lit(1).alias("kind"), "key", "row", nothing.alias("value"))
    met = of.union(at).repartition(tasks, "part").sortWithinPartitions("kind").mapInArrow(meet, "part long, row binary, value binary")
    return met.repartition(sums[0], "part").mapInArrow(add, "row_id long, more double")


def scored(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """A row for each document: tokens, known tokens, base score and the tree's score (log10 probability of the whole text)."""
    spark = docs.sparkSession
    rows, words, model = numbered(split(docs))
    if model.total:
        grow(rows.where("not held_out").select("t"), model, depth)
    norm = model.norm
    tree, table, left, places = Tree.of(model) if model.contexts is not None else (None, None, 0, 0)
    shared = spark.sparkContext.broadcast((words.counts, tree))
    del tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tree = shared.value
        logs = np.log10((counts + ALPHA) / norm) if len(counts) else np.zeros(0)
        for batch in (piece for b in batches for piece in cut(b)):
            t, start = flat([batch.column(0)])
            size = np.diff(np.append(start, len(t)))
            rare = np.flatnonzero(t >= len(logs))
            score = np.zeros(len(t))
            known = t < len(logs)
            score[known] = logs[t[known]]
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.append(start, len(t))).astype(np.int32)), pa.array(values))  # noqa: B023, E731
            gain, at, keys = tree.gains(t, start, depth) if tree else (np.zeros(len(t)), *[np.zeros(0, np.int64)] * 2)
            seen = size - np.diff(np.searchsorted(rare, np.append(start, len(t))))
            cols = [*batch.columns[1:], pa.array(size), pa.array(seen.astype(np.int64)), pa.array(np.add.reduceat(score, start)), pa.array(np.add.reduceat(gain, start)), lists(rare, t[rare]), lists(at, keys)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "row_id", "n_tokens", "known", "base", "gain", "rare", "open"])

    out = "doc_id long, held_out boolean, row_id long, n_tokens long, known long, base double, gain double, rare array<long>, open array<long>"
    parts = []
    for piece in slices(rows, -(-places // max(SLICE, model.total // 4))):
        part = C.stored(piece.select("t", "doc_id", "held_out", "row_id").mapInArrow(run, out))
        if table is not None:
            more = C.stored(joined_values(part, table, left))
            gained = C.stored(part.drop("open").join(more, "row_id", "left").withColumn("gain", F.col("gain") + F.coalesce("more", F.lit(0.0))).drop("more"))
            C.discard(part, more)
            part = gained
        parts.append(part)
    C.discard(rows)
    part = reduce(DataFrame.unionByName, parts)
    each = part.where("size(rare) > 0").select("row_id", F.explode("rare").alias("number"))
    each = each.join(model.counts.where(F.col("number") >= len(words.counts)), "number", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("c"))  # rare words only: none is hot
    more = each.groupBy("row_id").agg(F.sum(F.log10((F.col("c") + ALPHA) / norm)).alias("log"), F.sum((F.col("c") > 0).cast("long")).alias("seen"))
    rest = part.join(more, "row_id", "left")
    base = F.col("base") + F.coalesce("log", F.lit(0.0))
    return rest.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
