"""The text functions over Arrow arrays: a slice of texts at a time, its code points side by side in one numpy array.

A worker holds one slice and what is made of it, however large the batch that it was sent; a longer text stands alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial
from typing import Any
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from . import plain
from . import tables as T

#: Bytes of text that a worker handles at once.
SLICE = 1 << 18

Pairs = tuple[tuple[str, str], ...]


def slices(*columns: pa.Array, least: int | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """Parts of columns of equal length, each of about ``SLICE`` bytes of text (or binary) in all columns together."""
    n = len(columns[0])
    size = sum(np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=np.int64) for c in columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type))
    cut = np.cumsum(size + np.zeros(n, np.int64)) // (least or SLICE)
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield tuple(c.slice(a, b - a) for c in columns)


def over(fn: Callable[..., pa.Array], kind: DataType | str, *columns: Column, least: int | None = None) -> Column:
    """``fn`` over slices of the columns; it gives an array of as many rows."""

    if len(columns) == 1:

        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from (fn(*part) for part in slices(batch, least=least)) if len(batch) else (fn(batch),)

    else:

        @F.arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from (fn(*part) for part in slices(*batch, least=least)) if len(batch[0]) else (fn(*batch),)

    return run(*columns)


class Run:
    """Texts side by side: code points, and where each text begins (and the last one ends)."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.a = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int32)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])

    def ahead(self, k: int = 1) -> np.ndarray:
        """For each place what stands k places on in its text; 0 beyond its end."""
        out = np.zeros_like(self.a)
        if k < len(self.a):
            out[:-k] = self.a[k:]
        for i in range(1, k + 1):
            at = self.starts[1:] - i
            out[at[at >= self.starts[:-1]]] = 0
        return out

    def behind(self) -> np.ndarray:
        """For each place what precedes it in its text; 0 at its begin."""
        out = np.zeros_like(self.a)
        out[1:] = self.a[:-1]
        at = self.starts[:-1]
        out[at[at < len(self.a)]] = 0
        return out

    def drop(self, at: np.ndarray) -> None:
        """Leave places (in order) out."""
        if len(at):
            self.a = np.delete(self.a, at)
            self.starts = self.starts - np.searchsorted(at, self.starts)

    def insert(self, at: np.ndarray, what: np.ndarray) -> None:
        """Put a code point before each of some places (in order, none a text's first)."""
        if len(at):
            self.a = np.insert(self.a, at, what)
            self.starts = self.starts + np.searchsorted(at, self.starts)

    def array(self, null: np.ndarray | None = None) -> pa.Array:
        width = np.concatenate([np.zeros(1, np.int64), np.cumsum(1 + (self.a > 0x7F) + (self.a > 0x7FF) + (self.a > 0xFFFF))])[self.starts]
        data = pa.py_buffer(self.a.tobytes().decode("utf-32-le").encode())
        large = width[-1] >= 1 << 31
        offsets = pa.py_buffer(width.astype(np.int64 if large else np.int32).tobytes())
        valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.large_string() if large else pa.string(), len(width) - 1, [valid, offsets, data])

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The text of each place."""
        return np.searchsorted(self.starts, at, side="right") - 1


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[ord(c) for c in chars]] = True
    return out


def _lookup(*steps: Pairs) -> np.ndarray:
    """What each code point becomes by translations one after another."""
    out = np.arange(sys.maxunicode + 1, dtype=np.int32)
    for pairs in steps:
        one = np.arange(sys.maxunicode + 1, dtype=np.int32)
        for k, v in reversed(pairs):  # of several, the first
            one[ord(k)] = ord(v)
        out = one[out]
    return out


@lru_cache
def _kana() -> np.ndarray:
    first, last = T.KANA_CLASS[0], T.KANA_CLASS[2]
    return _flags("".join(map(chr, range(ord(first), ord(last) + 1))) + T.KANA_CLASS[3:])


@lru_cache
def _digits() -> np.ndarray:
    return _flags("".join(re.findall(r"\d", "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000))))


@lru_cache
def _white() -> np.ndarray:
    return _flags(T.WHITE.replace("\n", ""))


@lru_cache
def _chars(pairs: Pairs) -> np.ndarray:
    return _lookup(pairs)


# --- conversions ---


@lru_cache
def _singles(pairs: Pairs) -> np.ndarray:
    """A table, then the historical kana of one character."""
    return _lookup(pairs, tuple(p for p in T.kana_rules()[0] if len(p[0]) == 1))


class _Pair:
    """Rules of two characters, by the second."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.rules = list(rules)
        heads, tails = (sorted({k[i] for k, _ in rules}) for i in (0, 1))
        self.is_tail = _flags("".join(tails))
        self.head, self.tail = (np.full(sys.maxunicode + 1, len(x), np.int16) for x in (heads, tails))
        for places, chars in ((self.head, heads), (self.tail, tails)):
            for i, c in enumerate(chars):
                places[ord(c)] = i
        self.rule = np.full((len(heads) + 1, len(tails) + 1), -1, np.int32)
        for i, (k, _) in enumerate(rules):
            self.rule[heads.index(k[0]), tails.index(k[1])] = i

    def find(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """Places of second characters, and the rule of each."""
        at = np.flatnonzero(self.is_tail[run.a])
        at = at[at > 0]
        rule = self.rule[self.head[run.a[at - 1]], self.tail[run.a[at]]]
        good = (rule >= 0) & ~np.isin(at, run.starts)
        return at[good], rule[good]


@lru_cache
def _pairs(phase: int) -> _Pair:
    return _Pair([p for p in T.kana_rules()[phase] if len(p[0]) == 2])


def kana(run: Run, pairs: Pairs = ()) -> None:
    """A table of characters, then historical kana; no two places of a phase's rules overlap, and none makes another one's input."""
    run.a = _singles(pairs)[run.a]
    first, second = _pairs(0), _pairs(1)
    at, rule = first.find(run)
    if len(at):
        run.a[at - 1] = np.array([ord(v) for _, v in first.rules], np.int32)[rule]
        run.drop(at)
    at, rule = second.find(run)
    if len(at):
        head, middle, tail = (np.array([ord(f(v)) for _, v in second.rules], np.int32)[rule] for f in (lambda v: v[0], lambda v: v[1], lambda v: v[-1]))
        run.a[at - 1], run.a[at] = head, tail
        three = np.array([len(v) == 3 for _, v in second.rules])[rule]
        run.insert(at[three], middle[three])


@lru_cache
def _first() -> np.ndarray:
    return _flags("".join({k[0] for k, _ in (*T.COMPOUND_PARTICLES, *T.SINGLE_PARTICLES)}))


def _at(run: Run, places: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """What stands k places after some places; 0 beyond the text's end."""
    to = places + k
    return np.where(to < ends, run.a[np.minimum(to, len(run.a) - 1)], 0)


def particles(run: Run) -> None:
    """Rule by rule; no rule makes a place that begins with a particle's first character."""
    kind = _kana()
    at = np.flatnonzero(_first()[run.a])
    if not len(at):
        return
    ends = run.starts[run.rows(at) + 1]
    begins = run.starts[run.rows(at)]
    for rules in (T.COMPOUND_PARTICLES, T.SINGLE_PARTICLES):
        for old, new in rules:
            on = np.flatnonzero(run.a[at] == ord(old[0]))
            p, e = at[on], ends[on]
            good = (p == begins[on]) | ~kind[run.a[p - 1]]
            for i, c in enumerate(old[1:], 1):
                good &= _at(run, p, e, i) == ord(c)
            if len(old) == 1:
                good &= ~kind[_at(run, p, e, 1)]
            for i, c in enumerate(new):
                run.a[p[good] + i] = ord(c)


def context(run: Run) -> None:
    old, new = map(ord, T.CONTEXT_MISREAD)
    run.a[(run.a == old) & _kana()[run.behind()]] = new
    run.a[(run.a == old) & _kana()[run.ahead()]] = new


def punctuation(run: Run) -> None:
    run.a[run.a == ord(",")] = ord("、")
    at = np.flatnonzero(run.a == ord("."))
    if len(at):
        near = _digits()[run.behind()[at]] | _digits()[run.ahead()[at]]
        run.a[at[~near]] = ord("。")
    run.drop(np.flatnonzero(((run.a == ord("。")) | (run.a == ord("、"))) & (run.a == run.behind())))


def whitespace(run: Run) -> None:
    """Line ends as LF, lines stripped, at most one empty line in turn. A stretch of white space goes if a line begins or ends at it."""
    if (run.a == 13).any():
        run.drop(np.flatnonzero((run.a == 13) & (run.ahead() == 10)))
        run.a[run.a == 13] = 10
    w = np.flatnonzero(_white()[run.a])
    if len(w):
        row = run.rows(w)
        new = np.ones(len(w), bool)
        new[1:] = (np.diff(w) > 1) | (np.diff(row) > 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(w)) - 1
        a, b = w[first], w[last]
        go = (a == run.starts[row[first]]) | (run.a[a - 1] == 10) | (b + 1 == run.starts[row[last] + 1]) | (run.a[np.minimum(b + 1, len(run.a) - 1)] == 10)
        run.drop(w[np.repeat(go, last - first + 1)])
    n = np.flatnonzero(run.a == 10)
    if len(n) > 2:
        row = run.rows(n)
        third = (n[2:] - n[:-2] == 2) & (row[2:] == row[:-2])
        run.drop(n[2:][third])


@lru_cache
def _settled(pairs: Pairs) -> bool:
    """Whether a normalised text stays so through a table: its values are ideographs that NFKC leaves alone, and these join nothing."""
    return all(unicodedata.name(v, "").startswith("CJK UNIFIED IDEOGRAPH") and unicodedata.normalize("NFKC", v) == v for _, v in pairs)


def normal(texts: list[str]) -> list[str]:
    """Stretches of a text in NFKC are in NFKC, so one look at all of them together may do."""
    return texts if unicodedata.is_normalized("NFKC", "".join(texts)) else [plain.nfkc(t) for t in texts]


def before_width(texts: list[str], kanji: Pairs) -> tuple[list[str], Pairs]:
    """NFKC, old forms, NFKC; the table, if it is still to be applied."""
    texts = normal(texts)
    return (texts, kanji) if _settled(kanji) else (normal([plain.convert_old_kanji(t, T.Tables(kanji, ())) for t in texts]), ())


def _texts(part: pa.Array) -> tuple[list[str], np.ndarray]:
    """The texts, null as empty, and which are null."""
    return [x or "" for x in part.to_pylist()], np.asarray(part.is_null())


def nfkc(part: pa.Array) -> pa.Array:
    texts, null = _texts(part)
    new = normal(texts)
    return part if new is texts else pa.array([None if n else t for t, n in zip(new, null)], part.type)


def convert(part: pa.Array, pairs: Pairs) -> pa.Array:
    texts, null = _texts(part)
    run = Run(texts)
    kana(run, pairs)
    particles(run)
    return run.array(null)


def normalize_query(part: pa.Array, kanji: Pairs) -> pa.Array:
    texts, null = _texts(part)
    texts, pairs = before_width(texts, kanji)
    run = Run(texts)
    kana(run, pairs)
    particles(run)
    return run.array(null)


def bodies(texts: list[str], kanji: Pairs) -> Run:
    texts, pairs = before_width(texts, kanji)
    run = Run(texts)
    kana(run, pairs)
    run.a = _chars(T.MISREADS)[run.a]
    context(run)
    particles(run)
    punctuation(run)
    whitespace(run)
    return run


def normalize_body(part: pa.Array, kanji: Pairs) -> pa.Array:
    texts, null = _texts(part)
    return bodies(texts, kanji).array(null)


def header_end(s: str) -> int:
    """The place after the leading lines that begin with # or are ---, and after the last one's line end."""
    at = 0
    while at <= len(s):
        end = s.find("\n", at)
        stop = len(s) if end < 0 else end
        if not (s.startswith("#", at) or (stop - at >= 3 and s[at:stop].strip() == "---")):
            return at
        at = stop + 1
    return at


def normalize_text(part: pa.Array, kanji: Pairs) -> pa.Array:
    texts, null = _texts(part)
    cuts = [header_end(t) for t in texts]
    own = [t[c:] if c else t for t, c in zip(texts, cuts)]
    blank = np.array([not b or b.isspace() for b in own], bool)
    out = bodies(["" if b else t for t, b in zip(own, blank)], kanji).array(null)
    if not blank.any() and not any(cuts):
        return out
    new = out.to_pylist()
    return pa.array([t if b or n is None else f"{t[: c - 1]}\n\n{n}" if c > 1 else n for t, b, c, n in zip([None if z else t for t, z in zip(texts, null)], blank, cuts, new)], out.type)


# --- findings ---


def _found_chars(run: Run, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]]]:
    at = np.flatnonzero(_chars(pairs)[run.a] != run.a)
    keys = sorted(pairs)
    return at, np.searchsorted(np.array([ord(k) for k, _ in keys], np.int32), run.a[at]), keys


def _found_kana(run: Run) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]]]:
    """Places, rules, and the rules' old and new forms."""
    one = tuple(p for p in T.kana_rules()[0] if len(p[0]) == 1)
    at, which, rules = _found_chars(run, one)
    places, kinds = [at], [which]
    for phase in (0, 1):
        pair = _pairs(phase)
        at, rule = pair.find(run)
        places.append(at - 1)
        kinds.append(rule + len(rules))
        rules = rules + pair.rules
    return np.concatenate(places), np.concatenate(kinds), rules


def _found_particles(run: Run) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]]]:
    kind, rules = _kana(), [*T.COMPOUND_PARTICLES, *T.SINGLE_PARTICLES]
    at = np.flatnonzero(_first()[run.a])
    row = run.rows(at)
    free = np.ones(len(at), bool)
    later = at > run.starts[row]
    free[later] = ~kind[run.a[at[later] - 1]]
    at, ends = at[free], run.starts[row[free] + 1]
    places, kinds = [], []
    for i, (old, _) in enumerate(rules):
        good = run.a[at] == ord(old[0])
        for k, c in enumerate(old[1:], 1):
            good &= _at(run, at, ends, k) == ord(c)
        if len(old) == 1:
            good &= ~kind[_at(run, at, ends, 1)]
        places.append(at[good])
        kinds.append(np.full(len(places[-1]), i))
    return np.concatenate(places), np.concatenate(kinds), rules


def _found_normal(run: Run) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]]]:
    at, which, rules = _found_chars(run, T.MISREADS)
    odd = run.a == ord(T.CONTEXT_MISREAD[0])
    places = [np.flatnonzero(odd & _kana()[near]) for near in (run.behind(), run.ahead())]
    return np.concatenate([at, *places]), np.concatenate([which, *(np.full(len(p), len(rules)) for p in places)]), [*rules, T.CONTEXT_MISREAD]


FINDERS: dict[str, Callable[..., Any]] = {"kana": _found_kana, "particle": _found_particles, "normal": _found_normal}


def findings(part: pa.Array, kinds: Sequence[str], chars: Sequence[Pairs] = (), names: Sequence[str] = ()) -> pa.Array:
    """A list for each text of (old, new, pos), by place, ties in the order of the kinds. ``chars``: tables that come first. ``names``: their categories."""
    texts, null = _texts(part)
    run = Run(texts)
    each = [_found_chars(run, p) for p in chars] + [FINDERS[k](run) for k in kinds]
    at = np.concatenate([x[0] for x in each])
    sizes = np.cumsum([0, *(len(x[2]) for x in each)])
    which = np.concatenate([x[1] + first for x, first in zip(each, sizes)]).astype(np.int32)
    category = np.repeat(np.arange(len(each), dtype=np.int32), [len(x[0]) for x in each])
    order = np.argsort(at, kind="stable")
    at, which, category = at[order], which[order], category[order]
    rules = [r for x in each for r in x[2]]
    offsets = np.searchsorted(at, run.starts).astype(np.int32)
    columns = [pa.array([r[i] for r in rules], pa.string()).take(pa.array(which)) for i in (0, 1)]
    columns.append(pa.array((at - run.starts[run.rows(at)]).astype(np.int32)))
    fields = [pa.field("old", pa.string()), pa.field("new", pa.string()), pa.field("pos", pa.int32())]
    if names:
        columns.append(pa.array(list(names), pa.string()).take(pa.array(category)))
        fields.append(pa.field("category", pa.string()))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=fields), mask=pa.array(null))


def kana_count(part: pa.Array) -> pa.Array:
    texts, null = _texts(part)
    run = Run(texts)
    n = np.diff(np.searchsorted(np.sort(_found_kana(run)[0]), run.starts))
    return pa.array(n.astype(np.int32), mask=null)


# --- trigrams ---


def _whole(run: Run) -> np.ndarray:
    """Places at which a trigram begins."""
    ok = np.ones(len(run.a), bool)
    for i in (1, 2):
        at = run.starts[1:] - i
        ok[at[at >= run.starts[:-1]]] = False
    return np.flatnonzero(ok)


def _strings(chars: np.ndarray) -> pa.Array:
    """Rows of three code points as strings."""
    out = Run([])
    out.a, out.starts = np.ascontiguousarray(chars, np.int32).ravel(), np.arange(len(chars) + 1, dtype=np.int64) * 3
    return out.array()


def trigrams(part: pa.Array) -> pa.Array:
    """All trigrams of each text, by place."""
    texts, null = _texts(part)
    run = Run(texts)
    at = _whole(run)
    offsets = np.searchsorted(at, run.starts).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _strings(np.stack([run.a[at], run.a[at + 1], run.a[at + 2]], axis=1)), mask=pa.array(null))


def _counted(texts: list[str], owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(trigram's code points, its owner, how often), once for each trigram of an owner. ``owner``: of each text, in order."""
    run = Run(texts)
    at = _whole(run)
    letters, small = np.unique(run.a, return_inverse=True)
    k, first = len(letters), int(owner[0]) if len(owner) else 0
    span = int(owner[-1]) - first + 1 if len(owner) else 1
    if k**3 * span >= 1 << 63:  # of one owner they always fit
        middle = int(np.searchsorted(owner, owner[len(owner) // 2]))
        middle = middle or int(np.searchsorted(owner, owner[0], side="right"))
        yield from _counted(texts[:middle], owner[:middle])
        yield from _counted(texts[middle:], owner[middle:])
        return
    small = small.astype(np.int64)
    key = ((small[at] * k + small[at + 1]) * k + small[at + 2]) * span + (owner[run.rows(at)] - first)
    key, n = np.unique(key, return_counts=True)
    code = key // span
    yield letters[np.stack([code // (k * k), code // k % k, code % k], axis=1)], key % span + first, n


def gram_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (known, title, modern): (gram, n, docs) of each slice: how often it stands there, and in how many rows that are known."""
    for batch in batches:
        for known, *fields in slices(*batch.columns):
            texts = [x or "" for row in zip(*(f.to_pylist() for f in fields)) for x in row]
            owner = np.repeat(np.arange(len(known)), len(fields))
            counts = np.asarray(known.cast(pa.int64()))
            for chars, row, n in _counted(texts, owner):
                if len(chars):
                    new = np.concatenate([[True], (np.diff(chars, axis=0) != 0).any(axis=1)])
                    at = np.flatnonzero(new)
                    yield pa.RecordBatch.from_arrays([_strings(chars[at]), pa.array(np.add.reduceat(n, at)), pa.array(np.add.reduceat(counts[row], at))], names=["gram", "n", "docs"])


def gram_sets(part: pa.Array, other: pa.Array) -> pa.Array:
    """The different trigrams of each row's two texts."""
    texts = [x or "" for row in zip(part.to_pylist(), other.to_pylist()) for x in row]
    found = list(_counted(texts, np.repeat(np.arange(len(part)), 2)))
    chars, row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(len(part) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _strings(chars[order]))


__all__ = ["gram_sets", "gram_totals", "trigrams", "convert", "findings", "kana_count", "nfkc", "normalize_body", "normalize_query", "normalize_text", "over", "partial", "slices"]
