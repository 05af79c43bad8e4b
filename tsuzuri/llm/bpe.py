"""Byte-level BPE by a rank queue with a hierarchical bitmap.

A pre-token's bytes form a linked list. Each adjacent pair with a merge rank puts its position in that rank's bucket.
Two levels of 256-bit words say which buckets hold something, so find-first-set gives the least rank in two steps
whatever the length. Positions leave a bucket from left to right; an entry whose pair has changed meanwhile is skipped.
A merge costs the same in a pre-token of a million bytes as in a short one.

Defined results: null or empty text gives no ids; a null doc_id stays null; repeated rows give equal rows; of pairs with equal
rank the leftmost is merged first; texts are encoded whole, very long pre-tokens by the queue in n log n steps; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from heapq import heappop, heappush
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Pre-tokens of up to so many bytes are remembered, so many of them in each of two generations.
KEEP_BYTES, KEEP = 48, 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Characters below this have explicit classes in the fast splitter.
COMMON = 0x500


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern that uses properties of characters.

    Where a text has only common characters, the properties are spelled out as classes, which the standard library's faster engine takes."""
    import regex

    whole = regex.compile(pattern).findall

    def cls(prop: str) -> str:
        member, out, i = regex.compile(prop).match, "", 0
        while i < COMMON:
            j = i
            while j < COMMON and member(chr(j)):
                j += 1
            if j > i:
                out += f"\\u{i:04x}-\\u{j - 1:04x}"
            i = j + 1
        return out

    letter, number, space = cls(r"\p{L}"), cls(r"\p{N}"), cls(r"\s")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    for name, body in ((r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        plain = plain.replace(name, body)
    if "\\p" in plain or "(?i" in plain:
        return whole
    fast, rare = re.compile(plain).findall, re.compile(f"[^\x00-{chr(COMMON - 1)}]").search
    return lambda text: whole(text) if rare(text) else fast(text)


class Kept(dict):
    """Ids of a pre-token and their decimal string; what is missing is merged, and kept if short."""

    def __init__(self, merge: Callable[[bytes], list[int]]) -> None:
        super().__init__()
        self.merge = merge
        self.older: dict = {}

    def __missing__(self, token: str) -> tuple[tuple[int, ...], str]:
        found = self.older.get(token)
        if found is None:
            ids = tuple(self.merge(token.encode()))
            found = ids, ",".join(map(str, ids))
        if len(token) <= KEEP_BYTES:
            self[token] = found
        return found

    def trim(self) -> None:
        if len(self) > KEEP:
            self.older = dict(self)
            self.clear()


class RankQueue:
    """Buckets of positions by rank; push() and pop() of the least rank's leftmost position.

    A bitmap of two levels of 256-bit words says which buckets hold something. A bucket is one position, or a heap of several."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * (ranks // 256 + 1)
        self.top = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = position
            a = rank >> 8
            if not self.low[a]:
                self.top |= 1 << a
            self.low[a] |= 1 << (rank & 255)
        elif bucket.__class__ is int:
            self.buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """Only if ``top`` is not 0."""
        top = self.top
        a = (top & -top).bit_length() - 1
        low = self.low[a]
        rank = a << 8 | (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        if bucket.__class__ is not int:
            position = heappop(bucket)
            if bucket:
                return rank, position
            bucket = position
        del self.buckets[rank]
        self.low[a] = low = low & (low - 1)
        if not low:
            self.top = top & (top - 1)
        return rank, bucket


class Encoder:
    """Encodes and decodes by a rank file's merges; ``pattern`` cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks))
        self.split = splitter(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.kept = Kept(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. A whole pre-token that has a rank is one id."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n == 1:
            raise KeyError(f"the vocabulary lacks the byte {piece!r}")
        queue, get = self.queue, ranks.get
        push, pop = queue.push, queue.pop
        end = list(range(1, n + 1))  # where the part that starts at i ends
        prev = list(range(-1, n - 1))
        pair = [-1] * n  # the rank of the part at i with the next one; -1: none, or i starts no part
        for i in range(n - 1):
            r = get(piece[i : i + 2], -1)
            if r >= 0:
                pair[i] = r
                push(r, i)
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            e = end[i] = end[j]
            pair[j] = -1
            if e < n:
                prev[e] = i
                r = get(piece[i : end[e]], -1)
                pair[i] = r
                if r >= 0:
                    push(r, i)
            else:
                pair[i] = -1
            p = prev[i]
            if p >= 0:
                r = get(piece[p:e], -1)
                if r != pair[p]:
                    pair[p] = r
                    if r >= 0:
                        push(r, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def pairs(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        self.kept.trim()
        return list(map(self.kept.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(itemgetter(0), self.pairs(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One for each Python worker: what it has remembered serves the next task."""
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = Encoder(read_ranks(vocabulary), pattern)
    return _ENCODERS[vocabulary, pattern]


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode each whole text and decode its ids again; counts and digests for each document."""

    def run(batch: pa.RecordBatch, coder: Encoder) -> pa.RecordBatch:
        n, ids_sha, back_sha = [], [], []
        for text in C.texts(batch):
            pairs = coder.pairs(text)
            ids = list(chain.from_iterable(map(itemgetter(0), pairs)))
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(itemgetter(1), pairs)).encode()).hexdigest())
            back_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return C.arrow_map(C.id_text(docs), run, OUT, setup=lambda: encoder(vocabulary, pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batch: pa.RecordBatch, coder: Encoder) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode(t) for t in C.texts(batch)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return C.arrow_map(C.id_text(docs), run, "doc_id long, ids array<int>", setup=lambda: encoder(vocabulary, pattern))


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids): the bytes that the ids stand for; null ids give null."""

    def run(batches):
        words = {v: k for k, v in read_ranks(vocabulary).items()}
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else b"".join(map(words.__getitem__, x)) for x in ids], pa.binary())], ["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
