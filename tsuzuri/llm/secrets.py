"""Secrets: base patterns, and a token-efficiency test that finds random strings.

A byte-pair vocabulary spends few tokens on what looks like language and many on random characters. A candidate run of
``[A-Za-z0-9+/_=-]`` that no base pattern took is a secret if it has few characters for each token. Known digests (hex of
the usual lengths), identifiers (UUIDs, plain numbers, one-case words) and short runs are left out.

Defined results: null or empty text gives no spans; a null doc_id stays null; repeated rows give equal rows; spans that
start together stand in the order of the kinds; a run at exactly the limit is not random; texts are read whole, whatever their length; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

KINDS = ("assign", "access", "hex", "random")
ORDER = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_DIGEST = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-:=_])?([0-9a-fA-F]+|[A-Za-z0-9+/]+={0,2})\Z")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))

#: A run with fewer characters for each token than this is random.
MAX_CHARS_PER_TOKEN = 1.9
MIN_LENGTH = 20
_CASES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def known(s: str) -> bool:
    """A digest or an identifier, not a secret."""
    if _UUID.match(s) or sum(bool(c.search(s)) for c in _CASES) < 2:
        return True
    m = _DIGEST.match(s)
    if not m:
        return False
    body = m[1]
    is_hex = all(c in "0123456789abcdefABCDEF" for c in body)
    return is_hex and len(body) in DIGEST_LENGTHS or s != body and not is_hex and len(body.rstrip("=")) in (22, 27, 38, 43, 64, 86)


def tokenizer(vocabulary: str, pattern: str):
    """A tiktoken encoding from a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def find(text: str, count) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans. count(string): its number of tokens."""
    base = base_spans(text)
    taken, i, more = sorted((a, b) for _, a, b in base), 0, []
    for m in _RUN.finditer(text):
        a, b = m.start(), m.end()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if (i == len(taken) or taken[i][0] >= b) and not known(m[0]) and b - a < MAX_CHARS_PER_TOKEN * count(m[0]):
            more.append(("random", a, b))
    return base, base + more


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def detect(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """A row for each document: counts and digest of its base spans, and all spans as one string."""

    def run(batch: pa.RecordBatch, encoding) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text in C.texts(batch):
            base, every = find(text, lambda s: len(encoding.encode_ordinary(s)))
            kinds = [k for k, _, _ in every]
            for c, k in zip((*cols[:3], cols[5]), KINDS):
                c.append(kinds.count(k))
            cols[3].append(hashlib.sha256(C.span_string(base, ORDER).encode()).hexdigest())
            cols[4].append(C.span_string(every, ORDER))
        longs, strings = pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (longs, longs, longs, strings, strings, longs)))], [x.split()[0] for x in OUT.split(", ")])

    return C.arrow_map(C.id_text(docs), run, OUT, setup=lambda: tokenizer(vocabulary, pattern))
