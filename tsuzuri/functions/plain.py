"""The same text functions for single Python strings: for literal queries on the driver, for Arrow functions, and as twins in tests."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from . import tables as T

Finding = tuple[str, str, int]


def _text(s: str) -> str:
    if not isinstance(s, str):
        raise TypeError(f"a string is needed, not {type(s).__name__}")
    return s


@lru_cache
def _map(pairs: tuple[tuple[str, str], ...]) -> dict[int, str]:
    return {ord(k): v for k, v in pairs}


def convert_old_kanji(s: str, tables: T.Tables | None = None) -> str:
    return _text(s).translate(_map((tables or T.defaults()).kanji))


def convert_hentaigana(s: str, tables: T.Tables | None = None) -> str:
    return _text(s).translate(_map((tables or T.defaults()).hentaigana))


def convert_historical_kana(s: str) -> str:
    for phase in T.kana_rules():
        for old, new in phase:
            s = s.replace(old, new)
    return s


def particle_rules() -> list[tuple[str, str, str]]:
    """(pattern, old, new), in order; the patterns mean the same in Python and Java. The literal stands first, as it fails soonest."""
    alone = lambda k: f"{k}(?<![{T.KANA_CLASS}]{k})"
    return [(alone(k), k, v) for k, v in T.COMPOUND_PARTICLES] + [(f"{alone(k)}(?![{T.KANA_CLASS}])", k, v) for k, v in T.SINGLE_PARTICLES]


def any_particle() -> str:
    """All particles in one pattern: at a place that no kana precedes, at most one of them can stand."""
    several, one = ("|".join(k for k, _ in T.COMPOUND_PARTICLES), "".join(k for k, _ in T.SINGLE_PARTICLES))
    return f"(?<![{T.KANA_CLASS}])(?:[{one}](?![{T.KANA_CLASS}])|{several})"


def convert_katakana_particles(s: str) -> str:
    for pattern, _, new in particle_rules():
        s = re.sub(pattern, new, s)
    return s


def convert(s: str, tables: T.Tables | None = None) -> str:
    return convert_katakana_particles(convert_historical_kana(convert_hentaigana(convert_old_kanji(s, tables), tables)))


def nfkc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFKC", s)


def width(s: str) -> str:
    """Half-width kana to full, full-width letters to half: what NFKC does."""
    return nfkc(s)


def correct_misreads(s: str) -> str:
    return s.translate(_map(T.MISREADS))


def context_rules() -> list[str]:
    old = T.CONTEXT_MISREAD[0]
    return [f"(?<=[{T.KANA_CLASS}]){old}", f"{old}(?=[{T.KANA_CLASS}])"]


def correct_context(s: str) -> str:
    for pattern in context_rules():
        s = re.sub(pattern, T.CONTEXT_MISREAD[1], s)
    return s


def punctuation(s: str) -> str:
    s = re.sub(r"(?<!\d)\.(?!\d)", "。", s.replace(",", "、"))
    return re.sub("、{2,}", "、", re.sub("。{2,}", "。", s))


def whitespace(s: str) -> str:
    lines = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return re.sub("\n{3,}", "\n\n", "\n".join(x.strip() for x in lines))


def split_header(s: str) -> tuple[str, str]:
    lines = s.split("\n")
    n = next((i for i, x in enumerate(lines) if not (x.startswith("#") or x.strip() == "---")), len(lines))
    return "\n".join(lines[:n]), "\n".join(lines[n:])


def normalize_body(s: str, tables: T.Tables | None = None) -> str:
    s = convert_historical_kana(width(convert_old_kanji(nfkc(s), tables)))
    return whitespace(punctuation(convert_katakana_particles(correct_context(correct_misreads(s)))))


def normalize_text(s: str, tables: T.Tables | None = None) -> str:
    header, body = split_header(s)
    if not body.strip():
        return s
    body = normalize_body(body, tables)
    return f"{header}\n\n{body}" if header else body


def normalize_query(s: str, tables: T.Tables | None = None) -> str:
    return convert_katakana_particles(convert_historical_kana(width(convert_old_kanji(nfkc(s), tables))))


def _find_chars(s: str, pairs: tuple[tuple[str, str], ...]) -> list[Finding]:
    m = _map(pairs)
    return [(c, m[ord(c)], i) for i, c in enumerate(s) if ord(c) in m]


def find_old_kanji(s: str, tables: T.Tables | None = None) -> list[Finding]:
    return _find_chars(_text(s), (tables or T.defaults()).kanji)


def find_hentaigana(s: str, tables: T.Tables | None = None) -> list[Finding]:
    return _find_chars(_text(s), (tables or T.defaults()).hentaigana)


@lru_cache
def kana_pattern() -> str:
    """All historical kana in one pattern, by their last character: no two of them overlap."""
    heads: dict[str, str] = {}
    for phase in T.kana_rules():
        for k, _ in phase:
            heads[k[1:]] = heads.get(k[1:], "") + k[0]
    return "|".join(f"[{h}]{tail}" for tail, h in heads.items())


@lru_cache
def _kana() -> tuple[re.Pattern, dict[str, str]]:
    return re.compile(kana_pattern()), {k: v for phase in T.kana_rules() for k, v in phase}


def find_historical_kana(s: str) -> list[Finding]:
    pattern, new = _kana()
    return [(m[0], new[m[0]], m.start()) for m in pattern.finditer(s)]


def find_katakana_particles(s: str) -> list[Finding]:
    found = [(old, new, m.start()) for pattern, old, new in particle_rules() for m in re.finditer(pattern, s)]
    return sorted(found, key=lambda f: f[2])


def find(s: str, tables: T.Tables | None = None) -> list[tuple[str, str, int, str]]:
    """All findings on the original text with their category, by position; ties in the order of the categories."""
    each = (("kanji", find_old_kanji(s, tables)), ("hentaigana", find_hentaigana(s, tables)), ("kana", find_historical_kana(s)), ("particle", find_katakana_particles(s)))
    return sorted(((*f, c) for c, fs in each for f in fs), key=lambda f: f[2])


def find_normalizations(s: str) -> list[Finding]:
    found = _find_chars(s, T.MISREADS) + [(m[0], T.CONTEXT_MISREAD[1], m.start()) for p in context_rules() for m in re.finditer(p, s)]
    return sorted(found, key=lambda f: f[2])
