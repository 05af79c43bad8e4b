"""Character tables. Large tables come from a rule, from the file beside this module, or from files that the caller names."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

# Modern forms whose old forms Unicode has as compatibility ideographs.
COMPATIBILITY = "侮僧免勉勤卑喝嘆器塀墨層悔慨憎懲敏既暑梅殺海漢煮碑社祉祈祖祝神祥禍福穀突節署繁者臭著虜褐視諸謁謹賓贈練逸都難響頻類隆塚廊朗欄"


def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


def one_to_one(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """What maps one character to another one."""
    return {k: v for k, v in pairs if isinstance(k, str) and isinstance(v, str) and len(k) == len(v) == 1 and k != v}


def read_tables(*paths: str) -> dict[str, str]:
    """JSON objects of characters, later files win."""
    out: dict[str, str] = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            out |= one_to_one(json.load(f).items())
    return out


@lru_cache
def default_kanji() -> dict[str, str]:
    """The pairs of old_forms.txt, and the compatibility ideographs by Unicode's own decompositions (of several, the last one)."""
    lines = resources.files(__package__).joinpath("old_forms.txt").read_text(encoding="utf-8").splitlines()
    pairs = _pairs(" ".join(x for x in lines if not x.startswith("#")))
    compat = {m: chr(c) for c in range(0xF900, 0xFA6B) if (m := unicodedata.normalize("NFKC", chr(c))) in COMPATIBILITY}
    return one_to_one(pairs.items()) | one_to_one((old, m) for m, old in compat.items())


# The kana that variant forms stand for, with their number of forms, in the order of the code points from a first one on.
HENTAIGANA = (
    (0x1B002, "い4 う3 え6 お4 か7 き7 く4 け6 こ6 さ7 し8 す5 せ4 そ4 た4 ち6 つ5 て5 と6 な6 に6 ぬ3 ね4 の6 は9 ひ5 ふ4 へ4 ほ5 ま7 み4 む4 め4 も4 や5 ゆ4 よ6 ら5 り6 る5 れ4 ろ4 わ4 い2 え1 を6 ん1"),
    (0x1B101, "え2 こ2 し2 す2 と3 の2 は2 ひ2 ふ2 へ1 む2 り3 ろ3 い1 え1"),
)


@lru_cache
def default_hentaigana() -> dict[str, str]:
    """Runs of code points, each one kana's variant forms."""
    runs = ((first, "".join(x[0] * int(x[1:]) for x in kana.split())) for first, kana in HENTAIGANA)
    return {chr(first + i): k for first, kana in runs for i, k in enumerate(kana)}


@dataclass(frozen=True)
class Tables:
    """The two character tables. ``Tables.read`` takes files for either; without, the defaults above hold."""

    kanji: tuple[tuple[str, str], ...]
    hentaigana: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, kanji: dict[str, str] | None = None, hentaigana: dict[str, str] | None = None) -> Tables:
        k = default_kanji() if kanji is None else one_to_one(kanji.items())
        h = default_hentaigana() if hentaigana is None else one_to_one(hentaigana.items())
        return cls(tuple(k.items()), tuple(h.items()))

    @classmethod
    def read(cls, kanji: Iterable[str] = (), hentaigana: Iterable[str] = ()) -> Tables:
        kanji, hentaigana = tuple(kanji), tuple(hentaigana)
        return cls.of(read_tables(*kanji) if kanji else None, read_tables(*hentaigana) if hentaigana else None)


@lru_cache
def defaults() -> Tables:
    return Tables.of()


def _row(kana: str, shift: int) -> str:
    return "".join(chr(ord(k) + shift) for k in kana)


# The kana whose combination with う is contracted, and what replaces them.
A_ROW, O_ROW = "あかさたなはまやらわがざだばぱ", "おこそとのほもよろおごぞどぼぽ"
E_ROW, E_SMALL = "えけせてねへめれげぜでべぺ", ("よ", *(k + "ょ" for k in "きしちにひみりぎじぢびぴ"))
I_ROW, I_SMALL = "いきしちにひみりぎじぢびぴ", ("ゆ", *(k + "ゅ" for k in "きしちにひみりぎじぢびぴ"))
KATAKANA = ord("ア") - ord("あ")


@lru_cache
def kana_rules() -> tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]]:
    """Literal replacements of historical kana, in two phases: what the first makes may be input of the second, whose own order is free."""
    first = [("ゐ", "い"), ("ゑ", "え"), ("ヰ", "イ"), ("ヱ", "エ"), ("クヮ", "カ"), ("グヮ", "ガ"), ("くゎ", "か"), ("ぐゎ", "が")]
    second = [("テフ", "チョー"), ("てふ", "ちょう")]
    for heads, tails in ((A_ROW, O_ROW), (E_ROW, E_SMALL), (I_ROW, I_SMALL)):
        for h, t in zip(heads, tails):
            second.append((h + "う", t + "う"))
            second.append((_row(h, KATAKANA) + "ウ", _row(t, KATAKANA) + "ー"))
    return tuple(first), tuple(second)


# Particles written in katakana; several characters first, in this order, then single ones.
COMPOUND_PARTICLES = (("ニシテ", "にして"), ("トシテ", "として"), ("ニテ", "にて"), ("ヨリ", "より"), ("マデ", "まで"), ("カラ", "から"), ("ノミ", "のみ"), ("トモ", "とも"))
SINGLE_PARTICLES = (("ノ", "の"), ("ハ", "は"), ("ニ", "に"), ("ヲ", "を"), ("モ", "も"), ("ガ", "が"), ("ト", "と"), ("ヘ", "へ"))
KANA_CLASS = "ァ-ヶー"

# Characters that optical recognition confuses, and one whose neighbours decide.
MISREADS = (("郧", "郎"), ("郘", "郎"), ("郯", "郎"), ("衠", "術"), ("鑜", "鑽"), ("翤", "翩"))
CONTEXT_MISREAD = ("卜", "ト")

#: All white space as Python's str.strip() sees it.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
