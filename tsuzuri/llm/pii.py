"""Personal data: base patterns, and a skip-chain conditional random field that adds missed mentions.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Nodes of the field are the base
spans (clamped) and weaker candidates: digit groups that no pattern took, spelled-out addresses such as
``name (at) host``, and repeats of a found address's local part. Neighbouring nodes are joined in a chain.
Nodes with equal tokens (same last ten digits, same local part) or similar ones (same last seven digits; one half of a long
number, so one wrong digit does not matter; a local part but for case, dots and hyphens), however far apart, hang on one
shared variable each, which costs as many messages as nodes, not pairs. Loopy sum-product passes with damping then
make labels agree over the whole document.

Unary weights are a softmax fitted on a bounded sample of documents (at most ``sample_docs``, of at most ``sample_chars`` characters each):
candidates are labelled ``none``, and each base span also gives a masked copy, weakened as a missed mention would be (a phone number
without its country code, a spelled-out address, a card number with a wrong digit), half of it under its label, half as ``none``. Chain and skip potentials are
estimated from the same sample. ``DOUBT`` keeps candidates that nothing supports out.

Defined results: null or empty text gives no spans; a null doc_id stays null; repeated rows give equal rows; of equally likely labels
``none`` wins, then the kinds as listed; of overlapping candidates the first one counts, of those with one start the longest; texts are
read whole, in time linear in their length; an empty table gives an empty result (the field then has its prior weights); other columns,
whatever their names, are ignored by ``detect`` and kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
LABELS = ("none", *KINDS)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match that starts inside a run of digits goes on as one from its first digit does, so only the first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUPS = re.compile(r"\(?[0-9]{2,}+(?:\)?[ .-]?\(?[0-9]{2,}+)*+\)?")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
_MARK = re.compile(r"[(\[{]at[)\]}]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT_VALUES = {ord(c): i for i, c in enumerate("0123456789")}


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped without another try. Linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        nxt = at + 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            done = nxt = m.end()
        else:
            done = at + 1
        at = text.find("@", nxt)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 or len(x.lstrip("0")) <= 3 for x in m[0].split(".")) and all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Weaker mentions that overlap no base span."""
    found = [(m.start(), m.end()) for m in _GROUPS.finditer(text) if m.end() - m.start() >= 7 and 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 19]
    if _MARK.search(text):
        found += [(m.start(), m.end()) for m in _SPELLED.finditer(text)]
    for local in {text[a:b].partition("@")[0] for k, a, b in base if k == "email"}:
        if len(local) >= 5:
            p = text.find(local)
            while p >= 0:
                e = p + len(local)
                if (p == 0 or text[p - 1] not in _LOCAL_CHARS) and (e == len(text) or text[e] not in _LOCAL_CHARS and text[e] != "@"):
                    found.append((p, e))
                p = text.find(local, e)
    taken = sorted((a, b) for _, a, b in base)
    out, i, last = [], 0, -1
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if (i == len(taken) or taken[i][0] >= b) and a >= last:
            out.append((a, b))
            last = b
    return out


N_FEATURES = 12


def features(s: str) -> list[float]:
    d = _NOT_DIGIT.sub("", s)
    n = len(d)
    parts = s.split(".")
    return [1.0, n < 10, 10 <= n <= 13, 14 <= n <= 16, n > 16, s[:1] == "+", n >= 14 and luhn(d), len(parts) == 4 and all(p.isdigit() for p in parts), "@" in s, bool(_MARK.search(s)), any(c.isalpha() for c in s), "(" in s or " " in s or "-" in s]


def keys(s: str, kind: str | None) -> list[tuple[str, float]]:
    """What a node shares with equal (weight 1) or similar ones."""
    out = []
    d = _NOT_DIGIT.sub("", s)
    if s.count(".") == 3 and kind in (None, "ip"):
        out.append(("i" + s.strip("()"), 1.0))
    elif len(d) >= 7 and "@" not in s:
        if len(d) >= 10:
            out.append(("d" + d[-10:], 1.0))
        if len(d) >= 14:
            out += [("h" + d[:8], HALF), ("t" + d[-8:], HALF)]
        else:
            out.append(("s" + d[-7:], SIMILAR))
    local = None
    if kind == "email":
        local = s.partition("@")[0]
    elif kind is None and not s[0].isdigit() and s[0] != "(":
        local = re.split(r" ?[(\[{]at[)\]}]", s, maxsplit=1)[0]
    if local:
        out += [("l" + local.lower(), 1.0), ("m" + re.sub("[._%+-]", "", local.lower()), SIMILAR)]
    return out


def weakened(kind: str, s: str) -> list[str]:
    """How a mention might stand where no pattern takes it."""
    if kind == "phone":
        return [re.sub(r"^\+[0-9]{1,3}?[ .-]", "", s)]
    if kind == "email":
        local, _, host = s.partition("@")
        return [f"{local} (at) {host}", local]
    if kind == "card":
        return [s[:-1] + str((int(s[-1]) + 1) % 10)]
    return [f"({s})"]


def nodes(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str | None]]]:
    base = base_spans(text)
    weak = candidates(text, base)
    return base, sorted([(a, b, k) for k, a, b in base] + [(a, b, None) for a, b in weak], key=lambda x: (x[0], x[1], x[2] or ""))


#: Characters between neighbours in the chain; passes of the messages; damping; log odds against a mention that no pattern took.
NEAR, PASSES, DAMP, DOUBT = 64, 12, 0.5, 2.0
#: Weights of links between similar tokens: by seven digits or a local part's letters, and by half of a long number. Equal tokens have 1.
SIMILAR, HALF = 0.7, 1.5


def prior() -> dict[str, np.ndarray]:
    return {"unary": np.zeros((N_FEATURES, len(LABELS))), "chain": np.zeros((len(LABELS), len(LABELS))), "skip": np.array(3.0)}


def fit(sample: list[str], steps: int = 300, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Softmax weights by gradient descent on candidates and masked base spans, chain potentials as log ratios, the skip potential as log odds that linked base spans agree."""
    model, n = prior(), len(LABELS)
    xs, ys = [], []
    pair, agree, total = np.ones((n, n)), 0, 0
    # a masked copy stands for a mention or for nothing: it never speaks for a kind by itself
    target = {k: np.eye(n)[0] / 2 + np.eye(n)[LABELS.index(k)] / 2 for k in KINDS} | {None: np.eye(n)[0]}
    for text in sample:
        _, ns = nodes(text)
        labels = [LABELS.index(k) if k else 0 for _, _, k in ns]
        for a, b, k in ns:
            forms = weakened(k, text[a:b]) if k else [text[a:b]]
            xs += [features(x) for x in forms]
            ys += [target[k]] * len(forms)
        for (x, y), (p, q) in zip(zip(ns, ns[1:]), zip(labels, labels[1:])):
            if y[0] - x[1] <= NEAR:
                pair[p, q] += 1
        seen: dict[str, int] = {}
        for (a, b, k), y in zip(ns, labels):
            for key, _ in keys(text[a:b], k) if k else ():
                if key in seen:
                    total += 1
                    agree += seen[key] == y
                seen[key] = y
    if xs:
        x, y = np.array(xs, float), np.array(ys)
        w = model["unary"]
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w = w - 0.5 * (x.T @ (p - y) / len(x) + l2 * w)
        model["unary"] = w
        row, col = pair.sum(1, keepdims=True), pair.sum(0, keepdims=True)
        model["chain"] = np.clip(np.log(pair * pair.sum() / (row * col)), -1, 1) * 0.5
    model["skip"] = np.array(np.log((agree + 20.0) / (total - agree + 1.0)) + 2.0)
    return model


def _norm(x: np.ndarray) -> np.ndarray:
    return x - np.logaddexp.reduce(x, axis=-1, keepdims=True)


def infer(model: dict[str, np.ndarray], unary: np.ndarray, chain: list[int], links: list[tuple[int, int, float]], groups: int) -> np.ndarray:
    """Log beliefs of the nodes. chain: i for an edge between i and i + 1; links: (node, group of its skip variable, weight)."""
    n, k = unary.shape
    t, skip = model["chain"], float(model["skip"])
    e = np.array(chain, int)
    right, left = np.zeros((len(e), k)), np.zeros((len(e), k))
    who, grp = (np.array([x[i] for x in links], int) for i in (0, 1))
    up, down = np.zeros((len(links), k)), np.zeros((len(links), k))
    agree = np.eye(k) * skip * np.array([x[2] for x in links]).reshape(-1, 1, 1)
    bel = unary
    for _ in range(PASSES):
        if len(e):
            new_r = _norm(np.logaddexp.reduce((bel[e] - left)[:, :, None] + t[None], axis=1))
            new_l = _norm(np.logaddexp.reduce((bel[e + 1] - right)[:, None, :] + t[None], axis=2))
            right, left = DAMP * right + (1 - DAMP) * new_r, DAMP * left + (1 - DAMP) * new_l
        if len(who):
            new_up = _norm(np.logaddexp.reduce((bel[who] - down)[:, :, None] + agree, axis=1))
            up = DAMP * up + (1 - DAMP) * new_up
            tot = np.zeros((groups, k))
            np.add.at(tot, grp, up)
            new_down = _norm(np.logaddexp.reduce((tot[grp] - up)[:, :, None] + agree, axis=1))
            down = DAMP * down + (1 - DAMP) * new_down
        before, bel = bel, unary.copy()
        np.add.at(bel, e + 1, right)
        np.add.at(bel, e, left)
        np.add.at(bel, who, down)
        if np.abs(_norm(bel) - _norm(before)).max(initial=0) < 1e-4:
            break
    return _norm(bel)


def field(text: str, model: dict[str, np.ndarray]) -> tuple[list, list, np.ndarray, list[int], list[tuple[int, int, float]], int]:
    """Base spans, nodes, and the field over them: unary potentials, chain edges, skip links and the number of their variables."""
    base, ns = nodes(text)
    unary = _norm(np.array([features(text[a:b]) for a, b, _ in ns], float).reshape(-1, N_FEATURES) @ model["unary"])
    unary[:, 0] += DOUBT
    ids: dict[str, int] = {}
    links = [(i, ids.setdefault(key, len(ids)), w) for i, (a, b, k) in enumerate(ns) for key, w in keys(text[a:b], k)]
    for i, (_, _, k) in enumerate(ns):
        if k:
            unary[i] = np.where(np.arange(len(LABELS)) == LABELS.index(k), 0.0, -30.0)
    chain = [i for i in range(len(ns) - 1) if ns[i + 1][0] - ns[i][1] <= NEAR]
    # a variable that one node alone hangs on says nothing
    many = np.bincount([g for _, g, _ in links], minlength=len(ids)) > 1
    at = np.cumsum(many) - 1
    return base, ns, unary, chain, [(i, int(at[g]), w) for i, g, w in links if many[g]], int(many.sum())


def find(text: str, model: dict[str, np.ndarray]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    base, ns, unary, chain, links, groups = field(text, model)
    if len(ns) == len(base):
        return base, base
    best = infer(model, unary, chain, links, groups).argmax(1)
    return base, base + [(LABELS[y], a, b) for (a, b, k), y in zip(ns, best) if k is None and y]


def train(docs: DataFrame, sample_docs: int = 2000, sample_chars: int = 20_000) -> dict[str, np.ndarray]:
    """Fit on a bounded sample: of documents of ``sample_chars`` characters or less, about ``sample_docs`` at most, those with the least hash of doc_id and text."""
    rows = C.id_text(docs)
    return fit([r["text"] or "" for r in C.hashed_sample(rows.where(F.length("text") <= sample_chars), ["doc_id", "text"], rows.count(), sample_docs).select("text").collect()])


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, sample_docs: int = 2000) -> DataFrame:
    """A row for each document: counts and digest of its base spans, and all spans as one string."""
    model = train(docs, sample_docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text in C.texts(batch):
            base, every = find(text, model)
            kinds = [k for k, _, _ in base]
            for c, k in zip(cols, KINDS):
                c.append(kinds.count(k))
            cols[4].append(hashlib.sha256(C.span_string(base, ORDER).encode()).hexdigest())
            cols[5].append(C.span_string(every, ORDER))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return C.arrow_map(C.id_text(docs), run, OUT)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes the first one's kind in angle brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, sample_docs: int = 2000) -> DataFrame:
    """The same table with every found span replaced in ``text``; a text without spans, or a null, stays as it is.

    What a replaced neighbour had hidden from a pattern is found and replaced in turn."""
    model, schema = train(docs, sample_docs), docs.schema

    def clean(t: str | None) -> str | None:
        while t and (spans := find(t, model)[1]):
            t = redact(t, spans)
        return t

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index("text")
        new = [clean(t) for t in batch.column(i).to_pylist()]
        return batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    return C.arrow_map(docs, run, schema)
