import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from tsuzuri.llm import bpe, pii, quality, secrets, sharding
from tsuzuri.llm import common as C
from tsuzuri.llm.queries import tokenizer_files

from .util import copies, table

ODD = [(None, None), (1, None), (1, ""), (2, " \n\t"), (2, "x" * 3000)]


def noise(seed, alphabet, n=300):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]


@pytest.mark.parametrize("alphabet", ["ab.@-+ 1", "0123456789. -", "+()-. 0123", "a@b.c%é\n", "255.01 "])
def test_base_personal_data(alphabet):
    for seed in range(60):
        t = noise(seed, alphabet)
        assert sorted(pii.base_spans(t)) == sorted(plain_pii(t))


def test_long_texts_take_linear_time():
    for t in ("1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "a." * 100_000 + "@", "+" + "1 (" * 80_000):
        pii.base_spans(t)
        secrets.base_spans(t)


def sample_texts():
    rng = random.Random(1)
    out = []
    for i in range(300):
        w = ["wort"] * 30
        for _ in range(3):
            w[rng.randrange(30)] = rng.choice([f"bob{i}.{rng.randrange(99)}@mail.example.com", f"{rng.randrange(255)}.1.2.{rng.randrange(255)}", f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", f"{rng.randrange(10**6, 10**7)}", f"{rng.randrange(10**15, 10**16)}"])
        out.append(" ".join(w))
    return out


def test_field_adds_repeats_and_leaves_others():
    model = pii.fit(sample_texts())
    t = "Call +1 (456) 555-2186 now. " + "filler words " * 200 + "again (456) 555-2186, not 123-456-7890 nor 4041894974608796."
    base, every = pii.find(t, model)
    more = [t[a:b] for k, a, b in every if (k, a, b) not in base]
    assert len(base) == 1 and more == ["(456) 555-2186"] and every[-1][0] == "phone"
    t = "write jan.roe7@mail.example.com; later jan.roe7 or jan.roe7 (at) mail.example.com, never jan.roe8"
    base, every = pii.find(t, model)
    assert [t[a:b] for _, a, b in every if (_, a, b) not in base] == ["jan.roe7", "jan.roe7 (at) mail.example.com"]
    clean = "order 1234567 and part 99-88-77-66 of 2024.01.02 " * 5
    assert pii.find(clean, model) == ([], [])
    assert pii.redact("a b@c.de f", [("email", 2, 8)]) == "a <EMAIL> f"


def exact_beliefs(model, unary, chain, links, groups):
    """Log marginals by summing over all labels of all nodes and skip variables."""
    n, k = unary.shape
    total = np.full((n, k), -np.inf)
    for y in itertools.product(range(k), repeat=n):
        score = sum(unary[i, v] for i, v in enumerate(y)) + sum(model["chain"][y[i], y[i + 1]] for i in chain)
        for g in range(groups):  # a variable is summed out on its own
            score += np.logaddexp.reduce([sum(w * float(model["skip"]) * (y[i] == z) for i, h, w in links if h == g) for z in range(k)])
        for i, v in enumerate(y):
            total[i, v] = np.logaddexp(total[i, v], score)
    return total - np.logaddexp.reduce(total, axis=1, keepdims=True)


def planted_texts(n=120):
    """(text, wanted further spans): a mention that a pattern takes, and far from it a repeat that none takes; and texts with numbers of other kinds."""
    rng, out = random.Random(11), []
    far = " ".join(["filler"] * 120)
    for i in range(n):
        d = f"{rng.randrange(200, 999)} {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        name = f"{rng.choice(['ann', 'jo', 'kim'])}.{rng.choice(['lee', 'roe', 'fox'])}{rng.randrange(10, 99)}"
        card = "".join(rng.choice("0123456789") for _ in range(15))
        card += next(c for c in "0123456789" if plain_luhn(card + c))
        wrong = card[:6] + str((int(card[6]) + 1) % 10) + card[7:]
        first, again, kind = [(f"+1 {d}", d, "phone"), (f"{name}@mail.example.com", name, "email"), (f"{name}@mail.example.com", f"{name} (at) mail.example.com", "email"), (card, wrong, "card")][i % 4]
        text = f"see {first} now. {far} again {again} then."
        a = text.rindex(again)
        out.append((text, {(kind, a, a + len(again))}))
        out.append((f"order {rng.randrange(10**6, 10**7)} of {rng.randrange(10**7, 10**8)} costs {rng.randrange(10**9, 10**10)}. {far} part {rng.randrange(10**10, 10**11)}, call +1 {d}", set()))
    return out


def test_field_against_exact_enumeration():
    model = pii.fit(sample_texts())
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(2, 5)
        unary = pii._norm(np.array([[rng.gauss(0, 1.5) for _ in pii.LABELS] for _ in range(n)]))
        links = [(i, 0, rng.choice([1.0, pii.SIMILAR])) for i in range(n) if rng.random() < 0.7]
        chain = [] if rng.random() < 0.5 else [i for i in range(n - 1) if rng.random() < 0.5]
        got, want = (f(model, unary, chain, links, 1) for f in (pii.infer, exact_beliefs))
        if not chain:  # a tree
            assert np.abs(got - want).max() < 0.02
        assert all(got[i].argmax() == want[i].argmax() or np.sort(want[i])[-1] - np.sort(want[i])[-2] < 0.6 for i in range(n))
    for text, _ in planted_texts(24):  # the spans of whole texts
        base, ns, unary, chain, links, groups = pii.field(text, model)
        best = exact_beliefs(model, unary, chain, links, groups).argmax(1)
        want = base + [(pii.LABELS[y], a, b) for (a, b, k), y in zip(ns, best) if k is None and y]
        assert sorted(pii.find(text, model)[1]) == sorted(want)


def test_planted_repeats_are_found():
    model = pii.fit(sample_texts())
    hit = wanted = found = 0
    for text, want in planted_texts():
        base, every = pii.find(text, model)
        more = set(every) - set(base)
        hit, wanted, found = hit + len(more & want), wanted + len(want), found + len(more)
    assert hit >= 0.95 * wanted and hit >= 0.98 * found, (hit, wanted, found)


def test_personal_data_table(spark):
    rows = [*ODD, *((10 + i, t) for i, t in enumerate(sample_texts()[:40]))]
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.detect(table(spark, rows)).collect()}
    for d, t in rows:
        want = sorted(plain_pii(t or ""), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        r = got[d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == x for k, _, _ in want) for x in pii.KINDS)
    red = pii.redacted(table(spark, rows))
    assert red.columns == table(spark, rows).columns and not any(plain_pii(r["text"] or "") for r in red.collect())
    empty = table(spark, rows).where("doc_id = -1")
    assert pii.detect(empty).count() == 0 and pii.redacted(empty).count() == 0


# --- secrets ---

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def test_base_secrets():
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "token", "apikey", "API_KEY", "ſecret", "toKen", '"', "'", " ", ":", "=", "AKIA", "ABC123", "deadbeef" * 4, "f" * 31, "xyz-_.", "é", "\n"]
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(25))
        assert sorted(secrets.base_spans(t)) == sorted(plain_secrets(t))


def test_random_strings_are_found():
    rng = random.Random(3)
    enc = secrets.tokenizer(*tokenizer_files())
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    runs = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(50)]
    count = lambda s: len(enc.encode_ordinary(s))
    assert sum(any(k == "random" for k, _, _ in secrets.find(f"a {r} b", count)[1]) for r in runs) >= 48
    for clean in ("123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E" + "", "internationalization-Standard-Documentation2", "4" * 30, "sha256-" + "uU0nuZNNPgilLlLX2n2r+sSE7+N6U4DukIj3rOLvzek="):
        assert not [s for s in secrets.find(clean, count)[1] if s[0] == "random"], clean


def test_planted_secrets_recall_and_precision():
    """Random strings of several alphabets and lengths, and names, paths, digests and identifiers."""
    rng = random.Random(8)
    enc = secrets.tokenizer(*tokenizer_files())
    count = lambda s: len(enc.encode_ordinary(s))
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    planted = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet in (letters + digits, letters + digits + "+/", letters[:26] + digits, letters[26:] + digits) for n in (24, 32, 40, 64) for _ in range(40)]
    found = sum(any(k == "random" for k, _, _ in secrets.find(f"value {r} end", count)[1]) for r in planted)
    words = "configuration service account manager request response handler builder factory document session storage network".split()
    clean = ["".join(w.title() for w in rng.sample(words, 4)) for _ in range(150)] + ["_".join(rng.sample(words, 4)) + str(rng.randrange(99)) for _ in range(150)] + [hashlib.sha256(str(i).encode()).hexdigest().upper() for i in range(50)] + ["/".join(rng.sample(words, 4)) + "/v2" for _ in range(100)]
    wrong = sum(any(k == "random" for k, _, _ in secrets.find(f"value {r} end", count)[1]) for r in clean)
    assert found >= 0.95 * len(planted) and wrong == 0, (found, len(planted), wrong)


def test_secrets_table(spark):
    rows = [*ODD, (5, "token = 12345678"), (5, "token = 12345678"), (6, "AKIA" + "A" * 12)]
    got = secrets.detect(table(spark, rows), *tokenizer_files()).collect()
    assert sorted(Counter(r["spans"] for r in got).items()) == [("", 5), ("access:0:16", 1), ("assign:0:16", 2)]
    assert secrets.detect(table(spark, rows).where("doc_id = -1"), *tokenizer_files()).count() == 0


# --- quality ---


def plain_measure(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(grams)
    rep = len({i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)})
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), dup, rep


def test_measures():
    for seed in range(80):
        t = noise(seed, "a b\n\té #|\x1c\x85 ", 200)
        assert quality.measure(t)[:5] == plain_measure(t)


def quality_rows():
    rng = random.Random(7)
    line = "Terms of use apply to this page"
    more = [" ".join(f"{w}{k}" for w in "this footer line is on all pages of the site and says nothing at all".split()) for k in range(4)]
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, "\n".join([body(80), line, *more, body(5)]), "hostA") for i in range(40)]
    rows += [(100 + i, f"{body(80)}", "hostA") for i in range(30)] + [(200 + i, f"{line}\n{body(70)}", "hostB") for i in range(19)]
    rows += [(300, "\n".join([body(20), "terms  of USE apply to this page", *(x.upper() for x in more), body(30)]), "hostA")]
    rows += [(400 + i, "the same copied text " + " ".join(f"c{j}" for j in range(90)), "hostC") for i in range(60)]
    return rows + [(None, None, None), (500, "short", None), (501, body(60), None)]


def plain_lines(text):
    """Normalised lines of a text, with their words."""
    return Counter(x for line in (text or "").split("\n") if (x := " ".join(re.findall(r"[^\x20\x09-\x0D]+", line)).casefold()))


def plain_verdicts(rows, by):
    """doc_id, removed words and kept, by counting in dictionaries."""
    who = lambda d, t: (t or "") if by == "texts" else ("doc", d) if d is not None else (t or "")
    hosts, holders = {}, {}
    for d, t, h in rows:
        hosts.setdefault(h, set()).add(who(d, t))
        for x in plain_lines(t):
            holders.setdefault((h, x), set()).add(who(d, t))
    often = {k for k, v in holders.items() if len(v) >= 20 or len(v) >= 5 and len(v) > 0.2 * len(hosts[k[0]])}
    out = []
    for d, t, h in rows:
        n, _, _, _, rep = plain_measure(t or "")
        gone = sum(k * len(x.split()) for x, k in plain_lines(t).items() if (h, x) in often)
        out.append((d, n, gone, not (n < 50 or 100 * rep > 50 * n) and n - gone >= 0.5 * n))
    return out


@pytest.mark.parametrize("limit,by,hot", [(200_000, "documents", 100_000), (0, "texts", 1), (0, "documents", 3)])
def test_frequent_lines(spark, monkeypatch, limit, by, hot):
    monkeypatch.setattr(C, "HOT", hot)
    rows = quality_rows()
    rows += [rows[0], rows[0], (600, "\n".join(f"small{j} " * 9 + "footer" for j in range(8)), "hostD")]
    rows += [(601 + i, f"{' '.join(f'v{i}x{j}' for j in range(70))}\nSmall  Footer of a small host", "hostE") for i in range(12)]
    judged = quality.judge(table(spark, rows), by=by).collect()
    assert sorted(map(str, [(r["doc_id"], r["n_words"], r["n_removed_words"], r["kept"]) for r in judged])) == sorted(map(str, plain_verdicts(rows, by)))
    got = {r["doc_id"]: r for r in judged}
    assert got[0]["kept"] and got[0]["n_removed_lines"] == 5 and got[0]["n_removed_words"] == 67
    assert got[200]["kept"] and got[200]["n_removed_lines"] == 1  # 19 documents, but all of the host's
    assert got[601]["kept"] and got[601]["n_removed_words"] == 6
    assert not got[300]["kept"] and not got[300]["base_failed"] and got[400]["kept"] == (by == "texts")
    assert not got[500]["kept"] and got[501]["kept"] and got[None]["base_failed"]
    for d, t, _ in rows:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measure(t or "") or d is None
    kept = quality.filtered(table(spark, rows), by=by, broadcast_rows=limit)
    assert kept.columns == table(spark, rows).columns
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(text) == {d for d, r in got.items() if r["kept"]} and "Terms" not in text[0] and "Terms" not in text[200]
    empty = table(spark, rows).where("doc_id = -1")
    assert quality.judge(empty).count() == 0 and quality.filtered(empty).count() == 0


def test_a_hot_host_does_not_raise_the_limit(spark):
    """A line in a few of very many documents of a host goes as well."""
    rng = random.Random(9)
    body = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, body() + ("\nshared line here" if i < 25 else ""), "hot") for i in range(400)]
    assert sum(r["n_removed_words"] for r in quality.judge(table(spark, rows)).collect()) == 25 * 3
    with pytest.raises(ValueError):
        quality.judge(table(spark, rows), by="rows")


# --- encoding ---


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    path, pattern = tokenizer_files()
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_encoding_equals_tiktoken(tiktoken_encoding):
    coder = bpe.Encoder(bpe.read_ranks(tokenizer_files()[0]), public_tokenizers.PATTERN)
    for seed in range(400):
        t = noise(seed, ["a", "b", "the", " ", "  ", "\n", "'s", "é", "國", "1", "²", "!", "\x1c", "\x85", " ", "\U0001f600", "ß", "Ж", "ӿ", "Ԁ"], 60)
        ids = coder.encode(t)
        assert ids == tiktoken_encoding.encode_ordinary(t) and coder.decode(ids) == t.encode()
    for t in ("a" * 30_000, "ab" * 9_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000)), " " * 5_000):
        assert coder.encode(t) == tiktoken_encoding.encode_ordinary(t)


def test_rank_queue_against_sorting():
    rng = random.Random(4)
    queue, held = bpe.RankQueue(5000), []
    for _ in range(4000):
        if held and rng.random() < 0.5:
            held.sort()
            assert queue.pop() == held.pop(0)
        else:
            x = (rng.randrange(5000) if rng.random() < 0.7 else 7, rng.randrange(10**6))
            held.append(x)
            queue.push(*x)


def test_memory_of_pretokens_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 10)
    coder = bpe.Encoder(bpe.read_ranks(tokenizer_files()[0]), public_tokenizers.PATTERN)
    for i in range(200):
        coder.encode(f"word{i} other{i}")
        assert len(coder.kept) <= 30


def test_encoding_table(spark, tiktoken_encoding):
    rows = [*ODD, *copies(3, 10)]
    got = bpe.digests(table(spark, rows), *tokenizer_files()).collect()
    want = [(d, len(ids := tiktoken_encoding.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(table(spark, rows), *tokenizer_files()), tokenizer_files()[0])
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.digests(table(spark, rows).where("doc_id = -1"), *tokenizer_files()).count() == 0


# --- sharding ---


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p) == list(range(n)) and (sharding.permute(p, n, inverse=True) == np.arange(n)).all()


def test_shards(spark):
    rows = [*ODD, *copies(2, 60), *[(9, "same")] * 50]
    got = sharding.shard(table(spark, rows), 7).collect()
    again = sharding.shard(table(spark, rows).repartition(11).orderBy("text"), 7).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(again)
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(table(spark, rows).where("doc_id = -1")).count() == 0
