"""Small tables for the tests of the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, rank int, part string"


def table(spark, rows):
    """A documents table with extra columns whose names clash with what operators use within; rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1]), "x", 1, None) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def copies(seed: int, n: int = 40) -> list[tuple]:
    """Documents that share passages, whole texts, near copies, runs of one word, and odd rows."""
    rng = random.Random(seed)
    passages = [prose(rng, k) for k in (49, 50, 51, 80, 120, 300)]
    rows = []
    for i in range(n):
        words = prose(rng, rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 10) if rng.random() < 0.5 else 0
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = p[a:]
        rows.append((i * 3 % n if n % 3 else i, rng.choice([" ", " ", "\n"]).join(words)))
    base = prose(rng, 260)
    for j in range(8):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{j}"
        rows.append((1000 + j, " ".join(w)))
    rows += [(2000 + j, " ".join(base)) for j in range(5)]
    rows += [(3000, "a " * 300), (3001, "a " * 170), (3002, "ab " * 200), (3003, "é x " * 130), (3004, "é x " * 90)]
    rows += [(None, " ".join(base)), (None, None), (4000, None), (4001, ""), (4002, " \n\t "), (1000, " ".join(base)), (2000, " ".join(base)), (7, " ".join(passages[4])), (4003, "x" * 900), (4004, "y" * 99 + "z"), (4005, "y" * 99 + "z")]
    return rows
