"""The thin queries over these operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C


def tokenizer_files() -> tuple[str, str]:
    """Rank file and pre-token pattern of the multilingual byte-level vocabulary."""
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def op1_pii_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.detect(C.documents(spark, sf_dir))


def op2_secret_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.detect(C.documents(spark, sf_dir), *tokenizer_files())


def op3_quality_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(C.documents(spark, sf_dir))


def op4_bpe_rank_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(C.documents(spark, sf_dir), *tokenizer_files())


def op5_shard_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(C.documents(spark, sf_dir), 40)


def op6_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.matches(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_copies(C.documents(spark, sf_dir), 4, 4)


def op8_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import debruijn

    return debruijn.dedup(C.documents(spark, sf_dir))


def op9_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pst

    return pst.scored(C.documents(spark, sf_dir))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_array

    return suffix_array.dedup(C.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_skip_chain_crf, op2_secret_token_efficiency, op3_quality_line_frequency, op4_bpe_rank_bitmap, op5_shard_feistel, op6_greedy_string_tiling, op7_simhash_pigeonhole, op8_de_bruijn_dedup, op9_suffix_tree_scores, op10_suffix_array_dedup)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Lower case stands for case folding, whole lines for their hashes.
_OP3 = f"""
WITH d AS (SELECT doc_id, source, text, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g JOIN again USING (doc_id, gram), range(3) t(j) GROUP BY doc_id),
l AS (SELECT doc_id, source, line, {_WORDS.format("line")} AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, source, line, len(lw) AS size, lower(array_to_string(lw, ' ')) AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n GROUP BY doc_id),
often AS (SELECT source, norm FROM n JOIN (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source) h USING (source) GROUP BY source, norm, docs HAVING count(DISTINCT doc_id) >= 20 OR count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) > 0.2 * docs),
gone AS (SELECT doc_id, count(DISTINCT norm) AS lines, sum(size) AS words FROM n JOIN often USING (source, norm) GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.lines, 0)::BIGINT AS n_removed_lines, coalesce(gone.words, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM b
"""

_OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS lo FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN m USING (h), range(50) t(j) WHERE doc_id > lo),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n FROM x ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Fingerprints, merges, suffix arrays, models and permutations are beyond SQL; tests hold those queries against brute force."""
    return {"op3_quality_line_frequency": _OP3, "op8_de_bruijn_dedup": _OP8}
