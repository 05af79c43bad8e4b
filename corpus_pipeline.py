"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of docs;
where a text changes, n_chars follows it.

Defined results: a null, empty or white text, as one of under 50 words, is rejected by the first stage; a null doc_id is kept and stays null (of a
group of near copies the least doc_id stays, a null one only if there is no other); repeated rows are one group, of which one stays; texts are
worked on whole, whatever their length; a source that is null is a source of its own; other columns, whatever their names, are kept by all
stages but the last; an empty table, or a benchmark without items, gives empty results without error, or no rejections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsuzuri.llm import bpe, common, decontam, near, pii, quality
from tsuzuri.llm.queries import tokenizer_files


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", n)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines that too many texts of their source share. Exact copies count once, as the next stage sees to them."""
    return _counted(quality.filtered(docs, "source", by="texts"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (by five-word shingles at a Jaccard similarity of 0.8, or by SimHash): that of the least doc_id."""
    return near.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _counted(pii.redacted(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes."""
    return bpe.digests(docs, *tokenizer_files())


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("personal data", personal_data), ("byte-level BPE", encoding)]

#: Fingerprint links, tiling and merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
