"""A corpus pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Every stage works on all rows that the one before kept. All but the last return
the columns of documents; null, empty and very long texts, repeated rows and
empty tables pass through as each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentloom.llm import decontam, langid, mixing, ngramjoin, secrets
from contentloom.llm.common import checkpoint, small, stage_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose letters half at least are of known languages, one or several.

    Texts that are null, empty or without a letter go; a null id, lang or source
    or a repeated row changes nothing. An empty table gives an empty one.
    """
    return langid.accepted(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram links tie together the document with the smallest id.

    Repeated rows of one id count as copies, of which one stays; documents
    without a shingle or an id are in no group and stay.
    """
    docs = docs.select(*COLUMNS)
    groups = checkpoint(ngramjoin.ngram_join(docs))
    gone = checkpoint(groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)
    again = checkpoint(groups.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, whatever their other columns say;
    repeated rows are judged each for itself, texts of any length as a whole.
    With no documents or no items the documents come back as they are.
    """
    return decontam.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by [SECRET] and n_chars counted anew.

    A null text stays null and keeps its n_chars; an empty one has 0. Repeated
    rows and null ids stay; texts of any length are scanned as a whole.
    """
    clean = docs.select("doc_id", secrets.redacted(F.col("text")).alias("text"), "lang", "source", "n_chars")
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes.

    A null or empty text has size 0 and gives nothing; a null source is a source
    of its own, the last; a null id has no label and weighs 1. Repeated rows take
    part each; an empty table gives an empty mix.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
]

#: Language identification, fingerprints and redaction have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = stage_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
