"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and read again. All but the last return the columns of documents. Columns beside doc_id, text, lang and n_chars are
carried along, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import secrets
from tidemark.llm.base import forget, free_name, saved
from tidemark.llm.decontaminate import leaks
from tidemark.llm.language import identify
from tidemark.llm.neardup import near_duplicates, text_digest
from tidemark.llm.packing import pack
from tidemark.llm.queries import table, vocabulary

#: Up to so many keys (about 16 MB) are broadcast; beyond, an anti join shuffles.
BROADCAST_KEYS = 200_000


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the digest of each row's id and text, which null ids have too, and its name."""
    name = free_name(docs, "_key")
    return docs.withColumn(name, F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), text_digest("text")), 256))), name


def without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """docs less the rows whose column `name` is in keys."""
    keys = saved(keys.select(name).distinct(), "gone")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, name, "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is rejected go, as do null, empty and letterless texts. Rows of one id are judged each by its
    text; repeated rows go or stay together."""
    rows, key = keyed(docs)
    return without(rows, identify(rows, carry=(key,)).filter("rejected"), key).select(docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8 or more) the text of the smallest id stays, of several of
    that id the one of the smallest digest, of rows that repeat id and text one. Null and empty texts are like nothing and
    stay; so do rows of null id."""
    groups = saved(near_duplicates(docs, percent=80, by_text=True), "groups")
    gone = groups.filter("not stays")
    if groups.filter("digest is not null").isEmpty():  # each id has one row
        kept = without(docs, gone, "doc_id")
        forget(groups)
        return kept
    rows, key = keyed(docs)
    kept = without(rows, keyed_groups(gone).withColumnRenamed("_key", key), key)
    copies = keyed_groups(groups.filter("stays and doc_id is not null")).groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = saved(copies.select(F.col("_key").alias(key)), "copies")
    if not copies.isEmpty():
        once = kept.join(copies, key, "left_semi").dropDuplicates([key])
        kept = kept.join(copies, key, "left_anti").unionByName(once)
    return kept.select(docs.columns)


def keyed_groups(groups: DataFrame) -> DataFrame:
    """The keys of `keyed` of rows of near_duplicates."""
    return groups.select(F.unhex(F.sha2(F.concat(F.col("doc_id").cast("string").cast("binary"), F.col("digest")), 256)).alias("_key"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go, those of null id too. Null and empty texts stay, as do other texts of an id
    that leaks; an empty benchmark takes nothing."""
    number = free_name(docs, "_number")
    rows = docs.withColumn(number, F.xxhash64("doc_id", "text"))
    found = leaks(rows, table(spark, sf_dir, "benchmark"), id_col=number).select(F.col("doc_id").alias(number))
    return without(rows, found, number).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kinds and n_chars follows; all rows stay, null texts as they are."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences; null and empty texts are an end mark alone, repeated rows are packed as often as they stand."""
    return pack(docs, vocabulary())


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", neardup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: The stages train models and search approximately, which SQL does not express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        if k:
            forget(before)
    return docs
