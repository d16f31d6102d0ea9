"""A corpus from raw documents: language, near duplicates, benchmark passages, secrets, then the mix.

Each stage works on what the one before it kept and takes (spark, docs, sf_dir). All but the last return the
columns of documents. Rows are told apart by doc_id and text together, so rows that share a doc_id, or have none, are
each judged by their own text. A row with a null or empty text has no language and leaves in the first stage; texts of
any length are read whole; empty tables stay empty; an empty benchmark drops nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard, language, mixing, secrets
from millrace.llm.common import apart, small, table, written

#: A document is rejected when its language cannot be told, or when it has so many characters and its language differs
#: from its label with at least this score: short texts may be licence lines or addresses in no language of their own.
SURE, LEAST_CHARS = 0.95, 200
#: Most keys of some 30 bytes that are sent to the documents; beyond that the documents are shuffled to the keys.
KEYS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language and those whose text is surely in another one than their label says.

    A label that was not learned rejects nothing: its language may be what the text is in.
    """
    model = language.fit(docs.where(language.crc_mod3() != 1).select("doc_id", "text", "lang"))
    own, back = apart(docs, "lang_pred", "score")
    said = language.predicted(own, model)
    other = F.col("lang").isin(*model.languages) & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= SURE) & (F.length("text") >= LEAST_CHARS)
    kept = said.where((F.col("lang_pred") != language.UNKNOWN) & ~F.coalesce(other, F.lit(False)))
    return kept.select(*own.columns).withColumnsRenamed(back)


def picked(docs: DataFrame, keys: DataFrame, of_text: dict[str, Column], how: str) -> DataFrame:
    """docs semi- or anti-joined with a written table of keys: doc_id and what of_text makes of the text, nulls like others."""
    own, back = apart(docs, *(f"_{k}" for k in of_text))
    left, right = own.withColumns({f"_{k}": c for k, c in of_text.items()}).alias("l"), small(keys, KEYS).alias("r")
    same = reduce(Column.__and__, [F.col(f"l._{k}").eqNullSafe(F.col(f"r.{k}")) for k in of_text], F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")))
    return left.join(right, same, how).select(*own.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, that with the least doc_id; of rows that repeat it, one."""
    key, of_text = ["doc_id", "text_key"], {"text_key": jaccard.text_key()}
    found = written(jaccard.near_duplicates(docs).select(*key, "class_key", "stays"), "near")
    copies = written(found.where(~F.col("stays")).select(*key).distinct(), "copies")
    kept = picked(docs, copies, of_text, "left_anti")
    repeated = written(found.where(F.col("stays") & F.col("class_key").isNotNull()).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    own, back = apart(picked(kept, repeated, of_text, "left_semi"), "_text_key")
    once = own.withColumn("_text_key", jaccard.text_key()).dropDuplicates(["doc_id", "_text_key"]).select(*own.columns).withColumnsRenamed(back)
    return picked(kept, repeated, of_text, "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    of_text = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    rows = docs.select(F.struct("doc_id", *[c.alias(k) for k, c in of_text.items()]).alias("doc_id"), "text")
    found = decontamination.contamination(rows, table(spark, sf_dir, "benchmark"))
    hit = written(found.where("contaminated").select("doc_id.*").distinct(), "hit")
    return picked(docs, hit, of_text, "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a secret."""
    return secrets.without_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents for the target mix; copies says how many times each is to be read."""
    return mixing.sampled(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("source_mix", source_mix)]

#: Suffix automata, chosen paths and anchored scans are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
