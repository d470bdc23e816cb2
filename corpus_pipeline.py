"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Each stage's result is written as Parquet and read again as the next one's documents. All but the last return the
columns of documents. The package's modules are imported as they are: an import error shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import new_folder, stored, table
from lacuna.llm.decontamination import contamination, small
from lacuna.llm.jaccard_join import near_duplicates
from lacuna.llm.packing import pack_documents
from lacuna.llm.queries import tokenizer_file
from lacuna.llm.secrets import train_field, without_secrets
from lacuna.llm.toxicity import toxicity_score, train


KEY = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of doc_id and text, so that rows without an id, or with another's, are told apart."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def _without(keyed: DataFrame, keys: DataFrame, label: str) -> DataFrame:
    """The keyed docs without the rows whose key is in keys (doc_id, as the operators name what they were given)."""
    gone = small(stored(keys.select(F.col("doc_id").alias(KEY)).distinct(), label))
    return keyed.join(gone, KEY, "left_anti").drop(KEY)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored 0.5 or more go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(F.col("text"), model) < 0.5)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest doc_id stays, once; one without an id only if none has any."""
    keyed = _keyed(docs)
    found = near_duplicates(keyed, id_col=KEY).select("doc_id", "component_id").distinct()
    ids = keyed.select(F.col(KEY).alias("doc_id"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(KEY).alias("key")).alias("rank")).distinct()
    found = stored(found.join(ids, "doc_id"), "near-components")
    first = small(stored(found.groupBy("component_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", "first.key"), "near-first"))
    return _without(keyed, found.join(first, "component_id").where("doc_id <> key"), "near-duplicates").select(docs.columns).dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    keyed = _keyed(docs)
    hit = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY).where("contaminated")
    return _without(keyed, hit, "contaminated").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars is that of the new text. All documents stay."""
    cleaned = docs.withColumn("text", without_secrets(F.col("text"), train_field(docs)))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 1024)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Trained models and tokenizers can't be said in SQL; the tests hold near_duplicates and decontamination against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
