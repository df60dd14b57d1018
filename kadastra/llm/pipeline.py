"""A corpus pipeline of five stages: toxicity, near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm import decontamination, mixing, near_copies, sharding, toxicity
from kadastra.llm.common import free_name, materialize, pick_ids, small_batches, table

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, scores below its threshold.

    Rows without an id or a text, and repeated ones, are judged by their text like any other; without labels of both kinds
    all get the labels' majority (without any label 0.5, and go). An empty table gives an empty one."""
    small_batches(spark)
    into = free_name(docs, "toxicity_of_stage")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(toxicity.remainder(F.col("doc_id"), 4) != 2))
    return toxicity.score(docs, model, into=into).where(F.col(into) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more): the one with the smallest id.

    Candidates are the components of operator 9 (SimHash) and what MinHash bands add to them; an exact check decides.
    Rows are told apart by their values, not by id: rows without an id, or with one id and different texts, stay."""
    small_batches(spark)
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Texts are told apart by their hash, so rows need no id and repeated rows go
    or stay together; null and empty texts stay, and without benchmark or documents nothing changes."""
    small_batches(spark)
    key = free_name(docs, "key_of_stage")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    hits = decontamination.contaminated(keyed, table(spark, sf_dir, "benchmark"), row_id=key)
    hits = materialize(hits.select(key).distinct(), "contaminated")
    return pick_ids(keyed, hits, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows equal in all columns (none are left by the near-dedup before) all as
    often as the one taken most. Rows are told apart by a hash of their values, so they need no id; texts without words are
    never taken; an empty table gives an empty one."""
    key, copies, copy = (free_name(docs, c) for c in ("key_of_stage", "copies_of_stage", "copy_of_stage"))
    keyed = docs.withColumn(key, near_copies.row_key(docs)[0])
    taken = mixing.mix(keyed, row_id=key).where("copies > 0").groupBy(key).agg(F.max("copies").alias(copies))
    return keyed.join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, text_crc32, shard and slot; columns of documents with one of these names are left out."""
    own = {"doc_id", "size", "text_crc32", "shard", "slot"}
    return sharding.shard(docs, SHARDS, keep=tuple(c for c in docs.columns if c.lower() not in own))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Models, fingerprints and sampling are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
