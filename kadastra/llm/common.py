"""What the training-data operators share: the work folder, written tables, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.operators.skew import shared_dir

#: What separates words, in the contracts' sense: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, runs its input once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: whole texts go to and from Python workers, and a default batch of 10,000 of them is held several times.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS for the session, unless it was given a size of its own. The setting counts when a query runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def sample_rate(n: int, bound: int) -> float:
    """Share of n rows that keeps about ``bound`` of them."""
    return 1.0 if n <= bound else bound / n


def by_hash(rate: float, *columns: str, salt: str = "") -> Column:
    """True for a fixed share of rows, chosen by a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))


def pick_ids(docs: DataFrame, ids: DataFrame, column: str, how: str, bound: int = 1_000_000) -> DataFrame:
    """Semi or anti join of documents with a table of ids: broadcast if there are ``bound`` ids at most, else shuffled."""
    ids = ids.select(F.col(column)).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= bound else ids, column, how)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
