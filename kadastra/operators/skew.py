"""Joins in which a few keys may hold most rows, and the folder in which lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups holding more than one in this many rows count as hot; so there are fewer hot groups than this.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with their groups, where a few groups may hold most rows.

    ``groups`` has one row per non-null key and in ``size`` the number of its rows. Groups with over 1/HOT_SHARE
    of all rows number under HOT_SHARE, so these are broadcast; all others meet in a shuffled join in which
    no key has more than that share.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    hot = groups.where(is_hot)
    cold = groups.where(~is_hot)
    in_hot = rows.join(F.broadcast(hot), key)
    in_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return in_hot.unionByName(in_cold)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Without one, a session on one machine
    gets a folder of its own; on a cluster that would be one folder per machine, so it has to be set there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found
