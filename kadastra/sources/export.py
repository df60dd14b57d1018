"""Exports: masked CSV and JSON, sitemaps, registry files."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.functions.phones import masked


def public(df: DataFrame) -> DataFrame:
    """Columns that may be shown, phones masked."""
    hidden = {"raw", "extra", "contact_email", "phone_fingerprint", "phones"}
    return df.select(*((masked(F.col(c)).alias(c) if c == "phone" else F.col(c)) for c in df.columns if c not in hidden))


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    rows = public(df)
    if kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def sitemap(df: DataFrame, base: str) -> DataFrame:
    """One URL element per listing."""
    return df.select("id", F.concat(F.lit("<url><loc>"), F.lit(base.rstrip("/")), F.lit("/oferta/"), F.col("id").cast("string"), F.lit("</loc><lastmod>"), F.date_format("listed_at", "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("xml"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a YAML file: key, name, scraper, enabled; defaults fill what a source leaves out."""
    told = yaml.safe_load(Path(path).read_text()) or {}
    defaults = told.get("defaults") or {}
    rows = [{**defaults, **s} for s in told.get("sources") or []]
    return spark.createDataFrame([(s["key"], s.get("name"), s.get("scraper", "generic"), bool(s.get("enabled", True))) for s in rows], "key string, name string, scraper string, enabled boolean")


def sync_registry(known: DataFrame, file: DataFrame) -> DataFrame:
    """The registry after a file: its rows win, rows that it lacks stay but are disabled."""
    f = file.select("key", *(F.col(c).alias(f"f_{c}") for c in ("name", "scraper", "enabled")))
    joined = known.join(f, "key", "full_outer")
    return joined.select("key", F.coalesce("f_name", "name").alias("name"), F.coalesce("f_scraper", "scraper").alias("scraper"), F.coalesce("f_enabled", F.lit(False)).alias("enabled"))
