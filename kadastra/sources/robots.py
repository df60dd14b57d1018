"""robots.txt rules as a table, and URLs judged by them: the longest matching pattern decides, Allow wins ties."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "host string, agent string, allow boolean, pattern string, regex string, length int, delay double"


def pattern_regex(pattern: str) -> str:
    """A robots pattern as an anchored Java regex; * is anything, a final $ the end."""
    end = pattern.endswith("$")
    body = unquote(pattern[:-1] if end else pattern)
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + ("$" if end else "")


def parse(host: str, body: str) -> list[tuple]:
    """Rows of RULES of one file; rules of agents named together belong to each."""
    rows, agents, in_rules = [], [], False
    for line in body.splitlines():
        name, _, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            agents, in_rules = ([value.lower()] if in_rules else [*agents, value.lower()]), False
        elif name in ("allow", "disallow"):
            in_rules = True
            if value:
                rows += [(host, a, name == "allow", value, pattern_regex(value), len(value), None) for a in agents]
        elif name == "crawl-delay":
            in_rules = True
            try:
                rows += [(host, a, True, "", "(?!)", -1, float(value)) for a in agents]
            except ValueError:
                continue
    return rows


def rules(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([r for host, body in files.items() for r in parse(host, body)], RULES)


def for_agent(table: DataFrame, agent: str) -> DataFrame:
    """Each host's rules for an agent: those of its most exact group, else those for all."""
    own = table.where(F.lit(agent.lower()).contains(F.col("agent")) & (F.col("agent") != "*"))
    best = own.groupBy("host").agg(F.max(F.struct(F.length("agent").alias("n"), "agent")).alias("b")).select("host", F.col("b.agent").alias("chosen"))
    joined = table.join(best, "host", "left")
    return joined.where(F.col("agent") == F.coalesce("chosen", F.lit("*"))).drop("chosen")


def target(url: Column) -> Column:
    """Decoded path and query of a URL."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.try_url_decode(F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))), F.lit("/"))


def judge(urls: DataFrame, table: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """URLs with ``allowed``. Rules meet URLs by host; of those that match the longest decides."""
    asked = urls.withColumn("host", F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)))
    own = for_agent(table, agent).where("length >= 0").select("host", "allow", "regex", "length")
    each = own.groupBy("host").agg(F.collect_list(F.struct("length", "allow", "regex")).alias("rules"))
    joined = asked.join(each, "host", "left").withColumn("target", target(F.col(url)))
    hit = F.filter("rules", lambda r: F.regexp(F.col("target"), r["regex"]))
    best = F.array_max(F.transform(hit, lambda r: F.struct(r["length"], r["allow"])))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules", "target")


def delays(table: DataFrame, agent: str = "*") -> DataFrame:
    return for_agent(table, agent).where("delay is not null").groupBy("host").agg(F.max("delay").alias("delay"))
