"""The listing tables over the given star schema, and the same projections as DuckDB SQL.

The expressions are in the dialect that Spark and DuckDB share, so that there is one text for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of all registered queries.
NOW = "2001-08-01 12:00:00"

LISTING = {
    "id": "o_orderkey",
    "source_key": "'src' || cast(o_orderkey % 6 as string)",
    "kind": "case when o_orderkey % 20 = 0 then 'licytacja' when o_orderkey % 20 = 1 then 'przetarg' when o_orderkey % 20 = 2 then 'wykaz' else 'nieruchomosc' end",
    "price": "o_totalprice",
    "initial_price": "case when o_orderkey % 5 = 0 then o_totalprice * 1.08 end",
    "area": "area",
    "rooms": "rooms",
    "floor": "case when o_orderkey % 7 <> 0 then o_orderkey % 11 end",
    "price_per_m2": "floor(o_totalprice / area * 100 + 0.5) / 100",
    "property_type": "case c_mktsegment when 'BUILDING' then 'mieszkanie' when 'FURNITURE' then 'dom' when 'HOUSEHOLD' then 'lokal' when 'AUTOMOBILE' then 'garaz' else 'hala' end",
    "transaction": "case when o_orderkey % 4 = 0 then 'wynajem' else 'sprzedaz' end",
    "status": "case o_orderstatus when 'O' then 'aktywna' when 'F' then 'nieaktywna' else 'archiwalna' end",
    "voivodeship": "r_name",
    "county": "n_name",
    "city": "n_name || '-' || cast(o_custkey % 8 as string)",
    "district": "case when o_orderkey % 3 = 0 then 'Śródmieście' when o_orderkey % 3 = 1 then 'Łęg' end",
    "street": "case o_orderkey % 6 when 0 then 'ul. Łódzka 12' when 1 then 'al. Jana Pawła II' when 2 then 'Ozimskiej' when 3 then 'Czesława Miłosza, Kleczków' when 4 then 'os. Piastowska 3/5' end",
    "title": "'Oferta ' || c_mktsegment || ' ' || n_name || ', ' || cast(rooms as string) || ' pokoje'",
    "listed_at": "o_orderdate",
    "first_seen": "o_orderdate + interval '2' day",
    "event_date": "case when o_orderkey % 20 < 2 then o_orderdate + interval '40' day end",
    "seller_type": "case o_orderpriority when '1-URGENT' then 'prywatna' when '2-HIGH' then 'posrednik' when '3-MEDIUM' then 'deweloper' when '4-NOT SPECIFIED' then 'nieznany' else 'urzad' end",
    "agency_id": "agency_id",
    "is_original": "o_orderkey % 8 <> 3",
    "duplicate_of_id": "case when o_orderkey % 8 = 3 then o_orderkey - 3 end",
    "lat": "cast(49 + (o_custkey % 600) / 100.0 as double)",
    "lon": "cast(14 + (o_orderkey % 1000) / 100.0 as double)",
    "geo_precision": "case o_orderkey % 3 when 0 then 'city' when 1 then 'street' else 'address' end",
    "phone": "case when o_orderkey % 4 <> 1 then cast(500000000 + (o_custkey * 7919) % 99999999 as string) end",
}

_AREAS = "select l_orderkey, sum(l_quantity) as area, count(*) as rooms, min(l_suppkey) as agency_id from lineitem group by l_orderkey"

LISTINGS_SQL = f"""listings as (
select {", ".join(f"{v} as {k}" for k, v in LISTING.items())}
from orders left join ({_AREAS}) a on l_orderkey = o_orderkey
join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings fact. Town, county and region come from small dimensions, which Spark broadcasts by their size."""
    read = lambda name: table(spark, sf_dir, name)
    areas = read("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area"), F.count("*").alias("rooms"), F.min("l_suppkey").alias("agency_id"))
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = read("orders").join(areas, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(*(F.expr(v).alias(k) for k, v in LISTING.items()))


def price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price series per listing: events of a user in time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("listing_id"), "ts", F.col("value").alias("price"), "event_id")
