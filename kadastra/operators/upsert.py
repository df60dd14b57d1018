"""State changes as joins: upsert with null-preserving merge, price history, missing and concluded offers, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import dates
from kadastra.operators.hashing import row_hash

KEY = ("source_key", "external_id")
ADDRESS = ("voivodeship", "county", "city", "district", "street")
POINT = ("lat", "lon", "geo_precision")
#: Columns that a batch never overwrites, or that are merged by rules of their own.
OWN = {*KEY, *POINT, "id", "first_seen", "last_seen", "initial_price", "status", "extra", "raw", "cleared"}


def latest_per_key(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row per key of a batch: the last by ``order``; of equally late ones that with the largest hash of its values, so
    that a replay takes the same."""
    w = Window.partitionBy(*KEY).orderBy(*([F.col(order).desc_nulls_last()] if order else []), F.desc(row_hash(batch)))
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(current: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Current listings after a batch, with ``change`` (new, updated, unchanged, kept).

    A null or empty value of the batch does not overwrite, unless the row names the column in ``cleared``. A changed
    address voids the point unless it came from the portal or the batch brings one. Offers seen again become active
    unless concluded. One full outer join on the key; both sides are hashed by it.
    """
    b = batch.select(*(F.col(c).alias(f"b_{c}") for c in batch.columns))
    joined = current.join(b, [F.col(k) == F.col(f"b_{k}") for k in KEY], "full_outer")
    here, there = F.col(KEY[1]).isNotNull(), F.col(f"b_{KEY[1]}").isNotNull()
    is_new, both = there & ~here, here & there
    cleared = F.coalesce("b_cleared", F.array().cast("array<string>")) if "cleared" in batch.columns else F.array().cast("array<string>")

    def merged(c: str) -> Column:
        if f"b_{c}" not in b.columns:
            return F.col(c)
        value = F.col(f"b_{c}")
        if dict(batch.dtypes)[c] == "string":
            value = F.nullif(value, F.lit(""))
        kept = F.coalesce(value, F.col(c))
        return F.when(both & F.array_contains(cleared, c), F.col(f"b_{c}")).otherwise(kept)

    columns = {c: merged(c) for c in current.columns if c not in OWN}
    out = {k: F.coalesce(k, f"b_{k}") for k in KEY}
    out |= columns
    moved = F.lit(False)
    for c in ADDRESS:
        if c in columns:
            moved = moved | ~columns[c].eqNullSafe(F.col(c))
    if {"lat", "lon"} <= set(current.columns):
        brings = F.col("b_lat").isNotNull() & F.col("b_lon").isNotNull() if {"b_lat", "b_lon"} <= set(b.columns) else F.lit(False)
        void = both & moved & (~F.col("geo_precision").eqNullSafe("portal") | brings)
        for c in POINT:
            if c in current.columns:
                given = F.col(f"b_{c}") if f"b_{c}" in b.columns else F.lit(None)
                out[c] = F.when(void, given).otherwise(F.coalesce(given, F.col(c)) if c != "geo_precision" else F.coalesce(F.when(brings, given), F.col(c), given))
    if "id" in current.columns:
        out["id"] = F.coalesce("id", F.xxhash64(*(f"b_{k}" for k in KEY)))
    out["first_seen"] = F.coalesce("first_seen", now)
    out["last_seen"] = F.when(there, now).otherwise(F.col("last_seen"))
    out["initial_price"] = F.when(is_new, F.col("b_price")).otherwise(F.coalesce("initial_price", "price"))
    over = dates.concluded(F.coalesce("b_kind", "kind"), out.get("event_date", F.col("event_date")), F.lit(None).cast("timestamp"), dates.to_warsaw(now).cast("timestamp")) if "event_date" in current.columns else F.lit(False)
    out["status"] = F.when(there & ~over, "aktywna").when(there & over, "nieaktywna").otherwise(F.col("status"))
    if "extra" in current.columns and "b_extra" in b.columns:
        empty = F.create_map().cast("map<string,string>")
        out["extra"] = F.map_from_entries(F.map_entries(F.map_concat(F.map_filter(F.coalesce("extra", empty), lambda k, v: ~F.map_contains_key(F.coalesce("b_extra", empty), k)), F.coalesce("b_extra", empty))))
    changed = F.lit(False)
    for c, value in columns.items():
        changed = changed | ~value.eqNullSafe(F.col(c))
    out["change"] = F.when(is_new, "new").when(~there, "kept").when(changed, "updated").otherwise("unchanged")
    order = [c for c in current.columns if c in out]
    return joined.select(*(out[c].alias(c) for c in order), out["change"].alias("change"), F.col("price").alias("price_before"))


def price_changes(merged: DataFrame, now: Column) -> DataFrame:
    """Rows for the price history: new listings, and prices that moved by more than PRICE_CHANGE."""
    moved = (F.col("price_before") != 0) & (F.col("price") != 0) & (F.abs(F.col("price") - F.col("price_before")) > C.PRICE_CHANGE)
    return merged.where(((F.col("change") == "new") & F.col("price").isNotNull()) | F.coalesce(moved, F.lit(False))).select(*KEY, "price", now.alias("seen_at"))


def price_history(observations: DataFrame, key: str, order: list[str], price: str = "price") -> DataFrame:
    """Of all observations those that differ from the one before by more than PRICE_CHANGE, with delta_pct."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = observations.withColumn("previous", F.lag(price).over(w))
    moved = rows.where(F.col("previous").isNull() | (F.abs(F.col(price) - F.col("previous")) > C.PRICE_CHANGE))
    return moved.withColumn("delta_pct", F.when(F.col("previous") > 0, F.round((F.col(price) - F.col("previous")) / F.col("previous") * 100, 2)))


def mark_missing(df: DataFrame, now: Column, sources: list[str], most: int = C.MISSING_LIMIT) -> DataFrame:
    """Active listings of completely scanned sources, not seen for MISSING_DAYS, become inactive: the longest unseen, ``most`` per source."""
    gone = F.col("source_key").isin(*sources) & (F.col("status") == "aktywna") & (F.col("last_seen") < now - F.expr(f"interval {C.MISSING_DAYS} days"))
    w = Window.partitionBy("source_key").orderBy("last_seen", "id")
    chosen = df.where(gone).select("id", "source_key", "last_seen").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("id", F.lit(True).alias("gone"))
    return df.join(chosen, "id", "left").withColumn("status", F.when(F.col("gone"), "nieaktywna").otherwise(F.col("status"))).drop("gone")


def mark_concluded(df: DataFrame, now: Column, deadline: str | None = None) -> DataFrame:
    over = dates.concluded(F.col("kind"), F.col("event_date"), F.col(deadline) if deadline else F.lit(None).cast("timestamp"), dates.to_warsaw(now).cast("timestamp"))
    return df.withColumn("status", F.when(over & (F.col("status") == "aktywna"), "nieaktywna").otherwise(F.col("status")))


def sync_phones(known: DataFrame, found: DataFrame) -> DataFrame:
    """Phones after a scan: rows whose hash a listing does not have yet are added."""
    return known.unionByName(found.join(known, ["listing_id", "hashed"], "left_anti"), allowMissingColumns=True)


def delete(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Listings without those in ``gone``; copies of a deleted original become originals."""
    ids = gone.select("id")
    left = df.join(ids, "id", "left_anti")
    lost = ids.select(F.col("id").alias("duplicate_of_id"), F.lit(True).alias("lost"))
    freed = left.join(lost, "duplicate_of_id", "left")
    link = F.when(F.col("lost"), None).otherwise(F.col("duplicate_of_id"))
    return freed.select(*((link.alias(c) if c == "duplicate_of_id" else (F.col(c) | F.coalesce("lost", F.lit(False))).alias(c) if c == "is_original" else F.col(c)) for c in df.columns))


def detach(child: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows of a child table (links, favourites, phones) without those of deleted listings."""
    return child.join(gone.select(F.col("id").alias(column)), column, "left_anti")


def expired(df: DataFrame, now: Column, days: int = C.RETENTION_DAYS) -> DataFrame:
    return df.where((F.col("status") != "aktywna") & (F.col("last_seen") < now - F.make_dt_interval(F.lit(days))))


def fill_empty(df: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Details fill only what is empty."""
    d = details.select(F.col(key), *(F.col(c).alias(f"d_{c}") for c in details.columns if c != key))
    return df.join(d, key, "left").select(*((F.coalesce(c, f"d_{c}").alias(c) if f"d_{c}" in d.columns else F.col(c)) for c in df.columns))


def archive(df: DataFrame, now: Column, days: int = C.RETENTION_DAYS) -> DataFrame:
    """Inactive offers that were last seen before the retention time are archived."""
    old = (F.col("status") == "nieaktywna") & (F.col("last_seen") < now - F.make_dt_interval(F.lit(days)))
    return df.withColumn("status", F.when(F.coalesce(old, F.lit(False)), "archiwalna").otherwise(F.col("status")))
