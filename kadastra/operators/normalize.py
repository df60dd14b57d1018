"""Raw offers to normalised listings: one select of expressions after the filters that drop what is no offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadastra import constants as C
from kadastra.functions import dates, numbers, once, phones, text
from kadastra.operators import locate

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
RAW = T.StructType(
    [T.StructField(n, _S) for n in ("source_key", "external_id", "url", "title", "description", "kind", "transaction", "property_type", "seller_type", "city", "district", "street", "commune", "county", "voivodeship", "location_text", "market", "building_type", "seller_name", "contact_email", "case_number", "authority", "share", "currency")]
    + [T.StructField(n, _D) for n in ("price", "area", "plot_area", "lat", "lon", "opening_price", "estimate_value", "deposit")]
    + [T.StructField(n, _I) for n in ("rooms", "floor", "floors_total", "year_built")]
    + [T.StructField(n, T.ArrayType(_S)) for n in ("phones_raw", "images")]
    + [T.StructField(n, T.TimestampNTZType()) for n in ("published_at", "event_date", "deadline")]
)


def pick(*values: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*(F.nullif(v, F.lit(0).cast("double")) for v in values))


def normalize(raw: DataFrame, now: Column, key: str = "kadastra", regions: list[str] | None = None, units: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """Listings of raw offers (columns of RAW).

    Dropped are rows without title or URL, requests and services among ordinary offers, navigation, and, with
    ``regions``, offers outside. With ``units`` (and ``boxes`` of regions) the location is settled first (locate.py). Parameters that a portal did not give are read from title and description; implausible
    prices and areas are emptied; titles that tell of a lease or rent overrule the portal's category.
    """
    c = F.col
    title, body = text.clean(text.unescape(c("title"))), text.strip_html(c("description"))
    rows = raw.withColumn("title", title).withColumn("description", body)
    rows = rows.where((F.length("title") > 0) & (F.length(F.coalesce("url", F.lit(""))) > 0) & ~c("title").rlike(C.NAVIGATION))
    rows = rows.where(~((F.coalesce("kind", F.lit("nieruchomosc")) == "nieruchomosc") & c("title").rlike(C.NOISE)))
    if units is not None:
        rows = locate.where_it_lies(rows, units, boxes)
    if regions:
        rows = rows.where(c("voivodeship").isNull() | c("voivodeship").isin(*regions))
    both = lambda n: F.concat_ws(" ", "title", F.substring("description", 1, n))
    kind = F.when(c("property_type").isNotNull() & (c("property_type") != "inne"), c("property_type")).otherwise(text.property_type(both(800)))
    rows = rows.withColumn("kind", F.coalesce("kind", F.lit("nieruchomosc"))).withColumn("property_type", kind)
    land = c("property_type").isin(*C.LAND_TYPES)
    fits = lambda v: F.when(numbers.plausible_area(v, c("property_type")), v)
    size = F.coalesce(once(pick(c("area"), numbers.area(both(1500))), fits), once(numbers.area(c("title")), fits))
    plot = once(pick(c("plot_area"), numbers.plot_area(both(2500))), lambda v: F.when(v.between(1, 20_000_000), v))
    rows = rows.withColumn("area", size).withColumn("plot_area", plot)
    rows = rows.withColumn("area", F.when(land & c("plot_area").isNotNull(), F.greatest("area", "plot_area")).otherwise(c("area"))).withColumn("plot_area", F.when(land & c("area").isNotNull(), c("area")).otherwise(c("plot_area")))
    price = F.when(numbers.plausible_price(c("price")), c("price"))
    price = F.when(c("kind") == "licytacja", pick(price, c("opening_price"))).otherwise(price)
    cheap = (price < C.MIN_SALE_PRICE) & c("property_type").isin("mieszkanie", "dom", "pokoj")
    said = F.when(c("title").rlike(C.LEASE_IN_TITLE), "dzierzawa").when(c("title").rlike(C.RENT_IN_TITLE), "wynajem").when((F.coalesce("transaction", F.lit("sprzedaz")) == "sprzedaz") & cheap & (c("kind") == "nieruchomosc"), "wynajem").otherwise(F.coalesce("transaction", text.transaction(c("title"))))
    level, total = numbers.floor(both(1500))
    market = F.when(both(3000).rlike(C.PRIMARY_MARKET), "pierwotny").when(both(3000).rlike(C.SECONDARY_MARKET), "wtorny")
    rows = rows.withColumns(
        {
            "price": price,
            "transaction": said,
            "rooms": F.coalesce("rooms", numbers.rooms(both(1500))),
            "floor": F.coalesce("floor", level),
            "floors_total": F.coalesce("floors_total", total),
            "year_built": F.coalesce("year_built", numbers.year(both(3000))),
            "case_number": F.coalesce("case_number", numbers.case_number(both(3000))),
            "market": F.coalesce(text.fold(c("market")), market),
            "published_at": dates.not_in_future(c("published_at"), now),
            "images": F.slice(F.filter(F.coalesce("images", F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, 12),
            "geo_precision": F.when((c("lat") != 0) & (c("lon") != 0), "portal"),
            "parcels": numbers.parcel_numbers(both(3000)),
            "seller_type": text.seller_type(c("seller_type"), c("kind"), c("seller_name"), c("authority"), c("title"), c("description")),
            "phones": phones.phones(F.concat_ws(" ; ", F.array_join(F.coalesce("phones_raw", F.array().cast("array<string>")), " ; "), "title", "description"), key),
        }
    )
    return rows.withColumn("price_per_m2", numbers.price_per_m2(c("price"), c("area"))).withColumn("phone_fingerprint", phones.fingerprint(c("phones")))
