"""Search over listings: one filter object becomes one predicate; sorting, paging, map, phone lookup."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import dates, text

# Sort keys and what they sort by.
SORTS = {
    "najnowsze": ("listed_at", "desc"),
    "najstarsze": ("listed_at", "asc"),
    "cena_rosnaco": ("price", "asc"),
    "cena_malejaco": ("price", "desc"),
    "cena_m2_rosnaco": ("price_per_m2", "asc"),
    "cena_m2_malejaco": ("price_per_m2", "desc"),
    "powierzchnia": ("area", "desc"),
    "powierzchnia_rosnaco": ("area", "asc"),
    "dzialka": ("plot_area", "desc"),
    "okazje": ("deal_ratio", "asc"),
    "najdluzej_wisi": ("listed_at", "asc"),
    "najwiecej_kopii": ("copies_count", "desc"),
    "termin_licytacji": ("event_date", "asc"),
}
RANGES = {"price": "price", "price_m2": "price_per_m2", "area": "area", "plot_area": "plot_area", "rooms": "rooms", "floor": "floor"}


@dataclass(frozen=True)
class Filters:
    """What a search asks for; None and empty values ask for nothing."""

    kind: str | None = None
    property_type: str | None = None
    transaction: str | None = None
    seller_type: str | None = None
    city: str | None = None
    district: str | None = None
    county: str | None = None
    voivodeship: str | None = None
    street: str | None = None
    source: tuple[str, ...] = ()
    agency_id: int | None = None
    market: str | None = None
    price_min: float | None = None
    price_max: float | None = None
    price_m2_min: float | None = None
    price_m2_max: float | None = None
    area_min: float | None = None
    area_max: float | None = None
    plot_area_min: float | None = None
    plot_area_max: float | None = None
    rooms_min: int | None = None
    rooms_max: int | None = None
    floor_min: int | None = None
    floor_max: int | None = None
    year_min: int | None = None
    only_original: bool = True
    only_active: bool = True
    with_phone: bool = False
    period: str | None = None
    days_on_market_min: int | None = None
    days_on_market_max: int | None = None
    price_dropped: bool = False
    deal_max: float | None = None
    deal_level: tuple[str, ...] = ()
    q: str | None = None
    sort: str = "najnowsze"
    page: int = 1
    per_page: int = C.PAGE_SIZE

    @classmethod
    def from_query(cls, query: dict[str, str | list[str]]) -> Filters:
        """Of a query string: unknown keys and unreadable numbers are ignored, decimals may have a comma, pages are clamped."""
        out = {}
        for f in fields(cls):
            if f.name not in query:
                continue
            given = query[f.name]
            last = given[-1] if isinstance(given, list) else given
            kind = str(f.type)
            if kind.startswith("tuple"):
                out[f.name] = tuple(x for x in (given if isinstance(given, list) else [given]) if x)
            elif kind == "bool":
                out[f.name] = str(last).lower() in ("1", "true", "on", "tak")
            elif kind.startswith(("float", "int")):
                try:
                    number = float(str(last).replace(" ", "").replace(",", "."))
                    out[f.name] = int(number) if kind.startswith("int") else number
                except ValueError:
                    continue
            elif str(last).strip():
                out[f.name] = str(last).strip()
        out["page"] = max(1, out.get("page", 1))
        out["per_page"] = min(C.MAX_PAGE_SIZE, max(1, out.get("per_page", C.PAGE_SIZE)))
        return cls(**out)


def browsing(query: dict[str, str | list[str]]) -> Filters:
    """Filters of a page for browsing: sales, unless the query says otherwise (an empty choice asks for all)."""
    found = Filters.from_query(query)
    return found if "transaction" in query else replace(found, transaction="sprzedaz")


def place_clause(column: Column, value: str, known: dict[str, list[str]] | None = None) -> Column:
    """A name that the registry knows matches exactly (all spellings), another one as a folded beginning."""
    if known and (names := known.get(value)):
        return column.isin(*names)
    return text.fold(column).startswith(text.fold(F.lit(value.strip())))


def street_clause(column: Column, value: str) -> Column | None:
    """Every stemmed word of the street has to occur, in any order; null if no word is left."""
    if not value.strip():
        return None
    terms = text.street_terms(F.lit(value))  # a constant, which the optimizer folds
    return F.forall(terms, lambda t: F.contains(text.fold(column), t)) & (F.size(terms) > 0)


def predicate(f: Filters, df: DataFrame, now: str, known: dict[str, list[str]] | None = None) -> Column:
    """The conjunction of all that is asked for. Null never passes a range; unknown enumeration values ask for nothing."""
    moment, col, out = F.lit(now).cast("timestamp"), F.col, []
    for name, allowed in (("kind", C.KINDS), ("property_type", C.PROPERTY_TYPES), ("transaction", C.TRANSACTIONS), ("seller_type", C.SELLER_TYPES)):
        if getattr(f, name) in allowed:
            out.append(col(name) == getattr(f, name))
    for name in ("city", "county"):
        if value := getattr(f, name):
            out.append(place_clause(col(name), value, known))
    if f.district:
        out.append(text.fold(col("district")).startswith(text.fold(F.lit(f.district.strip()))))
    out += [col(name) == getattr(f, name) for name in ("voivodeship", "agency_id", "market") if getattr(f, name)]
    if f.street and (clause := street_clause(col("street"), f.street)) is not None:
        out.append(clause)
    if f.source:
        out.append(col("source_key").isin(*f.source))
    for name, column in RANGES.items():
        low, high = getattr(f, f"{name}_min"), getattr(f, f"{name}_max")
        out += [col(column) >= low] if low is not None else []
        out += [col(column) <= high] if high is not None else []
    if f.year_min is not None:
        out.append(col("year_built") >= f.year_min)
    if f.only_original and not f.source:
        out.append(col("is_original"))
    if f.only_active:
        out.append(col("status") == "aktywna")
    if f.with_phone:  # that one can call: the offer's own number or its agency's
        own = col("has_phone") if "has_phone" in df.columns else col("phone").isNotNull()
        out.append(own | F.coalesce(F.size("agency_phones") > 0, F.lit(False)) if "agency_phones" in df.columns else own)
    if f.period in C.PERIODS:
        since = dates.warsaw_midnight_utc(moment).cast("timestamp") if f.period == "dzis" else moment - F.make_dt_interval(F.lit(C.PERIODS[f.period]))
        out.append(col("listed_at") >= since)
    if f.days_on_market_min is not None:
        out.append(col("listed_at") <= moment - F.make_dt_interval(F.lit(f.days_on_market_min)))
    if f.days_on_market_max is not None:
        out.append(col("listed_at") >= moment - F.make_dt_interval(F.lit(f.days_on_market_max)))
    if f.price_dropped:
        out.append(col("price") < col("initial_price"))
    if f.deal_max is not None:
        out.append(col("deal_ratio") <= f.deal_max)
    if f.deal_level:
        out.append(col("deal_level").isin(*f.deal_level))
    if f.q and f.q.strip():
        found = [F.contains(text.fold(col(c)), text.fold(F.lit(f.q.strip()))) for c in C.FULLTEXT_COLUMNS if c in df.columns]
        out.append(reduce(Column.__or__, (F.coalesce(x, F.lit(False)) for x in found)))
    return reduce(Column.__and__, out) if out else F.lit(True)


def order(sort: str, now: str) -> list[Column]:
    """Sort columns: nulls last, ties by id from the newest; an unknown key sorts like the newest first."""
    column, way = SORTS.get(sort, SORTS["najnowsze"])
    key = F.col(column).asc_nulls_last() if way == "asc" else F.col(column).desc_nulls_last()
    passed = [F.when(F.col("event_date") < dates.to_warsaw(F.lit(now).cast("timestamp")), 1).otherwise(0).asc()] if sort == "termin_licytacji" else []
    return [*passed, key, F.col("id").desc()]


def search(df: DataFrame, f: Filters, now: str, known: dict[str, list[str]] | None = None) -> DataFrame:
    """All listings that pass, without paging or order."""
    return df.where(predicate(f, df, now, known))


def page(df: DataFrame, f: Filters, now: str, known: dict[str, list[str]] | None = None) -> DataFrame:
    """One page of results; Spark keeps the top rows of each partition only."""
    return search(df, f, now, known).orderBy(*order(f.sort, now)).offset((f.page - 1) * f.per_page).limit(f.per_page)


def ranked(df: DataFrame, f: Filters, now: str, most: int) -> DataFrame:
    """The first ``most`` results with their place."""
    top = search(df, f, now).orderBy(*order(f.sort, now)).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order(f.sort, now))))


def phone_lookup(df: DataFrame, phones: DataFrame, digits: str, most: int = 100) -> DataFrame:
    """Newest listings with a number that holds the digits; under four digits nothing is found."""
    asked = "".join(c for c in digits if c.isdigit())
    hit = phones.where(F.contains(F.col("national"), F.lit(asked)) if len(asked) >= 4 else F.lit(False))
    return df.join(hit, df["id"] == hit["listing_id"]).orderBy(F.col("listed_at").desc_nulls_last(), F.col("id").desc()).limit(most)


def map_points(df: DataFrame, now: str, most: int = 20_000) -> DataFrame:
    """Listings for a map: rounded coordinates, short titles, age in whole days."""
    moment = F.lit(now).cast("timestamp")
    shown = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).orderBy(F.col("listed_at").desc_nulls_last(), F.col("id").desc()).limit(most)
    return shown.select("id", F.substring("title", 1, 110).alias("title"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), dates.whole_days(F.col("listed_at"), moment).alias("age_days"), "price")


def geojson(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct(*(c for c in df.columns if c not in ("lat", "lon")))
    return df.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def with_contacts(page: DataFrame, phones: DataFrame, agencies: DataFrame) -> DataFrame:
    """A page of results with its phones (listing_id, masked) and its agency (id, name) looked up in one batch each. A page is
    small, which Spark sees when it runs; many rows are joined by shuffles."""
    ids = page.select("id", "agency_id")
    numbers = phones.join(ids.select(F.col("id").alias("listing_id")), "listing_id", "left_semi").groupBy(F.col("listing_id").alias("id")).agg(F.array_sort(F.collect_set("masked")).alias("phones"))
    known = agencies.join(ids.select(F.col("agency_id").alias("of")).distinct(), F.col("id") == F.col("of"), "left_semi").select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))
    return page.join(numbers, "id", "left").join(known, "agency_id", "left").withColumn("phones", F.coalesce("phones", F.array().cast("array<string>")))


#: What a record tells under a name of its own: place, seller, auction.
NESTED = {
    "location": ("voivodeship", "county", "commune", "city", "district", "street", "teryt", "lat", "lon", "geo_precision"),
    "seller": ("seller_type", "seller_name", "agency_id"),
    "auction": ("event_date", "deadline", "opening_price", "estimate_value", "deposit", "case_number", "authority"),
}


def records(df: DataFrame, description: int = 800) -> DataFrame:
    """Listings as nested records: place, seller, the price against the median, and what only auctions have; columns that a
    listing lacks are left out."""
    have = {k: [c for c in columns if c in df.columns] for k, columns in NESTED.items()}
    inner = {c for columns in have.values() for c in columns} | {"deal_ratio", "deal_level", "description"}
    parts = [F.col(c) for c in df.columns if c not in inner]
    if "description" in df.columns:
        parts.append(F.substring("description", 1, description).alias("description"))
    if "deal_ratio" in df.columns:
        deal = F.struct(F.col("deal_ratio").alias("ratio"), F.col("deal_level").alias("level"), F.round((1 - F.col("deal_ratio")) * 100, 1).alias("below_percent"))
        parts.append(F.when(F.col("deal_ratio").isNotNull(), deal).alias("deal"))
    for name, columns in have.items():
        if columns:
            nested = F.struct(*columns)
            parts.append((F.when(F.col("kind").isin("licytacja", "przetarg", "wykaz"), nested) if name == "auction" else nested).alias(name))
    return df.select(*parts)


def detail_queue(df: DataFrame, most: int) -> DataFrame:
    """Whose detail page to read next: flats and houses first, then the newest."""
    first = F.when(F.col("property_type").isin("mieszkanie", "dom"), 0).otherwise(1)
    return df.orderBy(first, F.col("first_seen").desc_nulls_last(), F.col("id").desc()).limit(most)


def active_filters(f: Filters) -> list[tuple[str, object]]:
    """What a search asks for beyond the defaults, for labels and saved searches."""
    plain = Filters()
    return [(x.name, getattr(f, x.name)) for x in fields(f) if getattr(f, x.name) != getattr(plain, x.name) and x.name not in ("sort", "page", "per_page")]


def indexable(f: Filters, total: int) -> bool:
    """Whether a result page may be indexed: places, street, type and transaction only, with results, of the first 20 pages."""
    allowed = {"city", "county", "voivodeship", "street", "property_type", "transaction"}
    return {k for k, _ in active_filters(f)} <= allowed and total > 0 and f.page <= 20
