"""Landed HTML pages and JSON documents read into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C

SCRIPT = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'


def embedded(html: Column, pattern: str) -> Column:
    """JSON embedded in a page, as text; null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1), F.lit(""))


def next_data(html: Column) -> Column:
    return embedded(html, r'(?is)<script[^>]*id=["\']__NEXT_DATA__["\'][^>]*>(.*?)</script>')


def initial_state(html: Column) -> Column:
    return embedded(html, r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>")


def json_ld(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(SCRIPT), 1)


def json_ld_offers(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """Offers in the JSON-LD of pages: items of an ItemList, or the described thing itself; nested itemOffered comes first."""
    docs = pages.select(*keep, F.col(url).alias("page_url"), F.explode(json_ld(F.col(html))).alias("json"))
    inner = "struct<`@type`:string,name:string,url:string,description:string,datePosted:string,floorSize:struct<value:string>,numberOfRooms:string,address:struct<addressLocality:string,addressRegion:string,streetAddress:string>,offers:struct<price:string,priceCurrency:string,itemOffered:struct<name:string,floorSize:struct<value:string>,numberOfRooms:string,address:struct<addressLocality:string,addressRegion:string,streetAddress:string>>>>"
    fields = inner[7:-1]
    schema = f"struct<{fields},itemListElement:array<struct<position:int,item:{inner}>>>"
    parsed = docs.select(*keep, "page_url", F.from_json("json", schema).alias("d"))
    own = F.struct(*(F.col(f"d.`{n}`").alias(n) for n in ("@type", "name", "url", "description", "datePosted", "floorSize", "numberOfRooms", "address", "offers")))
    items = F.when(F.size("d.itemListElement") > 0, F.transform("d.itemListElement", lambda e: e["item"])).otherwise(F.array(own))
    rows = parsed.where("d is not null").select(*keep, "page_url", F.explode(items).alias("i")).where("i.name is not null or i.offers.itemOffered.name is not null")
    first = lambda path: F.coalesce(F.col(f"i.offers.itemOffered.{path}"), F.col(f"i.{path}"))
    return rows.select(
        *keep,
        "page_url",
        F.coalesce("i.url", "page_url").alias("url"),
        F.coalesce("i.name", "i.offers.itemOffered.name").alias("title"),
        F.col("i.description").alias("description"),
        F.expr("try_cast(i.offers.price as double)").alias("price"),
        first("floorSize.value").try_cast("double").alias("area"),
        first("numberOfRooms").try_cast("int").alias("rooms"),
        first("address.addressLocality").alias("city"),
        first("address.streetAddress").alias("street"),
        first("address.addressRegion").alias("voivodeship"),
        F.col("i.datePosted").alias("published"),
    )


def rest_offers(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Offers of a REST API whose parameters are a list of key and value: pivoted to columns."""
    schema = "id string, url string, title string, description string, created_time string, location struct<city:struct<name:string>,district:struct<name:string>,region:struct<name:string>>, map struct<lat:double,lon:double>, params array<struct<key:string,value:struct<key:string,label:string,value:string>>>, photos array<struct<link:string>>"
    rows = lines.select(*keep, F.from_json(column, schema).alias("o")).where("o.id is not null")
    params = F.map_from_entries(F.transform(F.array_distinct(F.coalesce("o.params", F.array())), lambda p: F.struct(p["key"], F.coalesce(p["value"]["value"], p["value"]["key"], p["value"]["label"]))))
    p = rows.withColumn("p", params)
    get = lambda k: F.try_element_at("p", F.lit(k))
    return p.select(
        *keep, F.col("o.id").alias("external_id"), "o.url", "o.title", "o.description",
        get("price").try_cast("double").alias("price"), get("m").try_cast("double").alias("area"), get("rooms").alias("rooms_word"), get("floor_select").alias("floor_word"), get("market").alias("market"),
        F.col("o.location.city.name").alias("city"), F.col("o.location.district.name").alias("district"), F.col("o.location.region.name").alias("voivodeship"),
        F.col("o.map.lat").alias("lat"), F.col("o.map.lon").alias("lon"), F.transform("o.photos", lambda x: x["link"]).alias("images"), F.col("o.created_time").alias("published"),
    )


def label_table(html: Column) -> Column:
    """A page's table rows as an array of label (k) and value (v)."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*>\s*(<t[hd].*?</t[hd]>\s*<td.*?</td>)\s*</tr>"), 1)
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]{1,400}>", " "), r"\s+", " "))
    pairs = F.transform(rows, lambda r: F.struct(F.regexp_replace(bare(F.regexp_extract(r, r"(?is)^(<t[hd].*?</t[hd]>)", 1)), "[: ]+$", "").alias("k"), bare(F.regexp_extract(r, r"(?is)</t[hd]>\s*(<td.*?</td>)", 1)).alias("v")))
    return F.filter(pairs, lambda p: p["k"] != "")


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\s[^>]*href=["\']([^"\'#]+)'), 1))


OFFER = r"(?i)/(?:oferta|oferty|ogloszenie|nieruchomosc|mieszkani[ea]|dom|dzialka|lokal|d)/[^/]+|-ID\w+\.html$|/\d{4,}(?:[/.-]|$)"
LIST_PAGE = r"(?i)(?:[?&](?:page|strona|p)=\d+|/(?:kategoria|tag|page|strona)/)"
FORM = r"(?i)(?:formularz|kontakt|login|rejestracja|regulamin|polityka|cookies)"
DOCUMENT = r"(?i)\.(?:pdf|docx?|xlsx?|zip|jpe?g|png|gif|svg|css|js)(?:$|\?)"


def url_class(url: Column) -> Column:
    """What a URL leads to: dokument, formularz, lista, oferta or inne; the first that fits."""
    return F.when(url.rlike(DOCUMENT), "dokument").when(url.rlike(FORM), "formularz").when(url.rlike(LIST_PAGE), "lista").when(url.rlike(OFFER), "oferta").otherwise("inne")


def is_list_page(html: Column, most: int = 12) -> Column:
    """Pages with many different prices list offers."""
    prices = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?iu)(\d[\d  .,]*)\s*(?:zł|pln)"), 1)
    return F.size(F.array_distinct(F.transform(prices, lambda p: F.regexp_replace(p, r"[^\d]", "")))) > most


def crawl_order(pages: DataFrame, key: str = "external_id") -> DataFrame:
    """Rows of section, page and item read breadth first; repeated ids bring nothing new; a section ends at its first page
    without a fresh item."""
    w = Window.partitionBy(key).orderBy("page", "section", "position")
    fresh = pages.withColumn("n", F.row_number().over(w)).withColumn("fresh", F.col("n") == 1)
    by_page = fresh.groupBy("section", "page").agg(F.max("fresh").alias("some"))
    ends = by_page.where(~F.col("some")).groupBy("section").agg(F.min("page").alias("end"))
    return fresh.where("fresh").join(ends, "section", "left").where(F.col("end").isNull() | (F.col("page") < F.col("end"))).drop("n", "fresh", "end")


def sitemap_urls(files: DataFrame, body: str = "xml") -> DataFrame:
    """URLs of sitemap files with what they were last changed, newest first and undated ones last; index files name files."""
    parts = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"(?is)<((?:url|sitemap)>.*?)</(?:url|sitemap)>"), 1)
    rows = files.select(F.explode(parts).alias("e"))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("e", f"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    found = rows.select(F.replace(one("loc"), F.lit("&amp;"), F.lit("&")).alias("url"), F.try_to_timestamp(F.substring(one("lastmod"), 1, 10)).alias("lastmod"), F.col("e").startswith("sitemap>").alias("is_index"))
    return found.where("url is not null").dropDuplicates(["url"]).orderBy(F.col("lastmod").desc_nulls_last(), "url")


def notice_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Links of notice boards that lead to offers: (page, link, label). Left out are files, short labels, results and other papers of
    proceedings that are over, forms to be filled in, and other hosts. A link that a page has twice counts once, with its smallest
    label."""
    found = pages.select(F.col(url).alias("page"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)(<a\s[^>]*href=["\'][^"\']+["\'][^>]*>.*?</a>)'), 1)).alias("a"))
    label = F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]{1,400}>", " "), r"\s+", " "))
    rows = found.select("page", F.regexp_extract("a", r'(?is)href=["\']([^"\']+)', 1).alias("link"), F.trim(F.btrim(F.regexp_replace(label, C.NOTICE_PREFIX, ""), F.lit("()"))).alias("label"))
    host = lambda c: F.lower(F.regexp_extract(c, r"^(?:https?:)?//([^/?#]+)", 1))
    elsewhere = (host(F.col("link")) != "") & (host(F.col("link")) != host(F.col("page")))
    own = F.regexp_replace("link", "/+$", "") == F.regexp_replace(F.coalesce("page", F.lit("")), "/+$", "")
    kept = rows.where((F.length("label") >= C.NOTICE_LENGTH) & F.col("label").rlike(C.NOTICE_OFFER) & ~F.col("label").rlike(C.NOTICE_RESULT) & ~F.col("label").rlike(C.NOTICE_FORM) & ~F.col("link").rlike(C.NOTICE_FILE) & ~elsewhere & ~own)
    return kept.groupBy("page", "link").agg(F.min("label").alias("label"))


def current_notices(notices: DataFrame, now: Column, days: int = C.NOTICE_DAYS) -> DataFrame:
    """Notices (event_date, published_at) that are still offers: the auction was yesterday at the earliest or is to come; without a date of
    one, published no more than ``days`` ago. A notice without any date stays."""
    ago = lambda c: F.floor((F.unix_micros(now) - F.unix_micros(F.col(c).cast("timestamp"))) / 86_400_000_000)
    return notices.where(F.when(F.col("event_date").isNotNull(), ago("event_date") <= 1).when(F.col("published_at").isNotNull(), ago("published_at") <= days).otherwise(True))
