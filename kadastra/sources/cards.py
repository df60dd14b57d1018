"""Offers of list pages that a source describes by selectors, and typed label tables of detail pages. Sources are rows, not code."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.functions import dates, numbers, text
from kadastra.sources import elements

#: Selectors of a source that it may leave out.
USUAL = {"link": "a", "title": "h2, h3, a", "image": "img"}
FIELDS = ("link", "title", "price", "area", "location", "date", "image")
SOURCE = "source_key string, list string, " + ", ".join(f"{f} string" for f in FIELDS) + ", kind string, seller_type string, authority string"


def absolute(base: Column, link: Column) -> Column:
    """A link of a page as a whole URL."""
    origin, scheme = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?:)", 1)
    folder = F.when(F.regexp_replace(base, r"[?#].*$", "").rlike(r"^https?://[^/]+/"), F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(.*/)", 1)).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link))
        .otherwise(F.concat(folder, F.regexp_replace(link, r"^\./", "")))
    )


CARD = "source_key string, url string, card long, body string, title string, price string, area string, location string, date string, link string, image string, itself string"


def _reader(asked: dict[str, dict[str, list]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Reads pages once each and gives a row for each card: its text, the text or address of the first element for each field, and its own address."""
    names = [c.split()[0] for c in CARD.split(", ")]

    def read(source_key: str, url: str, html: str | None) -> Iterator[tuple]:
        page, wanted = elements.Page(html or ""), asked[source_key]
        at = {f: page.find(chains) for f, chains in wanted.items()}
        for card in at.pop("list", ()):
            end, tag, attrs = page.rows[card][1], *page.rows[card][3:5]
            first = {f: ns[k] for f, ns in at.items() if (k := bisect_right(ns, card)) < len(ns) and ns[k] <= end}
            attr = lambda f, *keys: next((v for k in keys if f in first and (v := page.rows[first[f]][4].get(k))), None)  # noqa: E731, B023
            texts = (page.text(first[f]) if f in first else None for f in ("title", "price", "area", "location", "date"))  # noqa: B023
            yield (source_key, url, card, page.text(card), *texts, attr("link", "href"), attr("image", "src", "data-src"), attrs.get("href") if tag == "a" else None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in zip(f["source_key"], f["url"], f["html"], strict=True):
                out.extend(read(*row))
                if len(out) > elements.STEP:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return run


def offers(landed: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Offers of landed list pages (source_key, url, html) by the selectors of their source (``sources``: SOURCE, a row for each; the
    table of sources is read by the driver, like any configuration).

    A card is what ``list`` finds; each field is the first element within it that the field's selector finds. A card that is a
    link itself needs no other; without a link or a title it is no offer. Price, area and rooms are read from their own element, or
    from the card's whole text where the source names none. Pages of unknown sources and sources without ``list`` give nothing.
    Offers with one URL of a source count once, with the card that comes first on the page with the smallest URL.
    """
    spark = landed.sparkSession
    config = [r.asDict() for r in sources.where("list is not null").collect()]
    asked: dict[str, dict[str, list]] = {}
    for c in config:
        for f in ("list", *FIELDS):
            if chosen := c[f] or USUAL.get(f):
                asked.setdefault(c["source_key"], {}).setdefault(f, []).extend(elements.parse(chosen))
    known = spark.createDataFrame([(c["source_key"], c["kind"], c["seller_type"], c["authority"], *(c[f] is not None for f in ("price", "area"))) for c in config], "source_key string, kind string, seller_type string, authority string, own_price boolean, own_area boolean")
    found = landed.select(*(F.col(c).cast("string") for c in ("source_key", "url", "html"))).where(F.col("source_key").isin([*asked]) & F.col("url").isNotNull()).mapInPandas(_reader(asked), CARD)
    told = {c: F.nullif(text.clean(F.col(c)), F.lit("")).alias(c) for c in ("body", "title", "price", "area", "location", "date")}
    wide = found.select("source_key", "url", "card", *told.values(), *(F.nullif(c, F.lit("")).alias(c) for c in ("link", "image", "itself")))
    rows = wide.withColumn("href", F.coalesce("link", "itself")).withColumn("named", F.coalesce("title", F.nullif(F.trim(F.substring("body", 1, 180)), F.lit(""))))
    rows = rows.where("href is not null and named is not null").withColumn("offer_url", absolute(F.col("url"), F.col("href")))
    # What counts once is chosen before it is read, so that nobody reads what is not asked for.
    once = rows.groupBy("source_key", "offer_url").agg(F.min_by(F.struct("url", "body", "named", "price", "area", "location", "date", "image"), F.struct("url", "card")).alias("o"))
    rows = once.select("source_key", "offer_url", "o.*").join(known, "source_key")
    priced, sized = (F.when(F.col(f"own_{f}"), F.col(f)).otherwise(F.col("body")) for f in ("price", "area"))
    return rows.select(
        "source_key", F.col("offer_url").alias("url"), F.col("named").alias("title"), numbers.parse_number(priced).alias("price"), numbers.area(sized).alias("area"), numbers.rooms(F.col("body")).alias("rooms"), F.col("location").alias("location_text"),
        F.when(F.col("image").isNotNull(), F.array(absolute(F.col("url"), F.col("image")))).otherwise(F.array().cast("array<string>")).alias("images"), dates.parse_moment(F.col("date"), now).alias("published_at"),
        text.property_type(F.col("named"), F.col("body")).alias("property_type"), text.transaction(F.col("named"), F.col("body"), F.col("url")).alias("transaction"),
        F.when(F.col("kind") == "licytacja", numbers.case_number(F.col("body"))).alias("case_number"), "kind", F.coalesce("seller_type", F.lit("nieznany")).alias("seller_type"), "authority",
    )


#: How labels of a detail page are read (fixed values): a column, the kind of its value, and the labels that mean it, folded.
LABELS = (
    ("price", "number", ("cena", "cena wywolawcza", "cena wywolania", "cena nieruchomosci")),
    ("deposit", "number", ("wadium", "rekojmia")),
    ("area", "area", ("powierzchnia", "powierzchnia uzytkowa", "pow uzytkowa", "powierzchnia lokalu")),
    ("plot_area", "area", ("powierzchnia dzialki", "powierzchnia gruntu", "pow dzialki")),
    ("rooms", "whole", ("liczba pokoi", "pokoje")),
    ("year_built", "whole", ("rok budowy",)),
    ("city", "text", ("miejscowosc", "miasto")),
    ("street", "text", ("ulica", "adres")),
    ("voivodeship", "text", ("wojewodztwo",)),
    ("event_date", "moment", ("data przetargu", "termin przetargu", "data licytacji")),
)


def label_pairs(page: DataFrame) -> DataFrame:
    """Labels and values of pages (elements): cells of two-cell table rows, and terms with their descriptions. A label counts once for
    each page, with its first value that is not empty."""
    at = ["source_key", "url"]
    cells = page.where("tag in ('td', 'th', 'dt', 'dd')").select(*at, "n", "end", "parent", "tag")
    row = cells.groupBy(*at, "parent").agg(F.array_sort(F.collect_list(F.struct("n", "end", "tag"))).alias("cells"))
    table = row.where("size(cells) = 2 and cells[1].tag = 'td' and cells[0].tag in ('td', 'th')").select(*at, F.col("cells")[0].alias("k"), F.col("cells")[1].alias("v"))
    follows = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.struct(F.get("cells", i).alias("k"), F.get("cells", i + 1).alias("v")))
    listed = row.where("cells[0].tag in ('dt', 'dd')").select(*at, F.explode(F.filter(follows, lambda p: (p["k"]["tag"] == "dt") & (p["v"]["tag"] == "dd"))).alias("p")).select(*at, "p.k", "p.v")
    pairs = table.unionByName(listed).withColumn("pair", F.col("k.n"))
    sides = pairs.select(*at, "pair", F.explode(F.array(F.struct(F.lit("k").alias("side"), F.col("k.n"), F.col("k.end")), F.struct(F.lit("v").alias("side"), F.col("v.n"), F.col("v.end")))).alias("s")).select(*at, "pair", "s.*")
    read = elements.texts(page, sides, [*at, "pair", "side"]).groupBy(*at, "pair").pivot("side", ["k", "v"]).agg(F.first(text.clean(F.col("text"))))
    named = read.select(*at, "pair", text.norm_key(F.col("k")).alias("label"), F.col("v").alias("value")).where("label <> '' and value <> ''")
    return named.groupBy(*at, "label").agg(F.min_by("value", "pair").alias("value"))


def label_fields(page: DataFrame, now: Column, labels=LABELS) -> DataFrame:
    """Typed columns of pages (elements) by their labels: numbers, areas in square metres (hectares are turned), whole numbers, texts, moments."""
    pairs = label_pairs(page)
    spark = page.sparkSession
    meant = spark.createDataFrame([(name, k, c) for c, (name, _, known) in enumerate(labels) for k in known], "field string, label string, c int")
    found = pairs.join(meant, "label").groupBy("source_key", "url").pivot("field", [name for name, _, _ in labels]).agg(F.min_by("value", "label"))
    size = lambda v: numbers.parse_number(v) * F.when(v.rlike(r"(?i)\d\s*ha\b"), 10_000).otherwise(1)
    kinds = {"number": numbers.parse_number, "area": size, "whole": lambda v: F.floor(numbers.parse_number(v)).cast("int"), "text": lambda v: v, "moment": lambda v: dates.parse_moment(v, now, naive_local=True)}
    return found.select("source_key", "url", *(kinds[kind](F.col(name)).alias(name) for name, kind, _ in labels))
