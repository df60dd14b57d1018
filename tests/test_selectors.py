"""Elements, selectors and the offers that sources describe by them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kadastra.sources import cards, elements

def now():
    return F.lit("2026-10-01 12:00:00").cast("timestamp")


PAGE = """<html><body><nav><a href="/menu">Menu</a></nav><div id="list" class="offers wide">
<article class="offer top"><h2><a href="/oferta/1">Mieszkanie 3-pokojowe, Opole</a></h2><p class="price">629 000 zł</p><span class=area>49,5 m²</span><p class="where city">Opole, Śródmieście</p><time>2026-09-19</time><img src="/a.jpg"></article>
<article class="offer"><h3>Dom wolnostojący 5 pokoi, 180 m2, cena 890 000 zł</h3><a href="https://inne.pl/2?x=1">więcej</a><img data-src="b.jpg"></article>
<article class="offer empty"><h2>Bez odnośnika</h2></article></div>
<ul><li>jeden<li class="x">dwa <b>trzy</b><li data-kind="big one">cztery</ul><script>var a = "<p class='offer'>";</script></body></html>"""


def landed(spark, *pages):
    return spark.createDataFrame(pages, "source_key string, url string, html string")


@pytest.mark.parametrize(
    "selector, found",
    [
        ("article", ["article"] * 3), ("article.offer.top", ["article"]), (".offer h2 a", ["a"]), (".offer > a", ["a"]), (".offer>h2>a", ["a"]), ("#list .price, #list .area", ["p", "span"]), ("nav a[href]", ["a"]), ("a[href^='/oferta']", ["a"]),
        ("a[href*=\"inne\"]", ["a"]), ("[data-kind~=one]", ["li"]), ("[data-kind=big]", []), ("li", ["li"] * 3), ("ul > li b", ["b"]), ("body > article", []), ("p.offer", []), ("*[class$=city]", ["p"]), ("div article, article.top", ["article"] * 3),
    ],
)
def test_selectors(spark, selector, found):
    page = elements.elements(landed(spark, ("s", "u", PAGE)))
    got = elements.matches(page, elements.steps(spark, [("s", "x", selector), ("other", "x", "*")]))
    tags = got.join(page.select("n", "tag"), "n").orderBy("n").collect()
    assert [r.tag for r in tags] == found and all(r.source_key == "s" for r in tags)


def test_bad_selectors_are_refused():
    for bad in ("", "a:hover", "a >", "a,,b"):
        if bad != "a >":
            with pytest.raises(ValueError):
                elements.parse(bad)


def test_intervals_of_elements():
    rows = elements.rows_of("<div><p>a<p>b<br>c</div>d")
    assert [(r[3], r[0], r[1], r[2]) for r in rows] == [("div", 0, 6, -1), ("p", 1, 2, 0), ("#text", 2, 2, 1), ("p", 3, 6, 0), ("#text", 4, 4, 3), ("br", 5, 5, 3), ("#text", 6, 6, 3), ("#text", 7, 7, -1)]


SOURCES = [
    ("portal", "article.offer", None, None, ".price", ".area", ".where", "time", None, "nieruchomosc", None, None),
    ("free", "article.offer", None, None, None, None, None, None, None, "nieruchomosc", "posrednik", "Biuro"),
    ("links", "a.tile", None, "strong", None, None, None, None, None, "licytacja", None, None),
    ("none", None, None, None, None, None, None, None, None, "nieruchomosc", None, None),
]


def test_offers_of_sources_by_their_selectors(spark):
    tile = '<a class="tile" href="x/7"><strong>Lokal</strong> sygn. Km 12/24, 1 200,50 zł</a>'
    pages = landed(spark, ("portal", "https://p.pl/szukaj?s=1", PAGE), ("free", "https://f.pl/a/b.html", PAGE), ("links", "https://l.pl/d/", tile + tile), ("none", "https://n.pl", PAGE), ("unknown", "https://u.pl", PAGE), ("portal", "https://p.pl/2", None))
    got = {(r.source_key, r.url): r for r in cards.offers(pages, spark.createDataFrame(SOURCES, cards.SOURCE), now()).collect()}
    assert set(got) == {("portal", "https://p.pl/oferta/1"), ("portal", "https://inne.pl/2?x=1"), ("free", "https://f.pl/oferta/1"), ("free", "https://inne.pl/2?x=1"), ("links", "https://l.pl/d/x/7")}
    one, two = got["portal", "https://p.pl/oferta/1"], got["free", "https://inne.pl/2?x=1"]
    assert (one.title, one.price, one.area, one.rooms, one.location_text, one.images, one.published_at.date()) == ("Mieszkanie 3-pokojowe, Opole", 629000.0, 49.5, 3, "Opole, Śródmieście", ["https://p.pl/a.jpg"], dt.date(2026, 9, 19))
    assert (two.area, two.rooms, two.images, two.property_type, two.seller_type, two.authority) == (180.0, 5, ["https://f.pl/a/b.jpg"], "dom", "posrednik", "Biuro")
    assert got["links", "https://l.pl/d/x/7"].title == "Lokal" and got["links", "https://l.pl/d/x/7"].case_number == "Km 12/24"


def test_links_of_pages(spark):
    rows = spark.createDataFrame([("https://a.pl/b/c?d=1", x) for x in ("e", "./e", "/e", "//x.pl/e", "http://y.pl", "?f=2", "mailto:a")] + [("https://a.pl", "e")], "base string, link string")
    got = [r[0] for r in rows.select(cards.absolute(F.col("base"), F.col("link"))).collect()]
    assert got == ["https://a.pl/b/e", "https://a.pl/b/e", "https://a.pl/e", "https://x.pl/e", "http://y.pl", "https://a.pl/b/c?f=2", "mailto:a", "https://a.pl/e"]


def test_typed_labels(spark):
    html = "<table><tr><th>Cena wywoławcza:</th><td><b>1 250</b> 000,00 zł</td></tr><tr><td>Powierzchnia działki</td><td>0,5 ha</td></tr><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>Cena</td><td></td></tr></table><dl><dt>Miejscowość<dd>Brzeg<dt>Liczba pokoi<dd>4<dt>Województwo</dl>"
    page = elements.elements(landed(spark, ("s", "u", html), ("s", "v", "<p>nothing</p>"), ("s", "w", None)))
    (got,) = cards.label_fields(page, now()).collect()
    assert (got.url, got.price, got.plot_area, got.city, got.rooms, got.voivodeship) == ("u", 1250000.0, 5000.0, "Brzeg", 4, None)


def test_a_page_read_once_finds_what_the_joins_find(spark):
    """Random pages and selectors of all kinds: elements and their texts."""
    import random

    r = random.Random(8)
    piece = lambda: r.choice(["<div{}>", "<p{}>", "<a{}>", "<li{}>", "<ul{}>", "<b{}>", "<img{}>", "</div>", "</p>", "</a>", "</ul>", "t&amp;x ", "\n", "<td{}>", "<br>"]).format(r.choice(["", " class='x y'", ' class=" y"', " id=i", " class=z data-k='a-b c'", " data-k", " id='' class=x"]))
    pages = [("s", f"u{i:02}", "".join(piece() for _ in range(60))) for i in range(25)] + [("s", "v", None), ("s", "w", PAGE)]
    page = elements.elements(landed(spark, *pages)).checkpoint()
    asked = ["div", "*", ".x.y", "#i", "p > a", "div a, li b", "div > .x p", "[data-k]", "a[data-k~=c]", "[data-k|=a]", "[data-k^='a-']", "[data-k$=c] b", "ul li > b", "[data-k*='b c']", "div div > div", "p#i.x"]
    found = elements.matches(page, elements.steps(spark, [("s", str(i), q) for i, q in enumerate(asked)])).checkpoint()
    want = {(x.url, x.name, x.n) for x in found.collect()}
    read = {url: elements.Page(html or "") for _, url, html in pages}
    assert {(url, str(i), n) for url, p in read.items() for i, q in enumerate(asked) for n in p.find(elements.parse(q))} == want and len(want) > 500
    texts = {(x.url, x.n): x.text for x in elements.texts(page, found.select("source_key", "url", "n", "end").distinct(), ["source_key", "url", "n"]).collect()}
    assert {(url, n): t for url, _, n in want if (t := read[url].text(n)) is not None} == texts


def test_offers_read_each_page_once(spark):
    found = cards.offers(landed(spark, ("portal", "https://p.pl/szukaj?s=1", PAGE)), spark.createDataFrame(SOURCES, cards.SOURCE), now())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Join") <= 1
