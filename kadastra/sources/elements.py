"""Pages as tables of elements, and CSS selectors as joins over them.

An element is a row with the interval of its begin and end numbers, so "within" is a comparison of numbers; texts are rows of
their own (tag ``#text``). Selectors are rows too: each is cut into compounds, and a compound finds its elements by an equal
key (its id, a class or its tag) in an ordinary join; the steps of a selector are joins of intervals within a page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of these tags, unless one of the others lies between.
CLOSES = {
    "p": (("p",), ("div", "section", "article", "td", "li")), "li": (("li",), ("ul", "ol")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}
SILENT = frozenset(("script", "style", "template", "noscript"))
#: Elements and texts handed on at once.
STEP = 20_000

ELEMENTS = "source_key string, url string, n long, end long, parent long, tag string, id string, classes array<string>, attrs map<string,string>, text string"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []  # n, end, parent, tag, attrs, text
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}  # of each tag where it is open

    def _add(self, tag: str, attrs: dict, text: str | None) -> int:
        n = len(self.rows)
        self.rows.append([n, n, self.open[-1] if self.open else -1, tag, attrs, text])
        return n

    def _shut(self, depth: int) -> None:
        while len(self.open) > depth:
            n = self.open.pop()
            self.places[self.rows[n][3]].pop()
            self.rows[n][1] = len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            last, barrier = (max((x[-1] for t in tags if (x := self.places.get(t))), default=-1) for tags in CLOSES[tag])
            if last > barrier:
                self._shut(last)
        n = self._add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(n)

    def handle_endtag(self, tag):
        if at := self.places.get(tag):
            self._shut(at[-1])

    def handle_data(self, data):
        if not any(self.places.get(t) for t in SILENT):
            self._add("#text", {}, data)


def rows_of(html: str) -> list[list]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._shut(0)
    return reader.rows


def elements(landed: DataFrame, source: str = "source_key", url: str = "url", html: str = "html") -> DataFrame:
    """Elements and texts of pages: source_key, url, n, end (the last number within it), parent (-1: none), tag, id, classes, attrs, text.

    Elements left open end with the one around them, or where a like one begins; texts of scripts and styles are left out. A
    null page has no rows. Pages of one source and URL have to be told apart before: each counts as a page of its own here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ELEMENTS.split(", ")]
        for f in frames:
            out = []
            for source_key, address, page in zip(f["source_key"], f["url"], f["html"], strict=True):
                for n, end, parent, tag, attrs, text in rows_of(page or ""):
                    out.append((source_key, address, n, end, parent, tag, attrs.get("id"), attrs.get("class", "").split(), attrs, text))
                if len(out) > STEP:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return landed.select(F.col(source).alias("source_key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, ELEMENTS)


_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def _has(attrs: dict, name: str, op: str, wanted: str) -> bool:
    """``_fits`` for one element and one attribute."""
    value = attrs.get(name)
    if value is None:
        return False
    if op == "~=":
        return wanted in _BLANK.split(value)
    return {"": True, "=": value == wanted, "*=": wanted in value, "^=": value.startswith(wanted), "$=": value.endswith(wanted), "|=": value == wanted or value.startswith(wanted + "-")}[op]


class Page:
    """One page, read once, in which selectors are looked up; finds what ``matches`` and ``texts`` find."""

    def __init__(self, html: str):
        self.rows = rows_of(html)
        self.words = [r[0] for r in self.rows if r[3] == "#text"]
        self.at: dict[str, list[int]] = {}  # of each tag, class and id
        for n, _, _, tag, attrs, _ in self.rows:
            if tag != "#text":
                for key in {tag, "*", *("." + c for c in attrs.get("class", "").split()), "#" + attrs.get("id", "")}:
                    self.at.setdefault(key, []).append(n)

    def find(self, chains: list[list[tuple]]) -> list[int]:
        """The elements that a parsed selector finds, in their order."""
        out: set[int] = set()
        for chain in chains:
            now: set[int] = set()
            for k, (child, tag, id_, classes, wanted) in enumerate(chain):
                hits = []
                for n in self.at.get(f"#{id_}" if id_ else f".{classes[0]}" if classes else tag or "*", ()):
                    _, _, _, own, attrs, _ = self.rows[n]
                    if (tag is None or tag == own) and (id_ is None or id_ == attrs.get("id")) and (not classes or set(classes) <= set(attrs.get("class", "").split())) and all(_has(attrs, *w) for w in wanted):
                        hits.append(n)
                if k and hits:
                    held = now if child else self._around(now)
                    hits = [n for n in hits if self.rows[n][2] in held]
                now = set(hits)
            out |= now
        return sorted(out)

    def _around(self, found: set[int]) -> set[int]:
        """Elements that are one of those found or lie within one."""
        held: set[int] = set()
        for n, _, parent, tag, *_ in self.rows:
            if tag != "#text" and (n in found or parent in held):
                held.add(n)
        return held

    def text(self, n: int) -> str | None:
        """The whole text within an element; None if there is no text."""
        lo, hi = bisect_right(self.words, n), bisect_right(self.words, self.rows[n][1])
        return "".join(self.rows[t][5] for t in self.words[lo:hi]) if hi > lo else None


STEPS = "source_key string, name string, alt int, step int, last boolean, child boolean, key string, tag string, id string, classes array<string>, attrs array<struct<name:string,op:string,value:string>>"
_COMPOUND = re.compile(r"(?P<tag>[\w-]+|\*)?(?P<rest>(?:[#.][\w-]+|\[[^\]]*\])*)$")
_PART = re.compile(r"([#.])([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*)?\]")
_TOKEN = re.compile(r"\s*>\s*|\s+|(?:\[[^\]]*\]|[^\s>\[])+")


def parse(selector: str) -> list[list[tuple[bool, str | None, str | None, list[str], list[tuple[str, str, str]]]]]:
    """Alternatives of a selector, each a list of compounds: (child of the one before, tag, id, classes, attributes)."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        chain, child = [], False
        for token in _TOKEN.findall(alternative.strip()):
            if not token.strip():
                continue
            if token.strip() == ">":
                child = True
                continue
            found = _COMPOUND.match(token)
            if not found:
                raise ValueError(f"selector not understood: {selector!r}")
            parts = _PART.findall(found["rest"])
            chain.append((child, found["tag"] if found["tag"] != "*" else None, next((v for k, v, *_ in parts if k == "#"), None), [v for k, v, *_ in parts if k == "."], [(n, op, a or b or c) for k, _, n, op, a, b, c in parts if not k]))
            child = False
        if not chain:
            raise ValueError(f"selector not understood: {selector!r}")
        out.append(chain)
    return out


def steps(spark: SparkSession, selectors: list[tuple[str, str, str]]) -> tuple[DataFrame, int]:
    """(source_key, name, selector) as a table of compounds, and the most compounds of a selector."""
    rows = []
    for source, name, selector in selectors:
        for alt, chain in enumerate(parse(selector)):
            for k, (child, tag, id_, classes, attrs) in enumerate(chain):
                key = f"#{id_}" if id_ else f".{classes[0]}" if classes else tag or "*"
                rows.append((source, name, alt, k, k == len(chain) - 1, child, key, tag, id_, classes, attrs))
    return spark.createDataFrame(rows, STEPS), max((r[3] for r in rows), default=-1) + 1


def _fits(attrs: Column, a: Column) -> Column:
    value = F.element_at(attrs, a["name"])
    op, wanted = a["op"], a["value"]
    word = F.array_contains(F.split(value, r"\s+"), wanted)
    how = F.when(op == "=", value == wanted).when(op == "*=", value.contains(wanted)).when(op == "^=", value.startswith(wanted)).when(op == "$=", value.endswith(wanted)).when(op == "~=", word).when(op == "|=", (value == wanted) | value.startswith(F.concat(wanted, F.lit("-")))).otherwise(True)
    return F.coalesce(F.map_contains_key(attrs, a["name"]) & how, F.lit(False))


def matches(page: DataFrame, spark_steps: tuple[DataFrame, int]) -> DataFrame:
    """Elements that selectors find: source_key, url, name, n, end, each once."""
    table, most = spark_steps
    keys = F.array_distinct(F.concat(F.array(F.col("tag"), F.lit("*")), F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.when(F.col("id") != "", F.array(F.concat(F.lit("#"), F.col("id")))).otherwise(F.array().cast("array<string>"))))
    keyed = page.where("tag <> '#text'").withColumn("key", F.explode(keys))
    s = table.select(*(F.col(c).alias(f"s_{c}") for c in table.columns))
    found = keyed.join(s, (F.col("source_key") == F.col("s_source_key")) & (F.col("key") == F.col("s_key")))
    fits = (F.col("s_tag").isNull() | (F.col("s_tag") == F.col("tag"))) & (F.col("s_id").isNull() | (F.col("s_id") == F.col("id")))
    fits = fits & (F.size(F.array_except("s_classes", "classes")) == 0) & F.forall("s_attrs", lambda a: _fits(F.col("attrs"), a))
    hits = found.where(fits).select("source_key", "url", F.col("s_name").alias("name"), F.col("s_alt").alias("alt"), F.col("s_step").alias("step"), F.col("s_last").alias("last"), F.col("s_child").alias("child"), "n", "end", "parent")
    on = ["source_key", "url", "name", "alt"]
    out, now = None, hits.where("step = 0")
    for k in range(most):
        done = now.where("last").select("source_key", "url", "name", "n", "end")
        out = done if out is None else out.unionByName(done)
        if k + 1 < most:
            around = now.select(*on, F.col("n").alias("o_n"), F.col("end").alias("o_end"))
            inside = F.when(F.col("child"), F.col("parent") == F.col("o_n")).otherwise((F.col("n") > F.col("o_n")) & (F.col("n") <= F.col("o_end")))
            now = hits.where(F.col("step") == k + 1).join(around, on).where(inside).drop("o_n", "o_end").distinct()
    return out.distinct()


def texts(page: DataFrame, of: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and the whole text of each row of ``of`` (key, with source_key and url among it, n, end); rows without text are left out."""
    words = page.where("tag = '#text'").select("source_key", "url", F.col("n").alias("t_n"), "text")
    inside = of.join(words, ["source_key", "url"]).where((F.col("t_n") > F.col("n")) & (F.col("t_n") <= F.col("end")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_n", "text"))), lambda t: t["text"]), "")
    return inside.groupBy(*key).agg(joined.alias("text"))
