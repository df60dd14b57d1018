"""Operator 2: HTML extraction by nearest-URL page differencing.

Pages are sorted by host and URL path. A page's partner is that of its two neighbours whose path agrees with its own for
more segments (the one before it if both agree alike). Each page is read as lines of text, one for each block; the lines of
a page and of its partner are aligned by a longest common subsequence, and shared ones are deleted as boilerplate.

Markup settles what differencing cannot tell:

* lines in an ``article`` or ``main`` element stay although shared: mirrored pages and repeated passages are content;
* lines in elements named as navigation, adverts, comments and the like go although the partner has others there, but an
  article or main element within such an element, or with such a name among others, is content (within a strong name or a form
  only if there is no other one), and on a page without these elements names that leave nothing are passed over;
* inside an article weaker names (notice, related, share) count only for shared lines, as a template's;
* without such elements, a partner that leaves next to nothing is a copy: then the other neighbour counts, if it leaves more.

The sort is dealt to ranges of the sorted keys. The first and the last page of a range go to the range beside it too, so a
page meets the same neighbours however the table is dealt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import by_hash, materialize, sample_rate

#: Elements whose text is no content: blocks, and such as may stand within a line, which go on after them.
DROPPED = frozenset("nav header footer aside form dialog menu head title".split())
SILENT = frozenset("script style noscript template iframe svg button select option textarea canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a head may hold; any other one ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CONTENT = frozenset({"article", "main"})
#: Names in class and id values that mark boilerplate elements: anywhere, and outside articles (inside only if shared).
STRONG = re.compile(r"(?:^|[\s_-])(?<!no[-_])(?:comments?|commentlist|disqus|replies|reply|respond|ads?|advert\w*|sponsor\w*)(?:$|[\s_-])")
WEAK = re.compile(r"(?:^|[\s_-])(?:banner|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w*|signup|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|topbar|share|sharing|social|related|recommended|widget|pagination|pager)(?:$|[\s_-])")
#: An article that is itself one of these is no content; other names of an article or main element say nothing about its text.
NO_ARTICLE = frozenset("comment comment-body reply response ad ads advert advertisement sponsored teaser".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SPACE = re.compile(r"\s+")
#: A neighbour that leaves less than one in this many characters of what the other one leaves is a copy of the page.
COPY = 5
#: Ranges for each shuffle partition, sampled keys for each range, pages of a range at least, and of a partition at most (about).
RANGES, SAMPLES, LEAST_PAGES, MOST_PAGES = 4, 4, 32, 32_768
#: Bits of one table of the alignment; larger ones are cut in halves.
TABLE_BITS = 1 << 28

#: Kinds of lines: in no named element; boilerplate by its element; in a form; boilerplate by a strong or a weak name; in a content
#: element; there with a weak name; in a content element within a form or a strong name, which is the content if there is no other.
PLAIN, CHROME, FORM, NAMED, SOFT, INNER, HINT, DOUBTFUL = range(8)


class _Blocks(HTMLParser):
    """Lines of text, each with its kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, kind, emphatically dropped (no text is kept at all)
        self.places: dict[str, list[int]] = {}  # of each tag where it is open in the stack
        self.content = False  # whether there is a content element
        self.out: list[tuple[str, int]] = []
        self.parts: list[str] = []

    def state(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (PLAIN, False)

    def flush(self, kind: int | None = None) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                self.out.append((text, self.state()[0] if kind is None else kind))

    def handle_starttag(self, tag, attrs):
        if (tag in BLOCKS or tag in DROPPED) and not self.state()[1]:
            self.flush()
        if tag not in IN_HEAD and self.places.get("head"):  # a head whose end tag was left out
            self._close("head")
        if tag in VOID:
            return
        if tag == "p" or tag == "li":  # these end a like one that was left open, and inline elements within
            self._close(tag, until=("article", "main", "section", "div", "td", "ul", "ol", "blockquote", "body"))
        kind, silent = self.state()
        if tag not in ("html", "body"):
            kind = self._kind(tag, dict(attrs), kind)
        silent = silent or tag in SILENT or tag in ("head", "title")
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, kind, silent))

    def _kind(self, tag: str, at: dict, kind: int) -> int:
        if kind == CHROME:
            return CHROME
        named = f"{at.get('class') or ''} {at.get('id') or ''}".lower()
        inside = kind in (INNER, HINT, DOUBTFUL)
        if tag in DROPPED and tag != "form" and not (tag == "header" and inside) or "hidden" in at or at.get("role") in ROLES or at.get("aria-hidden") == "true":
            return CHROME
        if tag in CONTENT:
            if not NO_ARTICLE.isdisjoint(named.split()):
                return CHROME
            self.content = True
            return INNER if kind in (PLAIN, SOFT) else DOUBTFUL if kind in (FORM, NAMED) else kind
        if tag == "form" or kind == FORM:
            return CHROME if inside else FORM
        if named != " " and STRONG.search(named):
            return CHROME if inside else NAMED
        if kind in (PLAIN, INNER) and named != " " and WEAK.search(named):
            return HINT if inside else SOFT
        return kind

    def _close(self, tag: str, until: tuple[str, ...] = ()) -> None:
        at = self.places.get(tag)
        if not at or any((x := self.places.get(t)) and x[-1] > at[-1] for t in until):
            return
        for _ in range(len(self.stack) - at[-1]):
            self.places[self.stack.pop()[0]].pop()

    def handle_endtag(self, tag):
        block, silent, at = tag in BLOCKS or tag in DROPPED, self.state()[1], self.places.get(tag)
        if block and not silent:
            self.flush()
        kind = self.stack[at[-1]][1] if at else None
        if tag not in VOID:
            self._close(tag)
        if block and silent and at is not None and not self.state()[1]:  # a silent element within was left open
            self.flush(kind)

    def handle_data(self, data):
        if not self.state()[1]:
            self.parts.append(data)


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, kind) of all lines but those of scripts, styles and the head."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    settled = {DOUBTFUL: CHROME if any(kind == INNER for _, kind in parser.out) else INNER}
    if parser.content:  # names elsewhere are right
        settled |= {NAMED: CHROME, SOFT: CHROME}
    return [(text, settled.get(kind, kind)) for text, kind in parser.out]


def _rows(a: list[int], b: list[int]) -> list[int]:
    """For each line of ``a``, the bit vector of a bit-parallel alignment with ``b``: zero where the common subsequence grows."""
    where: dict[int, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    now, out = full, []
    for line in a:
        if u := now & where.get(line, 0):
            now = ((now + u) | (now - u)) & full
        out.append(now)
    return out


def _grown(bits: int, n: int) -> np.ndarray:
    """Lengths of the common subsequences with the first 0 to n lines, from a bit vector."""
    zeros = 1 - np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64)
    return np.r_[0, np.cumsum(zeros)]


def _align(a: list[int], b: list[int], at: int, out: set[int]) -> None:
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    out.update(range(at, at + i))
    out.update(range(at + len(a) - j, at + len(a)))
    a, b, at = a[i : len(a) - j], b[i : len(b) - j], at + i
    if not a or not b:
        return
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:  # halves of a, with the cut of b that keeps most
        half = len(a) // 2
        head = _grown(_rows(a[:half], b)[-1], len(b))
        tail = _grown(_rows(a[half:][::-1], b[::-1])[-1], len(b))[::-1]
        cut = int((head + tail).argmax())
        _align(a[:half], b[:cut], at, out)
        _align(a[half:], b[cut:], at + half, out)
        return
    rows, row, col = _rows(a, b), len(a), len(b)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
            continue
        row -= 1
        if not row or rows[row - 1] >> (col - 1) & 1:
            out.add(at + row)
            col -= 1


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    names: dict[str, int] = {}
    out: set[int] = set()
    _align([names.setdefault(x, len(names)) for x in a], [names.setdefault(x, len(names)) for x in b], 0, out)
    return out


def likeness(a: str, b: str) -> int:
    """Segments in which two paths agree, from the start."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def main_text(own: list[tuple[str, int]], near: list[list[tuple[str, int]]]) -> tuple[str, int, int, int]:
    """The text of a page, and how many lines were deleted as shared, deleted by their names alone, and kept by their element
    although shared. ``near`` has the neighbours, the partner first."""
    lines = [text for text, _ in own]
    open_ = [kind not in (CHROME, FORM, NAMED, SOFT) for _, kind in own]
    if not any(open_):  # names left nothing: then the difference to the partner alone decides
        open_ = [kind not in (CHROME, FORM) for _, kind in own]
    held = any(kind in (INNER, HINT) for _, kind in own)

    def difference(other: list[tuple[str, int]]) -> tuple[set[int], int]:
        common = shared(lines, [text for text, _ in other])
        return common, sum(len(x) for i, x in enumerate(lines) if open_[i] and i not in common)

    common: set[int] = set()
    if near:
        common, left = difference(near[0])
        if not held and len(near) > 1:
            other, more = difference(near[1])
            if left * COPY < more:
                common, left = other, more
        if not held and not left:  # only copies of the page: nothing to tell from
            common = {i for i in common if not open_[i]}
    kept = [i for i, (_, kind) in enumerate(own) if kind == INNER or open_[i] and i not in common]
    gone = set(range(len(own))) - set(kept)
    return "\n".join(lines[i] for i in kept), len(gone & common), len(gone - common), len(set(kept) & common)


RESULT = "page_id long, url string, text string, n_chars long, n_shared long, n_named long, n_settled long"


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition sorted by range and key: pages between the one before and the one after them; pages that are not ``own``
    stand there for their neighbours only."""
    window: list = []

    def row(before, page, after):
        page_id, url, host, path, own, _, _ = page
        near = [x for x in (before, after) if x is not None and host and x[2] == host and x[5] == page[5]]
        if len(near) == 2 and likeness(near[1][3], path) > likeness(near[0][3], path):
            near.reverse()
        text, *counts = main_text(own, [x[4] for x in near])
        return page_id, url, text, len(text), *counts

    def table(out):
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")]).astype({"page_id": "Int64"})

    for f in frames:
        out = []
        for page_id, url, host, path, html, at, own in zip(*(f[c] for c in ("page_id", "url", "host", "path", "html", "at", "own")), strict=True):
            window = [*window, (page_id, url, host, path, blocks(html or ""), at, own)][-3:]
            if len(window) > 1 and window[-2][6]:
                out.append(row(window[-3] if len(window) > 2 else None, window[-2], window[-1]))
        if out:
            yield table(out)
    if window and window[-1][6]:
        yield table([row(window[-2] if len(window) > 1 else None, window[-1], None)])


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; n_shared, n_named and n_settled count its lines that were
    deleted as shared, deleted by their names alone, and kept by their element although shared.

    Null or empty html gives an empty text. A page with a null or hostless URL, or alone in its host, has no neighbour and
    keeps all lines that the markup does not rule out. Repeated pages are neighbours of each other; rows equal in id, URL
    and html are told apart by nothing and meet in one task, one at a time. An empty table gives an empty result; columns
    other than the three named are not read.
    """
    spark = pages.sparkSession
    key = F.concat_ws("\t", F.concat_ws(" ", host(F.col(url)), path(F.col(url))), F.col(url), F.lpad(F.coalesce(F.col(page_id).cast("string"), F.lit("")), 20, "0"), F.hex(F.xxhash64(html)))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), F.col(html).alias("html"), key.alias("key"))
    keys = materialize(rows.select("key"), "page-keys")
    total = keys.count()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(usual, -(-total // MOST_PAGES))
    ranges = max(1, min(RANGES * partitions, total // LEAST_PAGES))
    sampled = sorted(r["key"] for r in keys.where(by_hash(sample_rate(total, SAMPLES * ranges), "key", salt="range")).distinct().collect())  # SAMPLES * ranges, about
    bounds = sampled[:: max(1, len(sampled) // ranges)][1:]

    def place(values: pd.Series) -> np.ndarray:
        return np.searchsorted(np.array(bounds, object), values.to_numpy(object), "right") if bounds else np.zeros(len(values), np.int64)

    @F.pandas_udf("long")
    def of_range(values: pd.Series) -> pd.Series:
        return pd.Series(place(values))

    ends = keys.select("key", of_range("key").alias("at")).groupBy("at").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("at").collect()  # a row for each range
    beside: dict[str, list[int]] = {}
    for a, b in zip(ends, ends[1:], strict=False):
        beside.setdefault(a["hi"], []).append(b["at"])
        beside.setdefault(b["lo"], []).append(a["at"])

    @F.pandas_udf("array<bigint>")
    def dealt(values: pd.Series) -> pd.Series:
        return pd.Series([[int(at), *beside.get(k, ())] for k, at in zip(values, place(values), strict=True)])

    spread = rows.withColumn("to", dealt("key")).select("*", F.posexplode("to").alias("nth", "at")).withColumn("own", F.col("nth") == 0).drop("to", "nth")
    ordered = (spread.repartition(partitions, "at") if partitions > usual else spread.repartition("at")).sortWithinPartitions("at", "key")
    found = ordered.select("page_id", "url", "host", "path", "html", "at", "own").mapInPandas(_extract, RESULT)
    return found.select(F.col("page_id").alias(page_id), F.col("url").alias(url), "text", "n_chars", "n_shared", "n_named", "n_settled")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kadastra.llm.common import table

    return extract(table(spark, sf_dir, "pages"))
