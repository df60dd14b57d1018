"""Duplicate listings across sources: fingerprints, blocking keys, pair verdicts, groups, originals.

A pair can only match through an equal case number, shingle or fingerprint, or through an equal phone with similar
areas. Each way becomes a key that holds all its exact conditions (also kind, type and transaction; for phones a
bucket of the area, and the next one), so the join is an equi-join on narrow keys and never a disjunction. Listings alike in
all that decides are one class and make no pairs among themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import fuzzy, text
from kadastra.operators.graph import connected_components
from kadastra.operators.skew import join_groups

#: Columns that verdicts look at; missing ones count as null.
COLUMNS = {
    "id": "long", "source_key": "string", "kind": "string", "transaction": "string", "property_type": "string", "title": "string",
    "description": "string", "city": "string", "street": "string", "area": "double", "rooms": "int", "floor": "int", "price": "double",
    "case_number": "string", "opening_price": "double", "event_date": "timestamp", "phone_fingerprint": "string",
    "first_seen": "timestamp", "published": "timestamp", "seller_type": "string",
}
UNIT_NUMBER = r"(?iU)\b(?:nr|lok\.?|lokal|mieszkanie nr|apartament nr|M)\s*(\d{1,4})\b"


def python_number(value: Column) -> Column:
    """A rounded double as Python prints it: 49.0, 49.5."""
    tenths = F.round(value * 10).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def fingerprints(df: DataFrame) -> DataFrame:
    """Listings with fingerprint (place, area, rooms, type, transaction) and text_shingle."""
    rows = df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items() if c not in df.columns))
    made = text.digest(text.norm_key(F.col("city")), python_number(F.col("area")), F.coalesce(F.col("rooms").cast("string"), F.lit("")), F.col("property_type"), F.col("transaction"))
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("description", F.lit("")), 1, 2500))
    return rows.withColumn("fingerprint", F.when(F.col("area").isNotNull() & F.col("city").isNotNull(), made)).withColumn("text_shingle", text.shingle_hash(body))


def _price_gap(x: Column, y: Column) -> Column:
    return F.when((x > 0) & (y > 0), F.abs(x - y) / F.greatest(x, y))


def _differ(x: Column, y: Column) -> Column:
    """Both known and different."""
    return F.coalesce(x != y, F.lit(False))


#: What verdicts look at; listings alike in these are one class.
JUDGED = tuple(c for c in (*COLUMNS, "fingerprint", "text_shingle") if c not in ("id", "first_seen", "published", "seller_type"))


def keys() -> Column:
    """The blocking keys of a listing."""
    same = lambda name, *parts: F.when(F.concat(*parts).isNotNull(), F.concat_ws("|", F.lit(name), *parts))
    base = [F.coalesce(c, F.lit("")) for c in ("kind", "property_type", "transaction")]
    bucket = F.floor(F.col("area") / C.AREA_TOLERANCE).cast("long")
    found = F.array(
        same("case", "case_number", *base),
        same("text", "text_shingle", *base),
        same("print", "fingerprint", *base),
        same("phone", "phone_fingerprint", bucket.cast("string"), *base),
        same("phone", "phone_fingerprint", (bucket + 1).cast("string"), *base),
    )
    return F.array_distinct(F.filter(found, lambda k: k.isNotNull()))


#: Groups of one cell, about, that one task compares with as many others.
BLOCK = 4096
#: Keys that are broadcast at most.
SMALL = 1_000_000
#: Prices further apart than this on the logarithmic scale exclude a pair.
PRICE_BAND = -math.log(1 - C.PRICE_SPREAD) * 1.000001
#: Cell of listings without a price: they meet all others of their key.
ANY = -(1 << 40)


def units(df: DataFrame) -> DataFrame:
    """Listings that may have copies, with ``class`` (a hash of all that verdicts look at), ``stretch`` of time and ``unit``, a hash of
    both. Listings of one unit get the same verdict with any other and lie within the window of each other."""
    stretch = F.floor(F.datediff("first_seen", F.lit("2000-01-01")) / C.DEDUP_WINDOW_DAYS)
    rows = df.where(F.col("kind") != "przetarg").withColumn("class", F.xxhash64(*(x for c in JUDGED for x in (F.col(c), F.col(c).isNull()))))
    return rows.withColumn("stretch", stretch).withColumn("unit", F.xxhash64("class", F.coalesce("stretch", F.lit(-1 << 40))))


def _cells(stands: DataFrame, save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparison under a key: listings meet in cells of prices two PRICE_BAND wide, each with its own and, if it
    is near enough to it, the next one, those without a price with all. Large cells are dealt to a grid of blocks (i, j) that meet one by one."""
    auction, at = F.coalesce(F.col("told.auction"), F.lit(False)), F.log(F.col("told.price")) / (2 * PRICE_BAND)
    own = F.when(auction, 0).when(F.col("told.price") > 0, F.floor(at)).otherwise(ANY).cast("long")
    placed = stands.withColumn("own", own)
    alone = auction | (F.col("own") == ANY)
    left = placed.withColumn("cell", F.explode(F.when(alone | (at - F.floor(at) < 0.4999), F.array("own")).otherwise(F.array(F.col("own"), F.col("own") + 1))))
    priceless = save(placed.where(F.col("own") == ANY).select("key").distinct())  # only under these keys the others have to meet ANY
    right, few = placed.withColumn("cell", F.col("own")), priceless.limit(SMALL + 1).count()
    if few:
        under = placed.where(~alone).join(F.broadcast(priceless) if few <= SMALL else priceless, "key", "left_semi")
        right = right.unionByName(under.withColumn("cell", F.lit(ANY).cast("long")))
    sizes = left.groupBy("key", "cell").agg(F.count("*").alias("n")).join(right.groupBy("key", "cell").agg(F.count("*").alias("m")), ["key", "cell"])
    sizes = sizes.select("key", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / BLOCK).cast("int").alias("columns")).where("rows > 1 or columns > 1")
    sizes = F.broadcast(save(sizes))  # few: a BLOCK of listings each

    def dealt(side: DataFrame, mine: str, other: str, at: tuple[str, str]) -> DataFrame:
        found = side.join(sizes, ["key", "cell"], "left").withColumn(at[0], F.pmod(F.xxhash64("unit", "id"), F.coalesce(mine, F.lit(1))).cast("int"))
        return found.withColumn(at[1], F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("rows", "columns")

    return dealt(left, "rows", "columns", ("i", "j")), dealt(right, "columns", "rows", ("j", "i"))


def _told(of: Callable[[str], Column]) -> Column:
    """What verdicts look at of a listing, read once for each listing and not for each pair. Texts that are only told from others are
    hashes; of its description the length."""
    hashed = {c: of(c) for c in ("source_key", "city", "case_number", "phone_fingerprint", "fingerprint", "text_shingle")} | {"street": F.nullif(text.norm_key(of("street")), F.lit(""))}
    number = F.nullif(F.regexp_extract(F.coalesce(of("title"), F.lit("")), UNIT_NUMBER, 1), F.lit(""))
    return F.struct(
        *(of(c).alias(c) for c in ("id", "floor", "price", "area", "opening_price", "event_date")), *(F.when(v.isNotNull(), F.xxhash64(v)).alias(c) for c, v in hashed.items()),
        (of("kind") == "licytacja").alias("auction"), of("street").isNotNull().alias("on_street"), F.when(number.isNotNull(), F.xxhash64(number)).alias("number"), F.length(of("description")).alias("length"),
    )


def _start(description: Column) -> Column:
    return text.norm_key(F.substring(description, 1, 1500))


def _compatible(A: Callable[[str], Column], B: Callable[[str], Column]) -> Column:
    """Nothing known of two offers excludes that they are one."""
    gap = _price_gap(A("price"), B("price"))
    differ = _differ(A("street"), B("street")) | _differ(A("number"), B("number")) | _differ(A("floor"), B("floor")) | F.coalesce(gap > C.PRICE_SPREAD, F.lit(False))
    return ~(differ | ((A("source_key") == B("source_key")) & F.coalesce(gap.isNotNull() & (F.abs(A("price") - B("price")) > 1.0), F.lit(False))))


def _met(df: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of what is told of listings, a older by id, that share a key, lie within the window and do not exclude each other;
    each pair once.

    Under a key the listings of a class and a stretch of time of the window's length are paired with the first of them only, and
    classes and stretches meet by their first and last listings, which are the nearest to all that lies outside. So groups come
    out as from all pairs, and copies make no pairs among themselves. Different listings under one key (the flats of one agency)
    meet in cells of like prices, dealt to blocks where a cell is large, and a pair with another street, unit, floor or price is
    never made. Listings of a class have the same keys, and a pair counts under the first key that both have.
    """
    hashes = F.array_sort(F.transform(keys(), lambda k: F.xxhash64(k)))
    rows = units(df)
    ends = save(rows.select("id", "first_seen", "unit", _told(F.col).alias("told"), hashes.alias("keys")).where("size(keys) > 0").groupBy("unit").agg(F.first("told").alias("told"), F.first("keys").alias("keys"), F.min(F.struct("first_seen", "id")).alias("lo"), F.max(F.struct("first_seen", "id")).alias("hi"), F.count("*").alias("n")))  # told is alike within a unit
    several = ends.where("n > 1").select("unit", "told", F.col("lo.id").alias("first_id"), "n")
    one = lambda id_: F.col("told").withField("id", id_)
    stars = join_groups(rows.select("id", "unit"), several, "unit", "n").where("id <> first_id").select(one(F.least("id", "first_id")).alias("a"), one(F.greatest("id", "first_id")).alias("b"))
    stands = ends.withColumn("at", F.explode(F.array_distinct(F.array("lo", "hi")))).select("unit", "at.id", "at.first_seen", one(F.col("at.id")).alias("told"), "keys", F.explode("keys").alias("key"))
    meet = ["key", "cell", "i", "j"]
    a, b = (side.select(*meet, *(F.col(c).alias(f"{name}_{c}") for c in side.columns if c not in meet)) for name, side in zip("ab", _cells(stands, save), strict=True))
    near = F.coalesce(F.abs(F.datediff("a_first_seen", "b_first_seen")) <= C.DEDUP_WINDOW_DAYS, F.lit(True))
    A, B = (lambda c: F.col(f"a_told.{c}")), (lambda c: F.col(f"b_told.{c}"))
    once = F.when(F.col("a_own") == F.col("b_own"), F.col("a_unit") < F.col("b_unit")).otherwise(F.lit(True)) & (F.col("a_id") != F.col("b_id"))
    once = once & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key"))
    fits = A("auction") | F.coalesce(_compatible(A, B), F.lit(True))
    older = F.col("a_id") < F.col("b_id")
    across = a.join(b, meet).where(once & near & fits)
    across = across.select(F.when(older, F.col("a_told")).otherwise(F.col("b_told")).alias("a"), F.when(older, F.col("b_told")).otherwise(F.col("a_told")).alias("b"))
    return stars.unionByName(across)


def candidate_pairs(df: DataFrame, save: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The pairs of ``_met`` with all their columns, which are fetched for the pairs that are left."""
    row = lambda side: df.select(F.col("id").alias(f"{side}_id"), F.struct(*(F.col(c) for c in (*COLUMNS, "fingerprint", "text_shingle"))).alias(side))
    pairs = _met(df, save).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    return pairs.join(row("a"), "a_id").join(row("b"), "b_id").select("a", "b")


def _judged(pairs: DataFrame, *more: str) -> DataFrame:
    """Pairs of what is told, with columns ``more``: a_id, b_id, method and score where these are sure; else ``by``, what has to be
    compared, and ``bodies``, whether descriptions are. Pairs that can be no link are left out."""
    A, B = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    auction = A("auction")
    same_auction = F.when(A("case_number").isNotNull() & B("case_number").isNotNull(), A("case_number") == B("case_number")).otherwise(
        F.coalesce((F.abs(A("opening_price") - B("opening_price")) < 1.0) & (A("event_date") == B("event_date")), F.lit(False))
    )
    gap = _price_gap(A("price"), B("price"))
    similar_area = F.coalesce((A("area") > 0) & (B("area") > 0) & (F.abs(A("area") - B("area")) <= C.AREA_TOLERANCE), F.lit(False))
    equal = lambda c: F.coalesce(A(c) == B(c), F.lit(False))
    known = (
        F.when(auction, F.when(same_auction, F.struct(F.lit("licytacja").alias("method"), F.lit(0.95).alias("score"))))
        .when(equal("phone_fingerprint") & similar_area, F.struct(F.lit("phone").alias("method"), F.lit(0.97).alias("score")))
        .when(equal("text_shingle"), F.struct(F.lit("text").alias("method"), F.lit(0.9).alias("score")))
        .when(equal("fingerprint") & A("on_street") & B("on_street"), F.struct(F.lit("fingerprint").alias("method"), F.lit(0.93).alias("score")))
    )
    corroborated = F.coalesce(gap <= C.PRICE_CORROBORATES, F.lit(True))
    by = F.when(~auction & F.col("known").isNull(), F.when(equal("fingerprint"), F.when(corroborated, F.lit("fingerprint"))).when(similar_area & equal("city"), F.lit("text")))
    least = F.when(F.col("by") == "fingerprint", C.MIN_DESCRIPTION).otherwise(1)
    long_enough = F.coalesce((A("length") >= least) & (B("length") >= least), F.lit(False))
    out = pairs.where(auction | _compatible(A, B)).withColumn("known", known).withColumn("by", by).where("known is not null or by is not null")
    return out.select(A("id").alias("a_id"), B("id").alias("b_id"), "known.method", "known.score", "by", (F.col("by").isNotNull() & long_enough).alias("bodies"), *more)


def _compared(open_: DataFrame) -> DataFrame:
    """Links among pairs (a_id, b_id, by, titles, bodies, a_body, b_body) by fuzzy ratios, which run only where they are needed."""
    left, right = (F.when(F.col("bodies"), F.col(f"{s}_body")).otherwise(F.col(f"{s}_title")) for s in "ab")
    by_print = open_.where("by = 'fingerprint'").where((F.length(left) > 0) & (F.length(right) > 0)).withColumn("similar", fuzzy.similarity(left, right))
    by_print = by_print.where(F.col("similar") >= C.CORROBORATION_LIMIT).select("a_id", "b_id", F.lit("fingerprint").alias("method"), F.round(F.least(F.lit(0.92), F.col("similar") / 100), 2).alias("score"))
    by_text = open_.where("by = 'text'").withColumn("title_score", fuzzy.similarity(F.col("a_title"), F.col("b_title"))).where(F.col("title_score") >= C.TEXT_LIMIT)
    by_text = by_text.withColumn("body_score", F.when(F.col("bodies"), fuzzy.similarity(F.col("a_body"), F.col("b_body"))).otherwise(100.0)).where(F.col("body_score") >= C.DESCRIPTION_LIMIT)
    by_text = by_text.select("a_id", "b_id", F.lit("text").alias("method"), F.round(F.least("title_score", "body_score") / 100, 2).alias("score"))
    return by_print.unionByName(by_text)


def verdicts(pairs: DataFrame) -> DataFrame:
    """Links (original side undecided) among pairs of whole listings: a_id, b_id, method, score."""
    told = pairs.select(*(_told(lambda c, s=s: F.col(f"{s}.{c}")).alias(s) for s in "ab"), *(F.struct(f"{s}.title", f"{s}.description").alias(f"{s}_text") for s in "ab"))
    judged = _judged(told, "a_text", "b_text").withColumns({f"{s}_{name}": read(F.col(f"{s}_text.{of}")) for s in "ab" for name, of, read in (("title", "title", text.norm_key), ("body", "description", _start))})
    return judged.where("method is not null").select("a_id", "b_id", "method", "score").unionByName(_compared(judged.where("by is not null")))


def links(df: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ``verdicts`` on ``candidate_pairs`` of listings, in a few steps between which ``save`` cuts lineage: pairs are judged
    where they meet, and only those whose texts have to be compared fetch these."""
    judged = save(_judged(_met(df, save)))
    sure, open_ = judged.where("method is not null").select("a_id", "b_id", "method", "score"), judged.where("by is not null").drop("method", "score")
    texts = lambda s: df.select(F.col("id").alias(f"{s}_id"), text.norm_key(F.col("title")).alias(f"{s}_title"), _start(F.col("description")).alias(f"{s}_body"))
    return sure.unionByName(_compared(open_.join(texts("a"), "a_id").join(texts("b"), "b_id")))


def _rank() -> Column:
    """The order in which listings are originals: the earlier offer, of equally early ones a private or institutional seller before
    a developer, and that before others; then the smaller id."""
    seller = F.when(F.col("seller_type").isin("prywatna", "komornik", "syndyk", "urzad"), 0).when(F.col("seller_type") == "deweloper", 1).otherwise(2)
    return F.struct(F.coalesce("published", "first_seen").alias("since"), seller.alias("rank"), F.col("id"))


def originals(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of a graph of (u, v), u before v: the nodes ``u`` that no earlier original matches, by walking through the nodes in their order.

    Done in rounds: a node without an undecided earlier neighbour is an original, its neighbours are not, and both leave the
    graph. Nodes that are left without an edge are originals; only such with an edge in ``edges`` are returned.
    """
    nodes = save(edges.select(F.explode(F.array("u", "v")).alias("u")).distinct())
    now, gone = save(edges.select("u", "v")), None
    while not now.isEmpty():
        first = save(now.groupBy("u").agg(F.count("*").alias("n")).join(now.select(F.col("v").alias("u")).distinct(), "u", "left_anti"))
        copies = save(join_groups(now, first, "u", "n").select("v").distinct())
        gone = copies if gone is None else save(gone.unionByName(copies))
        left = now.join(first.select("u"), "u", "left_anti").join(copies, "v", "left_anti")
        now = save(left.join(copies.select(F.col("v").alias("u")), "u", "left_anti").select("u", "v"))
    return nodes if gone is None else nodes.join(gone.withColumnRenamed("v", "u"), "u", "left_anti")


def strict_groups(df: DataFrame, links: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every listing with is_original, duplicate_of_id, copies_count, and the method and score of its own link to its original.

    Unlike in ``groups``, a copy matches its original itself, not by way of others: listings are walked through from the
    earliest on, one that matches an earlier original is its copy, else an original; of several originals that with
    the highest score counts, of these the earliest. Listings of one unit (alike in all that decides, within the window)
    are decided as one, by their earliest; those that lie outside the window of the original found are a group of their own.
    """
    window = C.DEDUP_WINDOW_DAYS
    rows = save(units(df).select("id", "unit", "first_seen", _rank().alias("order")))
    unit = save(rows.groupBy("unit").agg(F.min(F.struct("order", "first_seen")).alias("first"), F.count("*").alias("n")).select("unit", "first.order", F.col("first.first_seen").alias("since"), "n"))
    of = lambda side: rows.select(F.col("id").alias(f"{side}_id"), F.col("unit").alias(f"{side}_unit"))
    linked = save(links.join(of("a"), "a_id").join(of("b"), "b_id").groupBy("a_unit", "b_unit").agg(F.max(F.struct("score", F.col("method"))).alias("by")))
    within = linked.where("a_unit = b_unit").select(F.col("a_unit").alias("unit"), F.col("by").alias("own_by"))
    heads = unit.select(F.col("unit"), "order", "since")
    x, y = (heads.select(*(F.col(c).alias(f"{side}_{c}") for c in heads.columns)) for side in "ab")
    pairs = linked.where("a_unit <> b_unit").join(x, "a_unit").join(y, "b_unit").where(F.coalesce(F.abs(F.datediff("a_since", "b_since")) <= window, F.lit(True)))
    first = F.col("a_order") < F.col("b_order")
    side = lambda c, yes: F.when(first if yes else ~first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    edges = save(pairs.select(side("unit", True).alias("u"), side("unit", False).alias("v"), side("order", True).alias("before"), side("since", True).alias("since"), "by").groupBy("u", "v").agg(F.max("by").alias("by"), F.first("before").alias("before"), F.first("since").alias("since")))
    kept = originals(edges, save)
    best = F.max_by(F.struct("u", "before", "since", "by"), F.struct(F.col("by.score"), -F.unix_micros("before.since"), -F.col("before.rank"), -F.col("before.id")))
    chosen = edges.join(kept, "u").groupBy("v").agg(best.alias("best")).select(F.col("v").alias("unit"), F.col("best.before.id").alias("to"), F.col("best.since").alias("to_since"), "best.by")

    members = join_groups(rows, unit.select("unit", F.col("order.id").alias("head"), "n"), "unit", "n")
    marked = members.join(chosen, "unit", "left").join(within, "unit", "left")
    near = F.col("to").isNotNull() & F.coalesce(F.abs(F.datediff("first_seen", "to_since")) <= window, F.lit(True))
    marked = save(marked.withColumn("near", near))
    # what is too far from the original of its unit, and units without one, keep together where the unit's listings match
    rest = marked.where(~F.col("near") & F.col("own_by").isNotNull()).groupBy("unit").agg(F.min("order").alias("top"))
    marked = marked.join(rest, "unit", "left")
    target = F.when(F.col("near"), F.col("to")).when(F.col("top.id") != F.col("id"), F.col("top.id"))
    link = F.when(F.col("near"), F.col("by")).when(F.col("top.id") != F.col("id"), F.col("own_by"))
    decided = save(marked.select("id", target.alias("duplicate_of_id"), link.alias("link")))
    counts = decided.where("duplicate_of_id is not null").groupBy(F.col("duplicate_of_id").alias("id")).agg(F.count("*").alias("copies"))
    out = df.join(decided, "id", "left") if "duplicate_of_id" not in df.columns else df.drop("duplicate_of_id").join(decided, "id", "left")
    out = out.join(counts, "id", "left")
    columns = [F.col(c) for c in df.columns if c not in ("is_original", "duplicate_of_id", "copies_count", "method", "score")]
    return out.select(*columns, F.col("duplicate_of_id").isNull().alias("is_original"), "duplicate_of_id", F.coalesce("copies", F.lit(0)).alias("copies_count"), F.col("link.method").alias("method"), F.col("link.score").alias("score"))


def groups(df: DataFrame, links: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every listing with its group's original (the first by ``_rank``) and copies_count."""
    parts = connected_components(links.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), save)
    marked = df.join(parts, df["id"] == parts["node"], "left").withColumn("group_id", F.coalesce("component", "id"))
    found = marked.groupBy("group_id").agg(F.min(_rank()).alias("first"), (F.count("*") - 1).alias("copies"))
    joined = marked.join(found, "group_id")
    own = F.col("first.id") == F.col("id")
    return joined.select(*(df[c] for c in df.columns if c not in ("is_original", "duplicate_of_id", "copies_count")), own.alias("is_original"), F.when(~own, F.col("first.id")).alias("duplicate_of_id"), F.when(own, F.col("copies")).otherwise(0).alias("copies_count"))


def copies(df: DataFrame) -> DataFrame:
    """Copies of each original, from the listings' own links."""
    links = df.where("duplicate_of_id is not null").select(F.col("duplicate_of_id").alias("original_id"), F.col("id").alias("copy_id"))
    return links.join(df.select(F.col("id").alias("original_id")), "original_id").groupBy("original_id").agg(F.count("*").alias("copies"))


def dangling(df: DataFrame) -> DataFrame:
    """Links to an original that is gone."""
    links = df.where("duplicate_of_id is not null").select("id", F.col("duplicate_of_id").alias("original_id"))
    return links.join(df.select(F.col("id").alias("original_id")), "original_id", "left_anti")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (a repeated page of a crawl brings nothing new)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
