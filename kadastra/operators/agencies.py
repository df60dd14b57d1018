"""Agencies: counts, towns, fuzzy matching of names, catalogue merge, contacts with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import fuzzy, text


def recount(df: DataFrame) -> DataFrame:
    """Active listings per agency, and its modal town where that leads strictly."""
    by_city = df.where((F.col("status") == "aktywna") & F.col("agency_id").isNotNull()).groupBy("agency_id", "city").agg(F.count("*").alias("c"))
    w = Window.partitionBy("agency_id").orderBy(F.desc("c"), "city")
    ranked = by_city.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("c").over(w))
    leads = F.when((F.col("r") == 1) & (F.col("next").isNull() | (F.col("c") > F.col("next"))), F.col("city"))
    return ranked.groupBy("agency_id").agg(F.sum("c").alias("listings"), F.max(leads).alias("modal_city"))


#: A word in over one of so many names counts as common; so there are fewer common words than this for each word of a name.
COMMON_SHARE = 1000


def _keys(names: DataFrame, common: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """(name, kind, key, place, rare, size) of different names in words of a-z and 0-9: what a name can be found by.

    Kind "w": its different words, rarest first; ``rare`` are the first ones, which together are longer than what may lack if a name
    is covered by shared words to the extent that ``least`` asks for. Kind "g": pairs of neighbouring letters, the n-th of its kind
    in ``place``, rarest first, and only so many that two names alike to that extent share one of them.
    """
    words = F.array_distinct(F.filter(F.split("name", " "), lambda w: w != ""))
    rows = names.withColumn("words", words).where(F.size("words") > 0).withColumn("size", F.length(F.array_join("words", " ")))
    each = rows.select("name", "size", F.explode("words").alias("key")).join(F.broadcast(common), "key", "left")
    before = F.sum(F.length("key") + 1).over(Window.partitionBy("name").orderBy(F.coalesce("n", F.lit(0)), -F.length("key"), "key").rowsBetween(Window.unboundedPreceding, -1))
    lacking = F.col("size") * ((2 - 2 * least) / (2 - least)) + 1e-6
    by_word = each.select("name", F.lit("w").alias("kind"), "key", F.lit(0).alias("place"), (F.coalesce(before, F.lit(0)) <= lacking).alias("rare"), "size")
    held = rows.select("name", "size", F.explode(_grams(F.col("words"))).alias("key")).groupBy("name", "size", "key").agg(F.count("*").cast("int").alias("times"))
    placed = held.join(F.broadcast(grams), "key", "left").select("name", "size", "key", "n", F.explode(F.sequence(F.lit(1), "times")).alias("place"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.coalesce("n", F.lit(0)), "key", "place"))
    # Of two names alike to the extent t, the shorter has at least t / (2 - t) of the other's letters. What the longer one lacks are
    # deleted letters, each in two pairs.
    apart = F.col("size") * ((2 - 1.5 * least) + (1 - 1.5 * least) * least / (2 - least)) + 1e-6
    by_gram = placed.withColumn("rank", rank).where(F.col("rank") <= F.floor(apart) + 1).select("name", F.lit("g").alias("kind"), "key", "place", F.lit(True).alias("rare"), "size")
    return by_word.unionByName(by_gram)


def _grams(words: Column) -> Column:
    """Pairs of neighbouring letters of each word, and its first and last letter with a space; they do not depend on the order of words."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(2)))
    return F.flatten(F.transform(words, of))


def _sides(left: DataFrame, right: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``left`` and ``right`` (block, name) with what their names can be found by."""
    known = right.select("name").distinct()
    words = known.select(F.explode(F.array_distinct(F.split("name", " "))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    common = words.where(F.col("n") * COMMON_SHARE > known.count())
    grams = known.select(F.explode(_grams(F.array_distinct(F.split("name", " ")))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    mine = left.join(_keys(left.select("name").distinct(), common, grams, least), "name")
    return mine, right.join(_keys(known, common, grams, least), "name").withColumnsRenamed({"name": "other", "rare": "other_rare", "size": "other_size"})


def _by_words(mine: DataFrame, theirs: DataFrame) -> list[DataFrame]:
    """Names that share a word that is rare for one of them; if all words of a name are in another one, its rarest is among these."""
    on = ["block", "kind", "key", "place"]
    return [
        mine.where("kind = 'w' and rare").join(theirs.where("kind = 'w'"), on),
        mine.where("kind = 'w' and not rare").join(theirs.where("kind = 'w' and other_rare"), on),
    ]


def covered(left: DataFrame, right: DataFrame, least: float = C.AGENCY_MATCH / 100) -> DataFrame:
    """(block, name, other): the pairs of names of one block in which one has all words of the other. Just these have the ratio 100."""
    pairs = [m.select("block", "name", "other") for m in _by_words(*_sides(left, right, least))]
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    held = (F.size(F.array_except(words("name"), words("other"))) == 0) | (F.size(F.array_except(words("other"), words("name"))) == 0)
    return pairs[0].union(pairs[1]).where(held).distinct()


def candidates(left: DataFrame, right: DataFrame, least: float = C.AGENCY_MATCH / 100) -> DataFrame:
    """(block, name, other): pairs of names of one block that may be alike to the extent ``least`` (0 to 1, over 2/3), by the best ratio
    of their sets of words; none that is alike is left out. ``left`` and ``right`` are different (block, name).

    Names are alike because shared words cover nearly the whole of one, so one of its rarest words is shared; or because they are
    nearly the same letters, so one of the rarest pairs of letters of either is shared and the lengths are near. Words that half
    a town's names have bring two names together only where a name has no others.
    """
    mine, theirs = _sides(left, right, least)
    on = ["block", "kind", "key", "place"]
    near = F.greatest("size", "other_size") * (least / (2 - least)) <= F.least("size", "other_size") + 1e-6
    met = [*_by_words(mine, theirs), mine.where("kind = 'g'").join(theirs.where("kind = 'g'"), on).where(near)]
    pairs = [m.select("block", "name", "other") for m in met]
    return pairs[0].union(pairs[1]).union(pairs[2]).distinct()


def blocks(name: Column, city: Column) -> Column:
    """Where names may meet: the first four letters, and the town."""
    return F.explode(F.array_compact(F.array(F.concat(F.lit("n|"), F.substring(name, 1, 4)), F.concat(F.lit("c|"), text.fold(city)))))


def match(names: DataFrame, agencies: DataFrame) -> DataFrame:
    """(name, city) rows with the agency they mean: by equal slug, else the best fuzzy match among agencies of the same
    town or with the same first four letters, at AGENCY_MATCH or more (of equal ones the smallest id). Within a block names meet by
    ``candidates``, so neither a town nor a common word makes all pairs; agencies of one name in a block count once."""
    asked = names.select("name", "city").distinct().withColumn("slug", text.slug(F.concat_ws("-", "name", F.coalesce("city", F.lit("")))))
    known = agencies.select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"), F.col("city").alias("agency_city"), "slug")
    exact = asked.join(known, "slug").select("name", "city", "agency_id", F.lit(100.0).alias("score"))
    key = text.norm_key(F.col("name"))
    rest = asked.join(known.select("slug"), "slug", "left_anti").select("name", "city", key.alias("norm"), blocks(key, F.col("city")).alias("block"))
    agency = text.norm_key(F.col("agency_name"))
    there = known.select("agency_id", agency.alias("other"), blocks(agency, F.col("agency_city")).alias("block")).groupBy("block", "other").agg(F.min("agency_id").alias("agency_id"))
    wanted, others = rest.select("block", F.col("norm").alias("name")).distinct(), there.select("block", F.col("other").alias("name"))
    # No ratio is over 100, so names that reach it in a block are compared no further; others of 100 would be covered as well.
    full = covered(wanted, others).select("block", F.col("name").alias("norm"), "other", F.lit(100.0).alias("score"))
    sure = rest.join(full.select("block", "norm").distinct(), ["block", "norm"]).select(F.col("name").alias("sure_name"), F.col("city").alias("sure_city")).distinct()
    unsure = rest.join(sure, F.col("name").eqNullSafe(F.col("sure_name")) & F.col("city").eqNullSafe(F.col("sure_city")), "left_anti")
    left = unsure.select("block", F.col("norm").alias("name")).distinct()
    met = candidates(left, others)
    # Pairs are few bytes and much work, so their partitions are not to be made fewer by size.
    spread = met.select(F.col("name").alias("norm"), "other", "block").repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = spread.withColumn("score", fuzzy.similarity(F.col("norm"), F.col("other"))).where(F.col("score") >= C.AGENCY_MATCH)
    first = F.max(F.struct("score", (-F.col("agency_id")).alias("minus")))
    best = full.unionByName(scored.select(full.columns)).join(there, ["block", "other"]).groupBy("block", "norm").agg(first.alias("best"))
    found = rest.join(best, ["block", "norm"]).groupBy("name", "city").agg(F.max("best").alias("best")).select("name", "city", (-F.col("best.minus")).alias("agency_id"), F.col("best.score").alias("score"))
    return exact.unionByName(found)


def networks(names: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Names with the franchise whose alias they contain; the first one that fits."""
    key, chain = text.norm_key(F.col("name")), None
    for network, known in aliases.items():
        for alias in (network, *known):
            chain = (F if chain is None else chain).when(F.contains(key, text.norm_key(F.lit(alias))), network)
    return names.withColumn("network", chain if chain is not None else F.lit(None).cast("string"))


def merge_catalogue(known: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Agencies after a catalogue: its values win over guesses, its rows are verified, phones are united (ten at most)."""
    b = catalogue.select("slug", *(F.col(c).alias(f"b_{c}") for c in ("name", "city", "phones", "expected")))
    joined = known.join(b, "slug", "full_outer")
    phones = F.slice(F.array_sort(F.array_union(F.coalesce("phones", F.array().cast("array<string>")), F.coalesce("b_phones", F.array().cast("array<string>")))), 1, C.PHONE_LIMIT)
    return joined.select("slug", *(F.coalesce(f"b_{c}", c).alias(c) for c in ("name", "city", "expected")), phones.alias("phones"), (F.coalesce("verified", F.lit(False)) | F.col("b_name").isNotNull()).alias("verified"))


def listed(agencies: DataFrame, name: str = "", city: str = "", voivodeship: str = "", with_offers: bool = False, page: int = 1, per_page: int = 100) -> DataFrame:
    """A page of agencies: names and towns that hold what is asked, those with most listings first, then those that should have."""
    rows = agencies
    for column, asked in (("name", name), ("city", city)):
        if asked.strip():
            rows = rows.where(F.contains(F.lower(column), F.lower(F.lit(asked.strip()))))
    rows = rows.where(F.col("voivodeship") == voivodeship) if voivodeship else rows
    rows = rows.where(F.col("listings") > 0) if with_offers else rows
    return rows.orderBy(F.col("listings").desc_nulls_last(), F.col("expected").desc_nulls_last(), "name", "id").offset((max(1, page) - 1) * per_page).limit(per_page)


def coverage(agencies: DataFrame, counts: DataFrame) -> DataFrame:
    """Declared against collected offers."""
    return agencies.join(counts, agencies["id"] == counts["agency_id"], "left").select("id", "expected", F.coalesce("listings", F.lit(0)).alias("listings"), F.greatest(F.lit(0), F.col("expected") - F.coalesce("listings", F.lit(0))).alias("missing"))


def contacts(df: DataFrame, phones: DataFrame, agency_phones: DataFrame) -> DataFrame:
    """Numbers of each listing with where they come from: its own, else up to two of its agency; those of its twins only if
    there are none (eight twins at most)."""
    own = df.select("id").join(phones, F.col("id") == F.col("listing_id")).select("id", "number", F.lit(1).alias("rank"), F.lit("listing").alias("origin"))
    w = Window.partitionBy("agency_id").orderBy("number")
    top = agency_phones.withColumn("n", F.row_number().over(w)).where(F.col("n") <= C.CONTACT_AGENCY_PHONES).drop("n")
    agency = df.join(top, "agency_id").select("id", "number", F.lit(2).alias("rank"), F.lit("agency").alias("origin"))
    some = own.unionByName(agency)
    root = F.coalesce("duplicate_of_id", "id")
    bare = df.join(some.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("for_id"), root.alias("root"))
    group = df.select("id", root.alias("root")).join(bare.select("root").distinct(), "root", "left_semi")
    w = Window.partitionBy("root").orderBy("id")
    twins = group.withColumn("n", F.row_number().over(w)).where(F.col("n") <= C.CONTACT_TWINS)
    found = bare.join(twins, "root").where("for_id <> id").join(phones, F.col("id") == F.col("listing_id")).select(F.col("for_id").alias("id"), "number", F.lit(3).alias("rank"), F.lit("twin").alias("origin"))
    both = some.unionByName(found)
    return both.groupBy("id", "number").agg(F.min(F.struct("rank", "origin")).alias("best")).select("id", "number", "best.rank", "best.origin")
