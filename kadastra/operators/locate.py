"""Place names in text, and where an offer lies.

The registry of units is an index over the stems of their names' words: a stem is what all cases of a Polish noun or adjective
share. A text becomes rows of its capitalised or cued words with the stems that follow; these meet the index in an equi-join
on the first stem, and scores are columns. Python cuts texts to words only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import text
from kadastra.functions.text import ACCENTED, PLAIN
from kadastra.operators import places

#: Words of the longest name.
LONGEST_NAME = 4
#: Endings of nouns and adjectives, longest first, and consonants that change before them.
ENDINGS = ("iego", "iemu", "iami", "iach", "ego", "emu", "iej", "ami", "ach", "ich", "ych", "iem", "ia", "ie", "iu", "ej", "em", "im", "ym", "om", "a", "e", "i", "o", "u", "y")
CHANGED = (("dz", "d"), ("rz", "r"), ("c", "t"))

_FOLD = str.maketrans(ACCENTED, PLAIN)
_WORD = re.compile(r"[^\W_]+")
_CUES = {"place_cue": re.compile(C.PLACE_CUE), "commune_cue": re.compile(C.COMMUNE_CUE), "county_cue": re.compile(C.COUNTY_CUE)}


def folded(word: str) -> str:
    return word.translate(_FOLD).lower()


def stem(word: str) -> str:
    """What the cases of a folded word share; words of up to three letters are left as they are."""
    if len(word) <= 3:
        return word
    for ending in ENDINGS:
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            word = word[: -len(ending)]
            break
    for changed, plain in CHANGED:
        if word.endswith(changed):
            return word[: -len(changed)] + plain
    return word


def name_stems(name: Column) -> Column:
    """The folded words of a name, and their stems."""

    @F.pandas_udf("struct<forms:array<string>,stems:array<string>>")
    def of(names: pd.Series) -> pd.DataFrame:
        forms = [[folded(w) for w in _WORD.findall(n or "")] for n in names]
        return pd.DataFrame({"forms": forms, "stems": [[stem(w) for w in f] for f in forms]})

    return of(name)


def index(units: DataFrame) -> DataFrame:
    """Units by the stems of their names; names of one or two letters are in no index."""
    rows = places.known(units).withColumn("s", name_stems(F.col("unit_name"))).select("*", "s.forms", "s.stems").drop("s", "unit_key")
    rows = rows.where((F.length("unit_name") > 2) & F.size("stems").between(1, LONGEST_NAME))
    plain = F.array(*(F.lit(folded(n)) for n in C.AMBIGUOUS_NAMES))
    town = (F.col("unit_rank") >= C.TOWN_RANK) & (F.col("unit_kind") != "powiat") & ~F.array_contains(plain, text.fold(F.col("unit_name")))
    return rows.select(F.col("stems")[0].alias("head"), F.col("stems").alias("unit_stems"), F.col("forms").alias("unit_forms"), "teryt", "unit_name", "unit_kind", "unit_commune", "unit_county", "unit_region", "unit_rank", town.alias("is_town"))


WORDS = "part string, told_region string, at int, start int, capital boolean, place_cue boolean, commune_cue boolean, county_cue boolean, forms array<string>, stems array<string>"


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words that may begin a name: those in capitals and those after a cue, each with the words that follow."""
    for f in frames:
        out = []
        for part, told, body in zip(f["part"], f["told_region"], f["body"], strict=True):
            found = [(m.start(), m.group()) for m in _WORD.finditer(body or "")]
            ends = {kind: [m.end() for m in cue.finditer(body)] for kind, cue in _CUES.items()} if found else {}
            forms = [folded(w) for _, w in found]
            for at, (start, word) in enumerate(found):
                cued = [any(0 <= start - end <= C.CUE_REACH for end in ends[kind]) for kind in _CUES]
                if word[0].isupper() or any(cued):
                    some = forms[at : at + LONGEST_NAME]
                    out.append((part, told, at, start, word[0].isupper(), *cued, some, [stem(w) for w in some]))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in WORDS.split(", ")])


def named_region(body: Column, regions: list[str]) -> Column:
    """The region that a text names after "woj." or "województwo"; a name alone, as in lists of all regions, does not count."""
    if not regions:
        return F.lit(None).cast("string")
    stems = {folded(r)[:-2]: r for r in regions}
    pattern = r"\bwoj(?:\.|ewodztw\w*)\s+(" + "|".join(re.escape(s) for s in sorted(stems, key=len, reverse=True)) + ")"
    told = F.regexp_extract(text.fold(F.coalesce(body, F.lit(""))), pattern, 1)
    return F.coalesce(*(F.when(told == s, r) for s, r in stems.items()))


def known_region(name: Column, regions: list[str]) -> Column:
    """A region's name as the registry has it, from any spelling."""
    key = F.trim(text.fold(name))
    return F.coalesce(*(F.when(key == folded(r), r) for r in regions)) if regions else F.lit(None).cast("string")


def regions_of(units: DataFrame) -> list[str]:
    """Names of the regions: a few dozen at most, or the registry is none."""
    found = [r[0] for r in units.where("voivodeship is not null").select("voivodeship").distinct().limit(101).collect()]
    if len(found) > 100:
        raise ValueError("a registry of over 100 regions")
    return sorted(found)


def matches(parts: DataFrame, names: DataFrame) -> DataFrame:
    """(part, hits): names in the texts of ``parts`` (part, told_region, body), left to right and none overlapping.

    At one word the longest name counts, then one in its basic form, then a unit in the told region, then a commune before a
    county, then rank.
    """
    words = parts.mapInPandas(_words, WORDS)
    n = F.size("unit_stems")
    met = words.join(places.small(names), words["stems"][0] == F.col("head")).where(F.slice("stems", 1, n) == F.col("unit_stems"))
    exact = F.slice("forms", 1, n) == F.col("unit_forms")
    fields = ("unit_name", "teryt", "unit_kind", "unit_commune", "unit_county", "unit_region", "unit_rank", "is_town", "start", "capital", "place_cue", "commune_cue", "county_cue")
    first = F.min(F.struct((-n).alias("shorter"), (~exact).alias("bent"), (~F.col("unit_region").eqNullSafe(F.col("told_region"))).alias("outside"), (F.col("unit_kind") != "gmina").alias("other"), (-F.col("unit_rank")).alias("minor"), *fields)).alias("hit")
    at = met.groupBy("part", "at").agg(first)
    listed = at.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "hit"))).alias("hits"))
    empty = F.struct(F.lit(-1).alias("end"), F.slice("hits", 1, 0).alias("kept"))
    apart = F.aggregate("hits", empty, lambda acc, h: F.when(h["at"] < acc["end"], acc).otherwise(F.struct((h["at"] - h["hit"]["shorter"]).cast("int").alias("end"), F.concat(acc["kept"], F.array(h)).alias("kept"))), lambda acc: acc["kept"])
    return listed.select("part", F.transform(apart, lambda h: h["hit"]).alias("hits"))


def detect(parts: DataFrame, units: DataFrame) -> DataFrame:
    """(part, teryt, place, commune, county, region, basis) of the texts of ``parts`` (part, body, hint) that name a place.

    A name that is no town, or is a common word, counts only after a cue or in the county or region that the text names (or
    ``hint`` gives). Places score for cue, agreement, basic form, an early mention and repetition; rank decides between
    equals. Texts that name only a county, commune or region have no place.
    """
    regions = regions_of(units)
    parts = parts.select("part", F.coalesce(named_region(F.col("body"), regions), "hint").alias("told_region"), "body")
    found = matches(parts, index(units)).join(parts.select("part", "told_region"), "part", "right")
    hits = F.coalesce("hits", F.array().cast(found.schema["hits"].dataType))
    of = lambda cue, field: F.filter(hits, lambda h: h[cue] & h[field].isNotNull())
    county = F.coalesce(F.try_element_at(of("county_cue", "unit_county"), F.lit(-1))["unit_county"], F.get(of("commune_cue", "unit_commune"), 0)["unit_county"])
    commune = F.try_element_at(of("commune_cue", "unit_commune"), F.lit(-1))["unit_commune"]
    cued = F.filter(hits, lambda h: (h["county_cue"] & h["unit_county"].isNotNull()) | (h["commune_cue"] & h["unit_commune"].isNotNull()))
    found = found.select("part", hits.alias("hits"), county.alias("county"), commune.alias("commune"), F.coalesce("told_region", F.get(cued, 0)["unit_region"]).alias("region"))
    each = found.select("part", "county", "region", F.explode("hits").alias("h")).select("part", F.col("county").alias("told_county"), F.col("region").alias("told_region"), "h.*").where("unit_kind <> 'powiat'")
    cue = F.col("place_cue") | F.col("commune_cue")
    same_county = F.coalesce(F.col("unit_county") == F.col("told_county"), F.lit(False))
    same_region = F.coalesce(F.col("unit_region") == F.col("told_region"), F.lit(False))
    each = each.where((F.col("is_town") | cue | same_county | same_region) & (F.col("capital") | cue))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    own = F.floor(F.when(F.col("is_town"), F.col("unit_rank")).otherwise(F.least("unit_rank", F.lit(C.VILLAGE_RANK))) / C.RANK_SHARE)
    score = own + points(cue, C.CUE_POINTS) + F.when(same_county, C.COUNTY_POINTS).when(same_region, C.REGION_POINTS).otherwise(0) + points(~F.col("bent"), C.EXACT_POINTS) + points(F.col("start") < C.EARLY, C.EARLY_POINTS)
    basis = F.when(cue, "wskazówka").when(F.col("is_town"), "miasto").otherwise("zgodność z regionem")
    scored = each.withColumn("score", score).withColumn("basis", basis)
    unit = F.min(F.struct("start", "basis", "unit_name", "unit_commune", "unit_county", "unit_region")).alias("u")
    by_unit = scored.groupBy("part", "teryt").agg((F.max("score") + C.REPEAT_POINTS * (F.count("*") - 1)).alias("score"), unit)
    best = by_unit.groupBy("part").agg(F.max_by(F.struct("teryt", "u"), F.struct("score", -F.col("u.start"), "teryt")).alias("b"))
    joined = found.join(best, "part", "left")
    place = joined.select("part", F.col("b.teryt").alias("teryt"), F.col("b.u.unit_name").alias("place"), F.coalesce("commune", "b.u.unit_commune").alias("commune"), F.coalesce("county", "b.u.unit_county").alias("county"), F.coalesce("region", "b.u.unit_region").alias("region"), F.col("b.u.basis").alias("basis"))
    return place.where("place is not null or commune is not null or county is not null or region is not null")


def find_places(docs: DataFrame, units: DataFrame, body: str = "text", row_id: str = "id") -> DataFrame:
    """The place of each text: row id, teryt, place, county, region (null if none). Rows with a null id are left out."""
    rows = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").cast("string").alias("part"), F.col(body).alias("body"), F.lit(None).cast("string").alias("hint"))
    found = rows.select("part").join(detect(rows, units), "part", "left")
    return found.select(F.col("part").cast("long").alias(row_id), "teryt", "place", "county", "region")


LOCATION = ("voivodeship", "county", "commune", "city", "teryt", "origin")


def where_it_lies(raw: DataFrame, units: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Offers with voivodeship, county, commune, city, teryt and origin settled, by the order of sources:

    the portal's region (or that of a county whose name is in one region only); the region whose box alone holds the point,
    or, of several, the first one that has the town; the registry's unit of the portal's town; and, if the portal gives no
    town, the title, then the location text, then the description. What the portal gives as county and commune stays.
    A town field that holds a region's name is no town. Offers alike in what is looked at are settled once.
    """
    c = F.col
    regions = regions_of(units)
    blank = lambda name: F.nullif(text.clean(c(name)), F.lit("")) if name in raw.columns else F.lit(None).cast("string")
    bodies = {"title": blank("title"), "location_text": blank("location_text"), "description": F.substring(blank("description"), 1, 1500)}
    silent = blank("city").isNull() | known_region(blank("city"), regions).isNotNull()
    looked = [*(blank(n).alias(n) for n in ("voivodeship", "county", "commune", "city")), *(F.when(silent, body).alias(n) for n, body in bodies.items()), *((c(n) if n in raw.columns else F.lit(None)).cast("double").alias(n) for n in ("lat", "lon"))]
    key = F.md5(F.to_json(F.struct(*looked)))
    rows = raw.select(key.alias("row"), *looked).dropDuplicates(["row"])
    counties = places.known(units).where("unit_kind = 'powiat'").groupBy("unit_key").agg(F.min("unit_region").alias("lo"), F.max("unit_region").alias("hi")).where("lo = hi").select("unit_key", c("lo").alias("county_region"))
    rows = rows.join(places.small(counties), places.name_key(c("county")) == c("unit_key"), "left").drop("unit_key")
    as_region = known_region(c("city"), regions)
    rows = rows.withColumn("region", F.coalesce(known_region(c("voivodeship"), regions), "county_region", as_region)).withColumn("town", F.when(as_region.isNull(), c("city")))
    if boxes is not None:
        held = boxes.limit(places.MAX_BOXES + 1).collect()
        if len(held) > places.MAX_BOXES:
            raise ValueError(f"over {places.MAX_BOXES} boxes")
        inside = [F.when(c("lat").between(b["lat_min"], b["lat_max"]) & c("lon").between(b["lon_min"], b["lon_max"]), b["voivodeship"]) for b in sorted(held, key=lambda b: b["voivodeship"])]
        rows = rows.withColumn("near", F.when(c("region").isNull(), F.array_compact(F.array(*inside))) if inside else F.lit(None).cast("array<string>"))
        rows = rows.withColumn("region", F.coalesce("region", F.when(F.size("near") == 1, F.get("near", 0))))
        unsure = rows.where("region is null and town is not null and size(near) > 1").select("row", "town", F.posexplode("near").alias("nth", "candidate"))
        there = unsure.join(places.small(places.known(units).select("unit_key", "unit_region").distinct()), (places.name_key(c("town")) == c("unit_key")) & (c("candidate") == c("unit_region")))
        rows = rows.join(there.groupBy("row").agg(F.min_by("candidate", "nth").alias("by_point")), "row", "left").withColumn("region", F.coalesce("region", "by_point")).drop("near", "by_point")
    rows = places.resolve(rows, units, "town", "region")
    silent = rows.where("town is null")
    told, parts = c("region"), []
    for nth, body in enumerate(map(c, bodies)):
        parts.append(silent.select(F.concat_ws(":", F.lit(nth), c("row")).alias("part"), body.alias("body"), told.alias("hint")))
        told = F.coalesce(told, named_region(body, regions))
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("body is not null")
    found = detect(texts, units).withColumn("row", F.substring("part", 3, 40)).withColumn("nth", F.substring("part", 1, 1).cast("int"))
    given = lambda name: F.min_by(F.when(c(name).isNotNull(), c(name)), F.when(c(name).isNotNull(), c("nth"))).alias(f"text_{name}")
    place = F.min(F.when(c("place").isNotNull(), F.struct("nth", "place", "commune", "county", "region", "teryt"))).alias("t")
    by_text = found.groupBy("row").agg(place, given("county"), given("region"))
    rows = rows.join(by_text, "row", "left")
    origin = F.when(c("town").isNotNull(), F.when(c("unit_name").isNotNull(), "rejestr").otherwise("portal")).when(c("t.place").isNotNull(), "tekst").otherwise("brak")
    settled = rows.select(
        "row",
        F.coalesce("region", "unit_region", "t.region", "text_region").alias("voivodeship"),
        F.coalesce("county", "unit_county", "t.county", "text_county").alias("county"),
        F.coalesce("commune", "unit_commune", "t.commune").alias("commune"),
        F.coalesce("unit_name", "town", "t.place").alias("city"),
        F.coalesce("teryt", "t.teryt").alias("teryt"),
        origin.alias("origin"),
    )
    marked = raw.withColumn("row_of_place", key).drop(*LOCATION)
    return marked.join(settled, marked["row_of_place"] == settled["row"], "left").drop("row_of_place", "row")
