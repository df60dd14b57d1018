"""Text functions as Spark columns: folding, keys, cleaning, shingles, streets."""

from __future__ import annotations

import heapq
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kadastra import constants as C


def _accents() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter, and these letters; built from the Unicode rule."""
    pairs = {"ł": "l", "Ł": "L"}
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def deaccent(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Lower case without accents; the form in which texts are compared."""
    return F.lower(deaccent(text))


def clean(text: Column) -> Column:
    """White space collapsed and trimmed, null as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\u00a0\u200b", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def norm_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(clean(text)), "[^a-z0-9]+", " "))


def slug(text: Column, length: int = 150) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(fold(clean(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("brak"))


def strip_html(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]{1,400}>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return clean(bare)


def unescape(value: Column) -> Column:
    """Character references decoded up to three times; texts are often encoded twice. The common ones need no Python."""

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        def of(t: str) -> str:
            for _ in range(3):
                found = html.unescape(t)
                if found == t:
                    break
                t = found
            return t

        return texts.map(lambda t: of(t) if t and "&" in t else t)

    plain = F.coalesce(value, F.lit(""))
    out = plain
    for _ in range(3):
        for entity, char in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(char))
    return F.coalesce(decoded(F.when(out.rlike("&(?:#[0-9xX]|[A-Za-z])"), plain)), out)  # nulls are all that Python sees of the others


def short_label(name: Column, most: int = 40) -> Column:
    """A name for a narrow place; what is cut off is shown by an ellipsis."""
    whole = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, most - 1), r"[ ,-]+\z", ""), F.lit("…")))


def source_label(name: Column, key: Column) -> Column:
    """The name of a source as readers know it: up to the dash, or its key in words."""
    return F.coalesce(F.nullif(F.get(F.split(name, " — "), 0), F.lit("")), F.replace(F.coalesce(key, F.lit("")), F.lit("_"), F.lit(" ")))


def digest(*parts: Column) -> Column:
    """SHA-1 of the parts, each with a bar after it."""
    return F.sha1(F.concat(*(x for p in parts for x in (p.cast("string"), F.lit("|")))))


def shingle_hash(text: Column) -> Column:
    """Digest of the first 64 distinct five-word shingles in order; null under twelve words. The key is made in the JVM; Python,
    over Arrow, keeps the smallest shingles of each text, which no built-in function does without making and sorting all."""

    @F.pandas_udf("string")
    def smallest(keys: pd.Series) -> pd.Series:
        def of(key: str | None) -> str | None:
            words = key.split() if key else ()
            if len(words) < C.MIN_SHINGLE_WORDS:
                return None
            grams = set(map(" ".join, zip(*(words[i:] for i in range(C.SHINGLE_WORDS)), strict=False)))
            return "|".join(heapq.nsmallest(C.SHINGLES_KEPT, grams))

        return keys.map(of)

    return digest(smallest(norm_key(text)))


def truncate(text: Column, limit: int = 220) -> Column:
    whole = clean(text)
    cut = F.regexp_replace(F.substring(whole, 1, limit - 1), r" [^ ]*$", "")
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(cut, F.lit("…")))


def strip_street_prefix(street: Column) -> Column:
    out = F.trim(street)
    for _ in range(3):
        out = F.regexp_replace(out, C.STREET_PREFIX, "")
    return out


def house_number(street: Column) -> tuple[Column, Column]:
    """Name and number of a street address; no number: null."""
    number = F.nullif(F.regexp_extract(street, C.HOUSE_NUMBER, 2), F.lit(""))
    return F.when(number.isNotNull(), F.regexp_extract(street, C.HOUSE_NUMBER, 1)).otherwise(street), number


def street_terms(street: Column) -> Column:
    """Folded stems of up to six words of a street's name."""
    name, _ = house_number(strip_street_prefix(street))
    words = F.filter(F.split(name, r"[\s,.]+"), lambda w: w != "")
    return F.slice(F.transform(words, lambda w: F.regexp_replace(fold(w), C.ADJECTIVE_ENDING, "")), 1, 6)


def street_label(street: Column) -> Column:
    """A street's name for display: no prefix, no number, words capitalised, genitive turned to nominative."""
    name, _ = house_number(strip_street_prefix(F.regexp_replace(street, r"(?iu)^\s*okolice\s+", "")))
    base = F.initcap(F.lower(F.trim(F.split_part(name, F.lit(","), F.lit(1)))))
    base = F.regexp_replace(base, r"^([^ ]+[a-zżźćńółęąś]k|[^ ]+[sc]k)iej$", "$1a")
    return F.regexp_replace(F.regexp_replace(base, r"\bIi\b", "II"), r"\bIii\b", "III")


def extract_street(body: Column) -> Column:
    """The street that a text names after its kind of street; null if it names none."""
    found = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?U)\b(?:[Uu]l\.|[Uu]lic[aiy]|[Aa]l\.|[Aa]lej[aie]|[Oo]s\.|[Pp]l\.)\s+((?:\p{Lu}[\p{L}-]*|\d+-go|\d+ \p{Lu}[\p{L}-]*)(?:\s+\p{Lu}[\p{L}-]*){0,3})", 1)
    return F.nullif(F.regexp_replace(found, r"\s+(?:Kontakt|Tel|Telefon|Cena|Oferta|Polecam)\b.*$", ""), F.lit(""))


def looks_like_agency(name: Column) -> Column:
    return F.coalesce(name.rlike(C.AGENCY_NAME), F.lit(False))


def seller_type(declared: Column, kind: Column, name: Column, authority: Column, title: Column, description: Column) -> Column:
    """Who sells, by a cascade of rules of which the first that fits decides."""
    told = F.coalesce(declared, F.lit("nieznany"))
    who = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(authority, F.lit("")))
    body = F.substring(F.coalesce(description, F.lit("")), 1, 1200)
    institution = (
        F.when(who.rlike("(?iu)komornik"), "komornik").when(who.rlike("(?iu)syndyk"), "syndyk").when(who.rlike(C.OFFICE_HINTS), "urzad").otherwise("instytucja")
    )
    return (
        F.when(told.isin(*C.INSTITUTIONAL_SELLERS), told)
        .when((kind == "licytacja") & (told == "nieznany"), "komornik")
        .when(kind.isin("przetarg", "wykaz") & (told == "nieznany"), "urzad")
        .when(who.rlike(C.INSTITUTION_HINTS), institution)
        .when(who.rlike(C.DEVELOPER_HINTS), "deweloper")
        .when(looks_like_agency(name), "posrednik")
        .when(body.rlike(C.AGENCY_DESCRIPTION), "posrednik")
        .when(F.concat_ws(" ", F.coalesce(title, F.lit("")), body).rlike(C.PRIVATE_PHRASES), "prywatna")
        .otherwise(told)
    )


def _first(text: Column, hints, other: str) -> Column:
    out = None
    for value, pattern in hints:
        out = (F if out is None else out).when(text.rlike(pattern), value)
    return out.otherwise(other)


def property_type(*texts: Column) -> Column:
    return _first(F.concat_ws(" ", *texts), C.PROPERTY_HINTS, "inne")


def transaction(*texts: Column) -> Column:
    return _first(F.concat_ws(" ", *texts), C.TRANSACTION_HINTS, "sprzedaz")
