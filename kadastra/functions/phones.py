"""Phone numbers: extraction (Pandas UDF), masking, keyed hashes, fingerprints."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What looks like a number, and what no number starts with.
CANDIDATE = re.compile(r"(?<![\d/])(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d(?:[\s.-]?\d){6,12}(?![\d/])")
BLOCKED = ("0000", "1111", "1234567", "9999")
#: Leading digits of Polish subscriber numbers (public numbering plan): area codes and mobile ranges.
POLISH = re.compile(r"^(?:1[2-8]|2[2-9]|3[2-4]|4[1-468]|5[0-9]|6[0-35-9]|7[1-9]|8[1-79]|9[145])\d{7}$")

# Digits in words.
SPELT = {"zero": "0", "jeden": "1", "dwa": "2", "trzy": "3", "cztery": "4", "pięć": "5", "piec": "5", "sześć": "6", "szesc": "6", "siedem": "7", "osiem": "8", "dziewięć": "9", "dziewiec": "9"}
#: Seven or more digits in words in a row, with spaces, dots or dashes between them.
SPELT_RUN = re.compile(rf"(?i)\b(?:{'|'.join(SPELT)})(?:[\s.,-]+(?:{'|'.join(SPELT)}|\d)){{6,}}\b")
PHONE = "array<struct<e164:string,national:string,masked:string,hashed:string,origin:string>>"


def spelt(t: str) -> str:
    """A text in which numbers that are spelt digit by digit are digits."""
    return SPELT_RUN.sub(lambda run: re.sub(r"[^\W\d_]+", lambda w: SPELT[w.group().lower()], run.group()), t)


def national(raw: str, region: str = "PL") -> str | None:
    """The subscriber number of a candidate: nine digits by the Polish plan, ten by the North American one."""
    digits = re.sub(r"\D", "", raw)
    if region == "US":
        digits = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        return digits if len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789" and not digits.startswith(BLOCKED) else None
    for tried in (digits[2:11] if digits.startswith("48") else digits, digits[-9:], digits[:9]):
        if len(tried) == 9 and POLISH.match(tried) and not tried.startswith(BLOCKED):
            return tried
    return None


def mask(number: str) -> str:
    return f"{number[:3]} *** ***" if len(number) == 9 else number[:3] + "*" * (len(number) - 3) if len(number) > 4 else "***"


def hashed(e164: str, key: bytes) -> str:
    return hashlib.blake2b(e164.encode(), digest_size=16, key=key).hexdigest()


def found_in(t: str | None, key: str, region: str = "PL", most: int = 5, origin: str = "opis") -> list[dict]:
    code, secret, out = ("+1" if region == "US" else "+48"), key.encode(), {}
    for m in CANDIDATE.finditer(spelt(t or "")):
        n = national(m.group(), region)
        if n and len(out) < most:
            out.setdefault(n, {"e164": code + n, "national": n, "masked": mask(n), "hashed": hashed(code + n, secret), "origin": origin})
    return list(out.values())


def phones(text: Column, key: str = "kadastra", region: str = "PL", most: int = 5, origin: str = "opis") -> Column:
    """Up to ``most`` distinct phone numbers of a text, in digits or spelt, with where they come from."""
    @F.pandas_udf(PHONE)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: found_in(t, key, region, most, origin))

    return found(text)


def fingerprint(found: Column) -> Column:
    """The smallest hash of a listing's numbers; null without any."""
    return F.array_min(F.transform(found, lambda p: p["hashed"]))


def masked(number: Column) -> Column:
    """Mask of a number in a column, without Python."""
    return F.when(number.isNull(), number).when(F.length(number) == 9, F.concat(F.substring(number, 1, 3), F.lit(" *** ***"))).when(F.length(number) > 4, F.concat(F.substring(number, 1, 3), F.repeat(F.lit("*"), F.length(number) - 3))).otherwise("***")
