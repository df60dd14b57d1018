"""Operator 11: fill-in-middle transformation over relational units.

A text is a sequence of units (lines). The units of all documents are one table of (document, ordinal, length) rows, in
which a window's running sum gives the code point after each unit. Each document asks for two cuts, by ordinal; the requests
are joined with the units, what they find is aggregated to two offsets a document, and the text is cut there by substring.

The unit rows carry keys and lengths, never texts. Grouping, window, join and aggregation all use one partitioning by the
document's key, so the lengths are shuffled once, and so are the texts, when they meet their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.llm.common import free_name, materialize, table
from kadastra.operators.skew import join_groups

#: A unit: a line with its line feed, or the last line without one.
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _draws(row_id: Column, salt: str) -> list[Column]:
    """Four numbers of 32 bits from the id alone."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def arrange(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """Prefix-suffix-middle or suffix-prefix-middle order, with sentinels."""
    p, s, m = (F.concat(F.lit(mark), part) for mark, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    return F.when(form == PSM, F.concat(p, s, m)).otherwise(F.concat(s, p, m))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. A transformed text holds no sentinel of its own, so there are three parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = (F.concat(*(F.get(parts, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def units(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each unit: keys, ``pos`` from 0 and ``end``, the code points up to its end."""
    exploded = grouped.select(*keys, F.posexplode("lengths").alias("pos", "length"))
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return exploded.select(*keys, "pos", F.sum("length").over(so_far).alias("end"))


def transform(docs: DataFrame, text: str = "text", row_id: str = "doc_id", rate: int = 100, spm: int = 50, salt: str = "7:", unit: str = LINE) -> DataFrame:
    """One row per document: row id, ``text``, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain), ``output``.

    Of all documents ``rate`` percent are transformed, of these ``spm`` percent with the suffix first; both draws and both cuts
    hang on the id and the number of units alone. A null text counts as empty; empty texts and those that hold a sentinel stay
    plain. Rows without an id draw as if it were the empty string. Rows equal in id and text are cut once and each returned, so
    one such row may be a third of all rows; an empty table gives an empty result; columns other than the two named are not read.
    """
    own, named = F.coalesce(F.col(text), F.lit("")), F.col(row_id)
    rows = docs.select(named.alias("row_id"), own.alias("text"))
    keys = ["k1", "k2"]  # 128 bits: neither id nor text has to be told apart again
    keyed = rows.withColumns({"k1": F.xxhash64("row_id", "text"), "k2": F.xxhash64(F.lit("second"), "text", "row_id")})

    lengths = F.transform(F.regexp_extract_all("text", F.lit(unit), 0), F.length)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    narrow = keyed.select(*keys, "row_id", lengths.alias("lengths"), ((F.col("text") == "") | marked).alias("stays"))
    grouped = narrow.groupBy(*keys).agg(F.first("row_id").alias("row_id"), F.first("lengths").alias("lengths"), F.first("stays").alias("stays"), F.count("*").alias("rows"))

    h1, h2, h3, h4 = _draws(F.col("row_id"), salt)
    n = F.size("lengths").cast("long")
    asked = grouped.select(
        *keys, "rows", n.alias("n"),
        F.when(F.col("stays") | (h3 % 100 >= rate), PLAIN).when(h4 % 100 < spm, SPM).otherwise(PSM).alias("form"),
        F.least(h1 % (n + 1), h2 % (n + 1)).alias("first"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("second"),
    ).where(F.col("form") != PLAIN)
    requests = asked.select(*keys, "rows", "n", "form", F.posexplode(F.array("first", "second")).alias("cut", "ordinal"))
    # the ordinals are compared beside the keys, not as a key, so that both sides keep the partitioning they have
    found = requests.join(units(grouped, keys), keys, "left").where(F.col("pos").isNull() | (F.col("ordinal") == 0) | (F.col("ordinal") - F.col("pos") == 1))
    ends = [F.coalesce(F.max(F.when((F.col("cut") == k) & (F.col("ordinal") > 0), F.col("end"))), F.lit(0)) for k in (0, 1)]
    offsets = found.groupBy(*keys).agg(F.first("rows").alias("rows"), F.first("n").alias("n"), F.first("form").alias("form"), ends[0].alias("a"), ends[1].alias("b"))
    plain = grouped.where(F.col("stays") | (h3 % 100 >= rate)).select(*keys, "rows", n.alias("n"), F.lit(PLAIN).alias("form"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    placed = materialize(offsets.unionByName(plain), "fim-offsets")

    joined = join_groups(keyed, placed.hint("shuffle_hash"), keys, "rows")
    a, b, whole = F.col("a").cast("int"), F.col("b").cast("int"), F.col("text")
    parts = [F.substr(whole, F.lit(1), a), F.substr(whole, a + 1, b - a), F.substr(whole, b + 1)]
    output = F.when(F.col("form") == PLAIN, whole).otherwise(arrange(F.col("form"), *parts))
    out_text = free_name(docs.select(row_id), "text")
    return joined.select(F.col("row_id").alias(row_id), whole.alias(out_text), "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
    CAST(('0x' || substr(x, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(x, 9, 8)) AS BIGINT) AS h2,
    CAST(('0x' || substr(x, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(x, 25, 8)) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
