"""Duplicates whose copies match their original themselves, and hot keys; against all pairs on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.operators import duplicates

DAY = dt.datetime(2026, 1, 1)
SELLERS = {"prywatna": 0, "komornik": 0, "deweloper": 1}
SCHEMA = ", ".join(f"{k} {t}" for k, t in duplicates.COLUMNS.items())


def offers(spark, rows):
    usual = dict.fromkeys(duplicates.COLUMNS) | {"kind": "nieruchomosc", "transaction": "sprzedaz", "property_type": "mieszkanie", "title": "Mieszkanie", "description": "", "city": "Opole", "area": 49.0, "rooms": 2, "seller_type": "nieznany"}
    return duplicates.fingerprints(spark.createDataFrame([tuple((usual | r).values()) for r in rows], SCHEMA))


def all_pairs(df):
    """Verdicts of all pairs that share a key and the window."""
    keyed = df.withColumn("keys", duplicates.keys()).checkpoint()
    a, b = (keyed.select(F.struct(*df.columns).alias(s), F.col("keys").alias(f"{s}_keys")) for s in "ab")
    near = F.coalesce(F.abs(F.datediff("a.first_seen", "b.first_seen")) <= C.DEDUP_WINDOW_DAYS, F.lit(True))
    pairs = a.join(b, F.arrays_overlap("a_keys", "b_keys") & (F.col("a.id") < F.col("b.id")) & near & (F.col("a.kind") != "przetarg"))
    return duplicates.verdicts(pairs.select("a", "b"))


def random_offers(seed, n=90):
    r = random.Random(seed)
    text = "jasne mieszkanie w centrum miasta blisko parku szkoły z balkonem piwnicą windą garażem".split()
    return [
        {
            "id": i, "source_key": r.choice("abc"), "kind": r.choice(["nieruchomosc"] * 8 + ["licytacja", "przetarg"]), "title": f"Mieszkanie {r.choice(['nr 1', 'nr 2', 'przy parku', 'w centrum', ''])} {i % 7}",
            "description": " ".join(r.sample(text, 9)) * r.choice([0, 1, 8]), "street": r.choice([None, "Polna", "Leśna"]), "floor": r.choice([None, 1, 2]), "area": r.choice([48.5, 49.0, 49.2, None]),
            "price": r.choice([None, 1.0, 1.1, 1.24, 1.3, 1.6]) and 300_000 * r.choice([1.0, 1.1, 1.24, 1.3, 1.6]) + i, "case_number": r.choice([None, None, "Km 1"]), "opening_price": r.choice([None, 5.0]), "phone_fingerprint": r.choice([None, "x", "y"]),
            "first_seen": DAY + dt.timedelta(days=r.randrange(200)), "published": r.choice([None, DAY + dt.timedelta(days=r.randrange(20))]), "seller_type": r.choice(["prywatna", "deweloper", "nieznany"]),
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_pairs_equal_all_pairs_whatever_the_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    df = offers(spark, random_offers(1)).checkpoint()
    got = {(r.a_id, r.b_id, r.method, r.score) for r in duplicates.verdicts(duplicates.candidate_pairs(df)).collect()}
    assert got == {(r.a_id, r.b_id, r.method, r.score) for r in all_pairs(df).collect()} and len(got) > 50


def rank(r):
    return (r["published"] or r["first_seen"], SELLERS.get(r["seller_type"], 2), r["id"])


@pytest.mark.parametrize("seed", [1, 2])
def test_strict_groups_equal_a_walk_in_order(spark, seed):
    rows = random_offers(seed)
    df = offers(spark, rows).checkpoint()
    links = {}
    for r in all_pairs(df).collect():
        links[r.a_id, r.b_id] = links[r.b_id, r.a_id] = (r.score, r.method)
    order, kept, want = sorted(rows, key=rank), [], {}
    for r in order:
        fits = [(-links[o["id"], r["id"]][0], rank(o), o["id"]) for o in kept if (o["id"], r["id"]) in links]
        if fits:
            want[r["id"]] = (min(fits)[2], *links[min(fits)[2], r["id"]])
        else:
            kept.append(r)
            want[r["id"]] = (None, None, None)
    got = duplicates.strict_groups(df, duplicates.verdicts(duplicates.candidate_pairs(df)).checkpoint(), lambda d: d.checkpoint()).collect()
    assert {r.id: (r.duplicate_of_id, r.score, r.method) for r in got} == want
    copies = [v[0] for v in want.values()]
    assert all(r.copies_count == copies.count(r.id) and r.is_original == (want[r.id][0] is None) for r in got)


def test_a_copy_of_a_copy_is_no_copy(spark):
    """1 matches 2 and 2 matches 3, but 1 and 3 are too far apart in price: a component of three, strictly a copy and an original."""
    rows = [{"id": i, "source_key": s, "street": "Polna", "price": p, "first_seen": DAY + dt.timedelta(days=i)} for i, s, p in ((1, "a", 300_000.0), (2, "b", 380_000.0), (3, "c", 480_000.0))]
    df = offers(spark, rows).checkpoint()
    links = duplicates.verdicts(duplicates.candidate_pairs(df)).checkpoint()
    loose = {r.id: r.duplicate_of_id for r in duplicates.groups(df, links, lambda d: d.checkpoint()).collect()}
    strict = {r.id: (r.duplicate_of_id, r.method) for r in duplicates.strict_groups(df, links, lambda d: d.checkpoint()).collect()}
    assert loose == {1: None, 2: 1, 3: 1} and strict == {1: (None, None), 2: (1, "fingerprint"), 3: (None, None)}


def test_alike_listings_beyond_the_window(spark):
    """One offer again and again over two windows: each copy lies within the window of its original."""
    rows = [{"id": i, "source_key": "ab"[i % 2], "street": "Polna", "price": 300_000.0, "first_seen": DAY + dt.timedelta(days=7 * i)} for i in range(40)] + [{"id": 99, "source_key": "c", "street": "Polna", "price": 300_500.0, "first_seen": DAY}]
    df = offers(spark, rows).checkpoint()
    got = duplicates.strict_groups(df, duplicates.verdicts(duplicates.candidate_pairs(df)).checkpoint(), lambda d: d.checkpoint()).collect()
    seen = {r["id"]: r["first_seen"] for r in rows}
    valid = {frozenset((r.a_id, r.b_id)) for r in all_pairs(df).collect()}
    copies = [(r.id, r.duplicate_of_id) for r in got if r.duplicate_of_id is not None]
    originals = {r.id for r in got if r.is_original}
    assert all(o in originals and frozenset((c, o)) in valid and abs((seen[c] - seen[o]).days) <= C.DEDUP_WINDOW_DAYS for c, o in copies)
    assert len(copies) > 30 and sum(r.copies_count for r in got) == len(copies)


def test_originals_of_a_star_and_a_chain(spark):
    save = lambda d: d.checkpoint()
    star = [(0, v) for v in range(1, 3000)]
    chain = [(v, v + 1) for v in range(5000, 5008)]
    got = {r.u for r in duplicates.originals(spark.createDataFrame(star + chain, "u long, v long"), save).collect()}
    assert got == {0, *range(5000, 5009, 2)}
    assert duplicates.originals(spark.createDataFrame([], "u long, v long"), save).collect() == []


def test_a_hot_key_of_different_listings(spark, monkeypatch):
    """Six thousand different flats of one agency under one phone and size: pairs that can match, not all pairs."""
    n = 6_000
    rows = spark.range(n).select(
        "id", F.concat(F.lit("src"), F.col("id") % 3).alias("source_key"), F.lit("nieruchomosc").alias("kind"), F.lit("sprzedaz").alias("transaction"), F.lit("mieszkanie").alias("property_type"),
        F.concat(F.lit("Lokal nr "), (F.col("id") / 2).cast("int") % 9973).alias("title"), F.lit("").alias("description"), F.lit("Opole").alias("city"), F.lit("Rynek").alias("street"), F.lit(50.0).alias("area"), F.lit(2).alias("rooms"),
        ((F.col("id") / 2).cast("int") % 30).alias("floor"), (200_000 + (F.col("id") / 2).cast("int") * 60 + F.col("id") % 2).cast("double").alias("price"), F.lit("x").alias("phone_fingerprint"), F.lit(DAY).alias("first_seen"),
    )
    pairs = duplicates.candidate_pairs(duplicates.fingerprints(rows).checkpoint()).checkpoint()
    assert pairs.where("b.id = a.id + 1 and a.id % 2 = 0").count() == n // 2
    assert pairs.count() < 2 * n


@pytest.mark.parametrize("block", [2, 4096])
def test_links_in_steps_equal_all_pairs(spark, monkeypatch, block):
    """Links with descriptions fetched for the pairs that need them; what is left to run is short, whatever the offers come from."""
    monkeypatch.setattr(duplicates, "BLOCK", block)
    df = offers(spark, random_offers(3, 110)).checkpoint()
    found = duplicates.links(df, lambda d: d.checkpoint())
    got = [(r.a_id, r.b_id, r.method, r.score) for r in found.collect()]
    want = {(r.a_id, r.b_id, r.method, r.score) for r in all_pairs(df).collect()}
    assert sorted(got) == sorted(want) and {"text", "phone", "fingerprint", "licytacja"} <= {m for *_, m, _ in got}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4


def test_pairs_under_several_keys_count_once(spark):
    rows = [{"id": i, "source_key": "ab"[i % 2], "street": "Polna", "price": 300_000.0 + i / 10, "phone_fingerprint": "x", "first_seen": DAY} for i in range(9)] + [{"id": 9, "source_key": "c", "street": "Polna", "price": None, "phone_fingerprint": "x", "first_seen": DAY}]
    df = offers(spark, rows).checkpoint()
    pairs = [(r.a.id, r.b.id) for r in duplicates.candidate_pairs(df).select("a", "b").collect()]
    assert sorted(pairs) == sorted({(r.a_id, r.b_id) for r in all_pairs(df).collect()}) and len(pairs) == 45


def test_stands_are_narrow_and_dealt_out_once(spark):
    """What meets under the keys holds no texts, and no side is shuffled before the join in which pairs are made."""
    df = offers(spark, random_offers(5, 40)).checkpoint()
    stands = df.select("id", F.col("id").alias("unit"), F.xxhash64("city").alias("key"), duplicates._told(F.col).alias("told")).checkpoint()
    assert "string" not in stands.schema["told"].dataType.simpleString()
    for side in duplicates._cells(stands, lambda d: d.checkpoint()):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_saved_tables_are_parquet_in_the_shared_folder(spark):
    from kadastra.operators.skew import shared_dir
    from kadastra.plans.catalogue_state import saved

    files = saved(spark.range(5)).inputFiles()
    assert files and all(shared_dir(spark) in f and f.endswith(".parquet") for f in files)
