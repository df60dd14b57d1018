"""Fuzzy names of agencies against all pairs; medians against sorting; repairs counted in passing."""

import random
import statistics

from kadastra import constants as C
from kadastra.functions.fuzzy import token_set_ratio
from kadastra.operators import agencies, repair, stats

COMMON = ["nieruchomosci", "biuro", "agencja", "dom"]


def made(seed: int, n: int) -> list[str]:
    """Names of common and own words; some are others with a letter changed, dropped or doubled, a word more or another order."""
    draw = random.Random(seed)
    own = ["".join(draw.choice("abcdeiklmnoprstuwz") for _ in range(draw.randint(3, 9))) for _ in range(60)]
    out = []
    for _ in range(n):
        if out and draw.random() < 0.6:
            name = draw.choice(out)
            at, kind = draw.randrange(len(name)), draw.randrange(5)
            parts = name.split()
            draw.shuffle(parts)
            name = [name[:at] + name[at + 1 :], name[:at] + "x" + name[at + 1 :], name[:at] + name[at] + name[at:], name + " " + draw.choice(COMMON), " ".join(parts)][kind]
        else:
            name = " ".join(draw.sample(COMMON, draw.randint(0, 2)) + draw.sample(own, draw.randint(0 if draw.random() < 0.1 else 1, 2))) or "biuro"
        out.append(" ".join(name.split()))
    return sorted({x for x in out if x})


def test_candidates_lose_no_name(spark):
    left, right = made(1, 250), made(1, 500)[::2] + made(2, 120)
    frame = lambda names: spark.createDataFrame([("c|opole", n) for n in sorted(set(names))], "block string, name string")
    met = {(r.name, r.other) for r in agencies.candidates(frame(left), frame(right)).collect()}
    alike = {(a, b) for a in left for b in set(right) if token_set_ratio(a, b) >= C.AGENCY_MATCH}
    assert alike and alike <= met
    assert len(met) < len(left) * len(set(right)) / 3


def test_match_equals_all_pairs(spark):
    names, known = [(n, ("Opole", "Nysa", None)[i % 3]) for i, n in enumerate(made(3, 120))], [(i, n, ("Opole", "Nysa", None)[i % 3]) for i, n in enumerate(made(3, 200)[::2] + ["biuro"] * 3)]
    got = agencies.match(spark.createDataFrame(names, "name string, city string"), spark.createDataFrame([(*k, f"slug-{k[0]}") for k in known], "id long, name string, city string, slug string")).collect()
    want = {}
    for name, city in names:
        for i, other, town in known:
            if name[:4] == other[:4] or (city and city == town):
                score = token_set_ratio(name, other)
                if score >= C.AGENCY_MATCH:
                    want[name, city] = max(want.get((name, city), (0, 0)), (score, -i))
    assert {(r.name, r.city): (r.score, -r.agency_id) for r in got} == want and want


def test_match_of_nothing(spark):
    names = spark.createDataFrame([("", None), (None, "Opole"), ("...", "Opole"), ("Biuro", "Opole")], "name string, city string")
    none = spark.createDataFrame([], "id long, name string, city string, slug string")
    assert agencies.match(names, none).count() == 0 and agencies.match(names.limit(0), none).count() == 0


def test_medians_equal_sorting(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice([None, "a", "b"]), v) for k in range(6) for v in [round(draw.choice([draw.uniform(0.01, 3), draw.uniform(5000, 9000), 7000.0, 1e9]), 2) for _ in range(draw.randint(1, 40))]]
    rows += [(7, "a", None), (7, "a", -5.0), (7, "a", 0.0), (8, None, 4.0), (8, None, 4.0), (9, "b", 1.0), (9, "b", 1e12)]
    got = {(r.k, r.t): (r.median, r.n) for r in stats.medians(spark.createDataFrame(rows, "k int, t string, v double").repartition(3), ["k", "t"], "v").collect()}
    groups = {}
    for k, t, v in rows:
        if v is not None and v > 0:
            groups.setdefault((k, t), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key][1] == len(values) and abs(got[key][0] - statistics.median(values)) < 1e-9 * got[key][0]


def test_repairs_are_counted_in_passing(spark):
    rows = [(1, 1e15, 40.0, "Dom", "inne"), (1, 300000.0, 40.0, "Dom", "dom"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, price double, area double, title string, property_type string")
    after, told = repair.observed(df, ["price", "status", "area"])
    assert sorted(r.price or 0 for r in after.collect()) == [0, 0, 300000.0] and repair.BEFORE not in after.columns
    assert told.get == repair.change_counts(df, ["price", "status", "area"]).first().asDict() and told.get["price"] == 1
    plan = repair.change_counts(df, ["price"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_names_that_another_covers_are_compared_no_further(spark, monkeypatch):
    """Names of one town that differ in a digit: each has its agency by equal words, and no pairs by ratios. One with a name of its own does."""
    asked, find = [], agencies.candidates
    monkeypatch.setattr(agencies, "candidates", lambda left, right, *rest: asked.append({tuple(r) for r in left.collect()}) or find(left, right, *rest))
    known = [(i, f"Nieruchomości Biuro#{i:09}", "Opole", f"slug-{i}") for i in range(300)] + [(900, "Biuro 000000007 Nieruchomości", "Opole", "s"), (901, "Dom 1", "Nysa", "t"), (902, "Domek nad wodą 12", None, "u")]
    names = [(f"Biuro#{i:09} Nieruchomości", "Opole") for i in range(300)] + [("Dom 1", "Nysa"), ("Dom 1", "Brzeg"), ("Domek nad wodo 12", None), ("Biuro#000000299 Nieruchomosci", None)]
    got = agencies.match(spark.createDataFrame(names, "name string, city string"), spark.createDataFrame(known, "id long, name string, city string, slug string"))
    found = {(r.name, r.city): (r.agency_id, round(r.score, 2)) for r in got.collect()}
    assert all(found[f"Biuro#{i:09} Nieruchomości", "Opole"] == (i, 100.0) for i in range(300))
    assert found["Dom 1", "Nysa"] == (901, 100.0) and ("Dom 1", "Brzeg") not in found or found["Dom 1", "Brzeg"] == (901, 100.0)
    assert found["Domek nad wodo 12", None][0] == 902 and found["Domek nad wodo 12", None][1] < 100
    assert asked and {name for _, name in asked[0]} <= {"domek nad wodo 12", "biuro 000000299 nieruchomosci", "dom 1"}
