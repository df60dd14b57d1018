"""Every registered query with an SQL twin against DuckDB, the others for running; and the guard of the entry file."""

import re
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from kadastra.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_short_labels_tell_no_label_from_an_empty_one(spark, duck):
    """Listings without rooms have no title; test_query takes null and empty for the same."""
    got = {tuple(r) for r in registry.QUERIES["short_labels"](spark, SF).select("id", "label", "source").collect()}
    assert got == set(duck.sql(f"select id, label, source from ({registry.ORACLE_SQL['short_labels']})").fetchall())
    assert any(label is None for _, label, _ in got)


def numbers_with_line_breaks(spark, tmp_path, name):
    """(of the query, of its SQL twin) for numbers that line breaks and other white space follow."""
    texts = ["CC BY 4.0.\nNext line", "3.\n", "5\n\nx", "7\r\n", "1 200,50\n", "1.234\n", "6\x0b8", "6\x0b", "9\t", "2\u2028", "12 zł\n", "1.234", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return [sorted(map(tuple, rows)) for rows in (registry.QUERIES[name](spark, str(tmp_path)).collect(), con.sql(registry.ORACLE_SQL[name]).fetchall())]


def test_parse_number_tells_line_breaks_as_its_sql(spark, tmp_path):
    got, want = numbers_with_line_breaks(spark, tmp_path, "parse_number")
    assert got == want and got[0] == (0, None) and got[11] == (11, 1234.0)


def test_sql_parse_number_tells_line_breaks_as_its_sql(spark, tmp_path):
    got, want = numbers_with_line_breaks(spark, tmp_path, "sql_parse_number")
    assert got == want and got[0] == (0, None) and got[11] == (11, 1234.0)


def test_search_is_metamorphic(spark):
    """Filters narrow, empty ones ask for nothing, sorts sort with nulls last."""
    from kadastra.operators import search
    from kadastra.operators.search import Filters
    from kadastra.plans.views import NOW, listings

    df = listings(spark, SF).cache()
    whole = search.search(df, Filters(), NOW).count()
    assert search.search(df, Filters(q=" ", city="", street="", kind="nie ma"), NOW).count() == whole
    assert search.search(df, Filters(price_max=100000.0), NOW).count() < whole
    for key, (column, way) in search.SORTS.items():
        if column in df.columns and key != "termin_licytacji":
            seen = [r[0] for r in search.page(df, Filters(sort=key, per_page=100), NOW).select(column).collect()]
            known = [x for x in seen if x is not None]
            assert known == sorted(known, reverse=way == "desc") and seen[: len(known)] == known


def test_filters_reach_the_scan(spark):
    from kadastra.plans.views import table

    plan = table(spark, SF, "orders").where("o_totalprice < 1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*LessThan\(o_totalprice", plan) and "o_orderdate" not in plan


def test_entry_works_without_the_training_operators():
    """The entry file adds the training operators only if they can be imported."""
    code = "import sys; sys.modules['kadastra.llm'] = None\nimport __spark_entry__ as e\nassert 'search_basic' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
