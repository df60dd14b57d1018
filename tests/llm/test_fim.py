"""Fill-in-middle against a plain Python version, exact round trips, awkward rows."""

import hashlib
import re

from kadastra.llm import fim
from tests.llm.helpers import awkward, documents

MARKS = "<P>|<S>|<M>"


def expected(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search(MARKS, text) or h[2] % 100 >= rate:
        return text, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return text, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def _rows(df):
    return sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect()), key=repr)


TEXTS = ["\n", "\n\n\n", "a", "a\n", "\na", "one\ntwo\nthree", "one\r\ntwo still two\n", "has <S> in it\nx", "<", "<P", "żółć\n你好\n\U0001f600\nx", "M>\n<\nS>\n<", "x\n" * 3000]


def test_equals_plain_python(spark):
    rows = awkward() + [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS * 8)]
    got = fim.transform(documents(spark, rows))
    assert _rows(got) == sorted(((i, *expected(i, t)) for i, t, _, _ in rows), key=repr)


def test_some_documents_stay_plain_by_rate(spark):
    rows = [(i, "one\ntwo\nthree\n", "en", "a") for i in range(200)]
    got = fim.transform(documents(spark, rows), rate=40, spm=10)
    assert _rows(got) == sorted(((i, *expected(i, t, 40, 10)) for i, t, _, _ in rows), key=repr)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_restores_every_text(spark):
    rows = awkward() + [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS * 4)]
    made = fim.transform(documents(spark, rows))
    assert made.where(~fim.restore(made["output"], made["form"]).eqNullSafe(made["text"])).count() == 0


def test_a_third_of_all_rows_alike(spark):
    rows = [(None, "same\nlines\nhere", "en", "a")] * 400 + [(i, f"row {i}\nline\n", "en", "a") for i in range(800)]
    got = fim.transform(documents(spark, rows))
    assert _rows(got) == sorted(((i, *expected(i, t)) for i, t, _, _ in rows), key=repr)


def test_text_column_of_another_name_and_empty_table(spark):
    df = documents(spark, [(1, "a\nb\n", "en", "a")]).withColumnRenamed("text", "body").withColumnRenamed("doc_id", "text")
    assert fim.transform(df, text="body", row_id="text").columns[:2] == ["text", "text_"]
    assert fim.transform(documents(spark, [])).collect() == []


def test_lengths_meet_without_another_shuffle(spark, tmp_path):
    documents(spark, [(i, f"a {i}\nb\n", "en", "a") for i in range(50)]).write.parquet(str(tmp_path / "d"))
    grouped = spark.read.parquet(str(tmp_path / "d")).selectExpr("doc_id k1", "doc_id k2", "array(1, 2) lengths").groupBy("k1", "k2").agg({"lengths": "first"}).withColumnRenamed("first(lengths)", "lengths")
    plan = fim.units(grouped, ["k1", "k2"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_query_equals_its_twin(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = con.execute(f"select {', '.join(names)} from ({fim.ORACLE}) order by doc_id").fetchall()
    assert [tuple(r) for r in fim.op11_fim(spark, sf).select(*names).orderBy("doc_id").collect()] == want
