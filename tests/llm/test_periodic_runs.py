"""Periodic runs against brute force over all lags."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kadastra.llm import periodic_runs as R
from tests.llm.helpers import awkward, documents


def brute(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(w[i : i + size - d] == w[i + d : i + size] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("heavy", [2, 8, 64])
def test_random_sequences(monkeypatch, heavy):
    monkeypatch.setattr(R, "LEAST_HEAVY", heavy)
    r = random.Random(heavy)
    for _ in range(600):
        k, w, n = r.choice([1, 2, 2, 3, 5, 20]), [], r.randrange(120)
        while len(w) < n:
            block = [r.randrange(k) for _ in range(r.randrange(1, 9))]
            w += (block * r.randrange(2, 9))[: r.randrange(3, 60)] if r.random() < 0.4 else block
        assert R.runs(np.array(w, np.int64)) == brute(w)


@pytest.mark.parametrize("heavy", [1, 10, 10_000])
def test_lag_counts_are_exact(monkeypatch, heavy):
    monkeypatch.setattr(R, "LEAST_HEAVY", heavy)
    w = np.random.default_rng(1).zipf(1.4, 3000) % 50
    got = R.lag_counts(w, 750)
    assert got.tolist() == [0, *(int((w[q:] == w[:-q]).sum()) for q in range(1, 751))]


def test_periods_within_periods():
    w = ([0, 1] * 6 + [2]) * 5
    assert R.runs(np.array(w)) == brute(w)
    assert [(s, n, q) for s, n, q in brute(w) if q == 13] == [(0, 65, 13)]


def test_a_million_times_one_word():
    assert R.runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]


def test_table_with_awkward_rows(spark):
    rows = awkward() + [(100 + i, " ".join(["a", "b", "c", "d"][: 1 + i % 4] * i) + " end", "en", "a") for i in range(12)]
    got = {}
    for r in R.find_runs(documents(spark, rows)).collect():
        got.setdefault(repr(r.doc_id), []).append(([tuple(x) for x in r.runs], r.collapsed))
    want = {}
    for i, t, _, _ in rows:
        w = (t or "").encode().split()
        found = brute(w) if len(set(w)) > 1 or len(w) < 100 else [(0, len(w), 1)]
        want.setdefault(repr(i), []).append((found, collapsed([x.decode() for x in w], found)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert R.find_runs(documents(spark, [])).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice("x y z żó w v u".split()) for _ in range(r.randrange(200))), "en", "a") for i in range(150)] + [(None, "a b c d e f", "en", "a"), (500, None, "en", "a")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in R.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        w, h = (t or "").split(), 1 if i is None else zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            w = w[:a] + [w[a + (k - a) % (1 + (n - a) // (3 + g % 8))] for k in range(a, n)]
        found = brute(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest())
        x = got[i]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == want
