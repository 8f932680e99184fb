import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timbrel.llm import periods as P
from timbrel.llm import queries


def brute(w):
    """All runs by every lag, smallest period first."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def numbers(w):
    names = {}
    return np.array([names.setdefault(x, len(names)) for x in w], np.int64)


def samples(r):
    out = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, ["a", "b"] * 12, [str(i) for i in range(300)]]
    for p in (1, 2, 5, 7, 8, 9, 10, 13, 14, 20, 21, 22, 31, 64, 100, 333):
        unit = [r.choice("abcdefgh") for _ in range(p)]
        for times in (2.9, 3, 3.01, 4.7, 11):
            out.append([r.choice("xyzab") for _ in range(r.randrange(40))] + (unit * 12)[: int(p * times)] + [r.choice("xyzab") for _ in range(r.randrange(40))])
    for _ in range(60):  # runs inside periods of runs, few kinds of words
        unit = [r.choice("ab") for _ in range(r.randrange(1, 12))] * r.randrange(1, 9) + [r.choice("abc") for _ in range(r.randrange(4))]
        out.append(unit * r.randrange(1, 7) + [r.choice("ab") for _ in range(r.randrange(30))] + unit * r.randrange(5))
    a, b = "a", "b"
    for _ in range(9):
        a, b = a + b, a  # Fibonacci words have many close runs
    out += [list(a), list(a * 3), list((a + "c") * 3)]
    return out


def test_runs_against_brute_force():
    rows = samples(random.Random(4))
    want = [brute(w) for w in rows]
    assert sum(map(len, want)) > 150
    assert P.runs_in([numbers(w) for w in rows]) == want
    assert [P.runs_in([numbers(w)])[0] for w in rows] == want
    assert P.runs_in([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=14), st.lists(st.sampled_from("abc"), max_size=50), st.integers(1, 12), st.integers(0, 40))
def test_any_run_is_found(unit, rest, times, cut):
    w = (rest[:cut] + unit * times + rest[cut:]) * 3
    assert P.runs_in([numbers(w)])[0] == brute(w)


def test_a_hash_that_says_nothing_costs_no_run(monkeypatch):
    rows = samples(random.Random(9))[:60]
    monkeypatch.setattr(P, "mix", lambda a, b: (a + b) & np.uint64(3))
    got = P.runs_in([numbers(w) for w in rows])
    for g, w in zip(got, rows):
        assert set(g) <= set(brute(w))


def altered(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = altered(doc_id, (text or "").encode().split())
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    keep = [True] * len(w)
    for s, m, q in runs:
        keep[s + q : s + m] = [False] * (m - q)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(x for x, k in zip(w, keep) if k)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, folder).select(*COLUMNS).collect()}
    assert len(got) == len(docs)
    small = [d for d in docs if len((d.text or "").split()) <= 1500]
    assert len(small) > 150 and sum(got[d.doc_id][0] > 0 for d in small) > 5
    for d in small:
        assert got[d.doc_id] == expected(d.doc_id, d.text), d.doc_id


@pytest.mark.parametrize("words", [1 << 19, 100])
def test_odd_rows(spark, words, monkeypatch):
    monkeypatch.setattr(P, "BATCH_WORDS", words)
    long = " ".join(str(i % 4999) for i in range(30_000))
    rows = [(1, None), (1, ""), (2, " \t\n"), (None, "x " * 40), (3, "é\xa0z " * 30), (3, "é\xa0z " * 30), (4, "a\x0bb\x0cc " * 9), (5, long)]
    docs = spark.createDataFrame([(i, t, 7, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string").repartition(2)
    got = P.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    seen = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], len(r.collapsed.encode().split())) for r in got.collect()), key=str)
    want = [(1, 0, [], 0), (1, 0, [], 0), (2, 0, [], 0), (None, 40, [(0, 40, 1)], 1), (3, 30, [(0, 30, 1)], 1), (3, 30, [(0, 30, 1)], 1),
            (4, 27, [(0, 27, 3)], 3), (5, 30_000, [(0, 30_000, 4999)], 4999)]
    assert seen == sorted(want, key=str)
    assert P.periodic_runs(docs.limit(0)).collect() == []
    assert P.with_planted_runs(docs).columns == docs.columns and P.with_planted_runs(docs).count() == len(rows)
