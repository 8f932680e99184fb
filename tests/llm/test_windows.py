import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from timbrel.llm import queries
from timbrel.llm import windows as W


def brute(rows, length=20):
    """doc_id -> (n_words, n_removed, kept words), for rows of different ids."""
    seen, out = {}, {}
    lists = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(lists):
        w = lists[i]
        for s in range(len(w) - length + 1):
            seen.setdefault(tuple(w[s : s + length]), (i, s))
    for i, w in lists.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] != (i, s):
                gone[s : s + length] = [True] * length
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def texts(r):
    word = lambda n: [r.choice("abcdefgh") + r.choice("xyzé") for _ in range(n)]
    p, q, line = word(70), word(200), word(20)
    out = [None, "", "short one", word(19), word(20), word(500), p, p, p[:19], p[1:20], p[:20], p[5:40] + p[5:40]]
    out += [word(r.randrange(30)) + p + word(r.randrange(30)) for _ in range(6)]
    out += [word(10) + q[lo:hi] + word(9) for lo, hi in ((0, 100), (50, 150), (81, 101), (82, 101), (0, 200), (180, 200), (181, 200))]
    out += [word(3) + line + word(4) + line for _ in range(9)]
    out += [["x"] * 19, ["x"] * 20, ["x"] * 21, ["x"] * 200, ["x", "y"] * 40, p[:30] + q[:30] + p[:30], word(40) * 3]
    for _ in range(25):  # few kinds of words: many short strings repeat, few long ones
        out.append([r.choice("uv") for _ in range(r.randrange(15, 90))])
    return [t if t is None or isinstance(t, str) else " ".join(t) for t in out]


def test_words_and_joined():
    rows = ["", " a  bb\tc ", "é\xa0x\n", "  ", "w" * 200 + " " + "w" * 201, "a", "bb c"]
    b = W.Words(pa.array(["zz", *(t.encode() for t in rows)], pa.binary()).slice(1))
    lists = [t.encode().split() for t in rows]
    assert b.sizes.tolist() == [len(w) for w in lists]
    assert [b.data[lo:hi].tobytes() for lo, hi in zip(b.begin, b.end)] == [w for x in lists for w in x]
    flat = [w for x in lists for w in x]
    assert len(set(b.keys.tolist())) == len(set(flat)) and all((b.keys[i] == b.keys[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    for mask in (np.ones(len(flat), bool), np.zeros(len(flat), bool), np.arange(len(flat)) % 2 == 0, np.arange(len(flat)) % 3 > 0):
        keep, want = iter(mask), []
        for x in lists:
            want.append(b" ".join([w for w in x if next(keep)]))
        assert b.joined(mask).to_pylist() == want
    assert W.Words(pa.array([], pa.binary())).sizes.tolist() == []


def test_strings_and_least_positions():
    w = np.arange(1, 60, dtype=np.uint64)
    for k in (1, 2, 3, 5, 10, 20):
        h = W.strings(w, k)
        assert len(h) == len(set(h.tolist())) == 60 - k
        assert W.strings(w[7 : 7 + k], k) == h[7] and W.strings(w[7 : 7 + k], k, 1) != h[7]
    r = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint64)
    for width in (1, 2, 7, 16):
        assert W.least_in(r, width).tolist() == [i + int(np.argmin(r[i : i + width])) for i in range(300 - width + 1)]
    assert len(W.strings(w[:3], 5)) == 0


@pytest.mark.parametrize("length,size", [(20, 1 << 20), (8, 1 << 20), (20, 300)])
def test_against_brute_force(spark, length, size, monkeypatch):
    monkeypatch.setattr(W, "BATCH_BYTES", size)
    rows = list(enumerate(texts(random.Random(6))))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, places int, kept string").repartition(3)
    got = W.drop_repeats(docs, length)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    want = brute(rows, length)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(v[1] for v in want.values()) > 1000


def test_query_on_the_given_tables(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_substring_dedup"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in brute(docs).items()}
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(30))
    b = a + " tail"
    rows = [(None, a), (3, a), (3, a), (2, b), (5, None), (5, ""), (9, " ".join(f"v{i % 700}" for i in range(40_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.n_words, r.n_removed) for r in W.drop_repeats(docs).collect()))
    # the null id comes first; rows equal in id and text are one document
    assert got == [("2", 31, 30), ("3", 30, 30), ("3", 30, 30), ("5", 0, 0), ("5", 0, 0), ("9", 40_000, 39_300), ("None", 30, 0)]
    same = spark.createDataFrame([(4, a), (4, b), (4, a)], "doc_id long, text string")
    removed = sorted((r.n_words, r.n_removed) for r in W.drop_repeats(same).collect())
    assert removed in ([(30, 0), (30, 0), (31, 30)], [(30, 30), (30, 30), (31, 0)])
    assert W.drop_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        W.drop_repeats(docs, 10)
