import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from timbrel.llm import suffixes as S


def brute(texts):
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + 400] for i in range(len(t) - 399))
    out = []
    for t in texts:
        drop = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                drop[i : i + 400] = True
        drop = drop[: len(t)]
        runs = int((np.diff(np.r_[0, drop.astype(int)]) == 1).sum())
        rest = bytes(b for b, d in zip(t, drop) if not d)
        out.append((len(t), int(drop.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def fixture():
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghij é\n") for _ in range(n))
    p, q = word(700), word(1500)
    texts = [None, "", "short", word(390), word(3000)]
    texts += [word(r.randint(0, 200)) + p + word(r.randint(0, 200)) for _ in range(8)]
    # partners that match more to the left, more to the right, or just short of the length
    for lo, hi in ((0, 900), (500, 1400), (100, 495), (100, 499), (100, 500), (300, 1200), (420, 820), (421, 819)):
        texts.append(word(50) + q[lo:hi] + word(60))
    texts += [q, q, p[:399], "x" * 1200, "x" * 450, "ab" * 500, "\0" * 401, "y" + "\0" * 400, "end" + p[-410:], p[:410] + "\0", p[:410]]
    texts.append(p[:500] + p[:500] + "tail")
    texts.append("é" * 300)
    return texts


@pytest.mark.parametrize("pieces", [1 << 20, 150])
def test_anchors_are_the_same_in_every_window(pieces, monkeypatch):
    monkeypatch.setattr(S, "PIECE", pieces)
    r = random.Random(5)
    common = bytes(r.randrange(97, 105) for _ in range(400))
    for _ in range(20):
        a = bytes(r.randrange(97, 105) for _ in range(r.randrange(300))) + common + b"zz"
        b = b"q" + common + bytes(r.randrange(97, 105) for _ in range(r.randrange(300)))
        x, y = (t.index(common) for t in (a, b))
        ha, hb = (dict(zip(*(v.tolist() for v in S.anchors(t)))) for t in (a, b))
        inside = {p - x for p in ha if x <= p <= x + 400 - S.GRAM}
        other = {p - y for p in hb if y <= p <= y + 400 - S.GRAM}
        assert inside & other
    assert len(S.anchors(b"a" * 399)[0]) == 0 and len(S.anchors(b"")[0]) == 0


def test_multikey_order_is_the_sorted_order():
    r = np.random.default_rng(1)
    words = r.integers(0, 3, (500, 6)).astype(np.uint64)
    order = S.multikey_order(words)
    got = [tuple(words[i]) for i in order]
    assert got == sorted(map(tuple, words)) and sorted(order) == list(range(500))
    assert len(S.multikey_order(np.zeros((0, 3), np.uint64))) == 0


@pytest.mark.parametrize("bucket", [24 << 20, 6000])
def test_removal_against_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", bucket)
    texts = fixture()
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, start int").repartition(3)
    got = {r.doc_id: tuple(r)[1:5] for r in S.remove_repeats(docs).collect()}
    want = brute([(t or "").encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_random_mixtures(spark):
    r = random.Random(11)
    parts = ["".join(r.choice("abc") for _ in range(r.choice([90, 130, 210, 330]))) for _ in range(7)]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 7))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:5] for x in S.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])


def test_no_rows_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(none).collect() == []
    same = spark.createDataFrame([(1, "k" * 500), (1, "k" * 500), (None, "w" * 10)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in S.remove_repeats(same).collect()) == [("1", 500), ("1", 500), ("None", 0)]


def test_only_windows_that_are_asked_for_are_hashed(spark):
    text = bytes(i * 7 % 251 for i in range(900))
    after, before = bytearray(text[400:800]), bytearray(text[128:528][::-1])
    rows = [(1, True, after, before, 20, 200, 10, 22, 199, 260), (2, False, after, before, 20, 200, None, None, 30, 30), (3, True, after, before, 20, 200, None, None, 260, 272)]
    kind = "row long, open boolean, after binary, before binary, lo long, hi long, far_from long, far_to long, near_from long, near_to long"
    got = S._windows(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.row, r.back) for r in got) == [(1, 20), (1, 21), (1, 22), (1, 199), (1, 200), (2, 30)]
    assert len({(r.h0, r.h1) for r in got}) == 6


def test_copies_of_a_passage_look_their_windows_up_once(spark, monkeypatch):
    """Rows of windows follow the places where surroundings differ, not the copies of what they share."""
    made, written = {}, S.written

    def counted(df, name):
        out = written(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(S, "written", counted)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, texts = word(1000), []
    for i in range(60):  # some end early, some begin late, each pair with text of its own beside it
        a, b = ((0, 560 + 7 * (i // 4)), (440 - 5 * (i // 4), 1000))[i % 2]
        texts.append(word(40) + passage[a:b] + word(40))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:5] for x in S.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])
    assert made["near"] and made["blocks"] + made["windows"] < 40 * made["near"], made
