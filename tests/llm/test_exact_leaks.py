import hashlib
import random
from collections import Counter, defaultdict

import pytest

from timbrel.llm import decontaminate as D
from timbrel.llm import exact as E
from timbrel.llm import queries


def low(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


@pytest.mark.parametrize("support", [0.001, 0.05, 0.5])
def test_groups_against_brute_force(spark, support):
    r = random.Random(2)
    rows = [(i, r.choice(["Abc", "aBC", "İx", "ix", "É", "é", "", None, "k" * 3000, str(i)])) for i in range(400)]
    rows += [(1000 + i, "HOT text" if i % 2 else "hot TEXT") for i in range(300)]
    docs = spark.createDataFrame([(a, b, "x", 5) for a, b in rows], "doc_id long, text string, digest string, row int").repartition(4)
    by = defaultdict(list)
    for i, t in rows:
        by[low(t)].append(i)
    got = {x.doc_id: x for x in E.groups(docs, support=support).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        x = got[i]
        assert (x.keep_id, x.group_size, x.kept) == (max(by[low(t)]), len(by[low(t)]), i == max(by[low(t)]))
        assert x.text_sha256 == hashlib.sha256(low(t).encode()).hexdigest()
    kept = E.dedup(docs, support=support)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(max(v) for v in by.values())


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(7, "a"), (7, "A"), (3, "a"), (None, "a"), (None, "b"), (None, "B"), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = E.groups(docs).collect()
    assert len(found) == len(rows) and Counter(x.text_sha256 for x in found if x.kept) == Counter({x.text_sha256: 1 for x in found})
    assert sorted(((x.doc_id, low(x.text)) for x in E.dedup(docs).collect()), key=str) == sorted([(7, "a"), (None, "b"), (9, "")], key=str)
    assert E.groups(docs.limit(0)).collect() == [] and E.dedup(docs.limit(0)).collect() == []


def words(t):
    import re
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def brute(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not w or not v:
                continue
            k = min(5, len(v))
            g, h = grams(w, k), grams(v, k)
            if not set(g) & set(h):  # similarity zero everywhere
                continue
            for s in range(max(1, len(g) - len(h) + 1)):
                x, y = Counter(g[s : s + len(h)]), Counter(h)
                both = sum((x & y).values())
                j = both / (sum(x.values()) + sum(y.values()) - both)
                if j >= least and j > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (j, s)
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(9)
    pool = ["".join(r.choice("etaoinshrdé") for _ in range(r.randint(2, 8))) for _ in range(600)]
    say = lambda n: [r.choice(pool) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([16, 30, 45, 60, 90])))) for i in range(25)]
    items += [(90, "one two three"), (91, ""), (92, None), (93, items[0][1]), (94, "a b a b a b a b a b a b a b a b")]
    docs = []
    for n in range(90):
        body = say(r.randint(0, 300))
        if n % 2:
            got = items[n % 25][1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.choice([0, len(got) - 1, r.randrange(len(got))])
                got[at : at + 1] = r.choice([[], ["new"], ["new", got[at]]])
            at = r.randint(0, len(body))
            body[at:at] = got
        docs.append((n, " ".join(body).capitalize()))
    docs += [(200, None), (201, ""), (202, "One, two THREE!"), (203, "zero one two three"), (204, "a b a b a b a b a b a b a b a b a b a b"), (205, items[3][1].upper() + "\n" + items[4][1])]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, item_id string, grams int").repartition(3)
    bench = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert len(want) > 30
    got = {(x.doc_id, x.item_id): (x.similarity, x.start) for x in D.leaks(frame, bench).collect()}
    assert set(got) == set(want)
    for k, (j, s) in want.items():
        assert got[k] == (pytest.approx(j), s)
    kept = D.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_leak_edges(spark):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (None, "v1 v2 v3 v4 v5 v6")], "item_id long, text string")
    text = "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 y v1 v2 v3 v4 v5 v6"
    docs = spark.createDataFrame([(None, text), (4, text), (4, "clean text of no interest"), (4, text)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.item_id) for x in D.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(None, 1), (None, None), (4, 1), (4, None)], key=str)
    assert [x.text for x in D.drop_leaks(docs, bench).collect()] == ["clean text of no interest"]
    assert D.leaks(docs.limit(0), bench).collect() == [] and D.leaks(docs, bench.limit(0)).collect() == []
    assert D.drop_leaks(docs, bench.limit(0)).count() == 4


def test_leaks_of_the_given_tables(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = queries.QUERIES["op10_benchmark_decontamination"](spark, folder).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in found} == {k: (round(j, 9), s) for k, (j, s) in want.items()}
