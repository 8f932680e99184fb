import itertools
import random

import numpy as np
import pytest
import xxhash

from timbrel.llm import simhash as S
from timbrel.llm.components import components


def brute_fp(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_against_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, x) for x in range(2001, 2100)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = brute_components({x for e in edges for x in e if e[0] != e[1]}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_ball_links_join_all_within_two_bits(spark):
    r = random.Random(8)
    values = {r.getrandbits(64) for _ in range(30)}
    for v in list(values)[:12]:
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    values |= {0, 1 << 63, (1 << 63) | 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = S.ball_links(spark.createDataFrame([(0, v) for v in signed], "block int, value long"), 64).collect()
    for x in links:
        assert ((x.u ^ x.v) & (2**64 - 1)).bit_count() <= 2
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert brute_components(signed, [(x.u, x.v) for x in links]) == brute_components(signed, near)


def test_near_duplicates_against_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900, None), (901, ""), (902, "one TWO"), (903, "ONE two"), (904, "\t a\x0bb\n c "), (905, "a b c"), (906, "É x y"), (907, "é x y"), (None, "one two")]
    docs = spark.createDataFrame([(a, b, "x", 0) for a, b in rows], "doc_id long, text string, fp string, component int").repartition(3)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in S.near_duplicates(docs).collect()}
    prints = {(d, f"{brute_fp(t):016x}"): brute_fp(t) for d, t in rows}
    assert set(got) == set(prints)
    ids = [(d if d is not None else 10**9, k) for (d, k) in prints]
    value = dict(zip(ids, prints.values()))
    edges = [(a, b) for a, b in itertools.combinations(ids, 2) if (value[a] ^ value[b]).bit_count() <= 2]
    want = brute_components(ids, edges)
    assert got == {(None if d == 10**9 else d, k): want[d, k][0] for d, k in ids}
    assert S.near_duplicates(docs.limit(0)).collect() == []


def jaccard(a, b, k=5):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_drop_similar_keeps_one_of_each_group(spark):
    r = random.Random(6)
    words = ["".join(r.choice("etaoin") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows, group = [], {}
    for g in range(40):
        base = text(r.randint(80, 400))
        for k in range(r.choice([1, 1, 2, 3, 6])):
            copy = list(base)
            for _ in range(k and r.randint(0, max(1, len(base) // 120))):
                copy[r.randrange(len(copy))] = r.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    extra = [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "two words"), (1003, "Two  words")]
    docs = spark.createDataFrame([(a, b, "en", 1) for a, b in rows + extra], "doc_id long, text string, grams string, block int")
    kept = S.drop_similar(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert None in ids and 1002 in ids and 1003 not in ids and 1000 in ids and 1001 not in ids
    alone = {g for g in group.values() if sum(v == g for v in group.values()) == 1}
    assert all(i in ids for i, g in group.items() if g in alone)
    edges = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if group[a] == group[b] and jaccard(s, t) >= 0.8]
    want = {n for n, c in brute_components([a for a, _ in rows], edges).items() if n == c}
    assert want == {i for i in ids if i in group}


@pytest.mark.parametrize("n", [0, 1, 5, S.PIECE + 3])
def test_majority_counts_in_pieces(n):
    items = [str(i).encode() for i in range(n)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in items]
    bits = np.unpackbits(np.frombuffer(b"".join(x.to_bytes(8, "big") for x in h), np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=int) if n else np.zeros(64)
    assert S.majority(items, S._xxh64) == np.packbits(bits * 2 > n).tobytes()


def test_altered_copies_of_one_original_go(spark):
    """Copies at 0.8 to 0.9 of their original, most of them less similar to each other: only one document stays."""
    r = random.Random(12)
    words = ["".join(r.choice("etaoinsh") for _ in range(r.randint(3, 8))) for _ in range(5000)]
    base = [r.choice(words) for _ in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        copy = list(base)
        for k in r.sample(range(len(base)), 6):
            copy[k] = r.choice(words)
        rows.append((i, " ".join(copy)))
    assert all(jaccard(t, rows[0][1]) >= 0.8 for _, t in rows)
    assert sum(jaccard(a, b) >= 0.8 for (_, a), (_, b) in itertools.combinations(rows[1:60], 2)) < 600
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [x.doc_id for x in S.drop_similar(docs).collect()] == [0]


def test_lines_repeated_a_different_number_of_times_do_not_hide_a_copy(spark):
    """Similarity is that of sets, so repetitions change nothing."""
    r = random.Random(15)
    words = ["".join(r.choice("etaoinsh") for _ in range(r.randint(3, 8))) for _ in range(5000)]
    rows = []
    for i in range(12):
        body, line = ([r.choice(words) for _ in range(n)] for n in (110, 12))
        for k, times in enumerate((2, 12, 40)):
            rows.append((3 * i + k, " ".join(body + line * times)))
    assert all(jaccard(rows[i - i % 3][1], t) == 1 for i, (_, t) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in S.drop_similar(docs).collect()) == list(range(0, 36, 3))


def test_cut_and_extended_copies_go(spark):
    """Copies just above 0.8 whose head or tail is gone, or that have a header or footer more."""
    r = random.Random(21)
    text = lambda n: ["".join(r.choice("etaoinsh") for _ in range(r.randint(3, 8))) for _ in range(n)]
    rows = []
    for i in range(60):
        base = text(r.choice([64, 404]))
        n = len(base) - 4
        cut, more = n // 5, n // 4
        copy = [base[cut:], base[:-cut], text(more) + base, base + text(more)][i % 4]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        assert 0.8 <= jaccard(rows[-1][1], rows[-2][1]) < 0.81
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in S.drop_similar(docs).collect()) == list(range(0, 120, 2))


def test_pairs_inside_a_loose_group_are_found(spark):
    """Forty pairs of versions of one template: partners above 0.8, all others below, so no hub links them."""
    r = random.Random(33)
    text = lambda n: ["".join(r.choice("etaoinsh") for _ in range(r.randint(3, 8))) for _ in range(n)]
    template, rows = text(330), []
    for i in range(40):
        own = template + text(70)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-1] + text(30)))]
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if jaccard(s, t) >= 0.8]
    assert links == [(2 * i, 2 * i + 1) for i in range(40)]
    assert all(jaccard(rows[0][1], t) > 0.6 for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in S.drop_similar(docs).collect()) == list(range(0, 80, 2))


def test_near_copies_come_through_the_fingerprints(spark, monkeypatch):
    """Documents with like fingerprints are verified and linked by them, bands left out; those that only look alike are not."""
    monkeypatch.setattr(S, "_all_pairs", lambda shared: shared.select(shared.doc_id.alias("a"), shared.doc_id.alias("b")).limit(0))
    r = np.random.default_rng(12)
    base = [f"w{x}" for x in r.integers(0, 50_000, 3000)]
    other = [f"v{x}" for x in r.integers(0, 50_000, 3000)]
    copy = [*base[:1500], "altered", *base[1501:]]
    docs = spark.createDataFrame([(5, " ".join(base)), (7, " ".join(copy)), (9, " ".join(other)), (None, " ".join(base))], "doc_id long, text string")
    prints = {x.doc_id: x.component_id for x in S.near_duplicates(docs).collect()}
    assert prints[7] == 5 and prints[9] == 9
    assert sorted(map(tuple, S.similar_pairs(docs).distinct().collect())) == [(5, 7)]


def test_stars_need_no_round_and_long_chains_settle(spark):
    stars = [(1, 5), (6, 1), (2, 9), (2, 9), (3, 3)]
    got = components(spark.createDataFrame(stars, "a long, b long"), "a", "b", rounds=1)
    assert {x.node: x.component for x in got.collect()} == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2}
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (100, 80)]
    got = components(spark.createDataFrame(chain, "a long, b long"), "a", "b")
    assert {x.node: x.component for x in got.collect()} == {i: 0 for i in range(41)} | {i: 80 for i in (80, 90, 100)}


def test_altered_copies_below_the_similarity_are_told_apart_by_their_parities(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for at in rng.sample(range(100), 3):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    rows.append((60, " ".join([*base, "tail"])))
    sets = {i: set(S.shingles(t.encode(), 5)) for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if like(a, b) >= 0.8}
    assert len(want) < 100
    tried, verified = [], S._verified
    monkeypatch.setattr(S, "_verified", lambda pairs, *rest: (tried.extend(map(tuple, pairs.collect())), verified(pairs, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = components(S.similar_pairs(docs), "a", "b")
    assert {(r.component, r.node) for r in found.collect()} >= {(0, 60)}
    assert len(set(tried)) < len(want) + 60  # of 1830 pairs; parities lose none that is similar
    for a, b in want:
        p, q = (np.unpackbits(np.frombuffer(S.parities(S._grams([dict(rows)[k].encode()], 5)), np.uint8)) for k in (a, b))
        assert (p != q).sum() <= len(sets[a] ^ sets[b]) <= (len(sets[a]) + len(sets[b])) / 9 + 1e-6
