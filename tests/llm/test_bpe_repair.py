import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from timbrel.llm import bpe as B
from timbrel.llm import repair as R

PATH = B.vocabulary_file()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark, folder):
    own = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(60).collect()]
    r = random.Random(1)
    letters = "ab'st \n\t\r é\xa0中12.,<|endoftext|>　\x85\x1c​ſ\0"
    own += ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]
    words = ["<|endoftext|>", " ", "a", "'ll", "  ", "\n\n", "don't", "x" * 90, "ab" * 70, "ñandú", "\U0001f600"]
    own += ["".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(200)]
    return own + [None, "", "z" * 5000, "<|endoftext|>"]


def test_encoding_equals_the_library(library, texts):
    coder = B.codec(PATH)
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        got = coder.encode(t or "")
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert coder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_both_ways_of_merging_agree():
    coder, r = B.Codec(PATH), random.Random(2)
    for _ in range(500):
        raw = bytes(r.choice(b"thaonest er\xc3\xa9\x80ing") for _ in range(r.randint(1, 120)))
        assert list(coder.join(raw)) == coder._merge_pairs(raw)
        assert b"".join(coder.forced_cuts(raw)) == raw


def test_cuts_are_where_no_token_has_the_pair():
    coder = B.codec(PATH)
    pairs = {p for t in coder.tokens.values() for p in zip(t, t[1:])}
    raw = "the 中文x9Qz\n".encode()
    cuts = coder.forced_cuts(raw)
    at = np.cumsum([len(x) for x in cuts])[:-1].tolist()
    assert at == [i for i in range(1, len(raw)) if (raw[i - 1], raw[i]) not in pairs and coder.inside.isdisjoint({(raw[i - 1], raw[i])})]


def test_round_trip_query_shape(spark, library, texts):
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)] + [(None, "x", 1, "n"), (0, "again", 1, "n")], "doc_id long, text string, ids int, n_tokens string")
    rows = {(r.doc_id, r.ids_sha256): r for r in B.round_trip(docs, PATH).collect()}
    assert len(rows) == len(texts) + 2
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = rows[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256((t or "").encode()).hexdigest())
    back = B.decode(B.encode(docs, PATH), PATH)
    assert sorted(r.text for r in back.collect()) == sorted((r.text or "") for r in docs.collect())
    assert B.round_trip(docs.limit(0), PATH).collect() == [] and B.encode(docs.limit(0), PATH).collect() == []


def test_cache_bound_changes_nothing(texts):
    small = B.Codec(PATH)
    small.pieces.most = small.after_blank.most = 3
    assert [small.encode(t or "") for t in texts[:80]] == [B.codec(PATH).encode(t or "") for t in texts[:80]]


def test_blocks_round_trip_and_random_access():
    r = random.Random(5)
    for n in range(120):
        docs = [np.array([r.choice([1, 1, 1, 2, 3, 90000]) for _ in range(r.choice([0, 1, 2, 50, 900]))], "<u4") for _ in range(r.randint(0, 6))]
        data = R.compress(docs)
        block = R.Block(data)
        assert block.documents == len(docs)
        for i, d in enumerate(docs):
            assert np.array_equal(block.document(i), d)
            a = r.randrange(len(d) + 1)
            z = r.randrange(a, len(d) + 1)
            assert np.array_equal(block.read(i, a, z), d[a:z])
    same = np.tile(np.array([7, 8, 9, 7, 8, 4], "<u4"), 2000)
    data = R.compress([same])
    assert len(data) < len(same) and (R.Block(data).lengths > 10).any()
    with pytest.raises(ValueError):
        R.Block(b"none" + data)
    with pytest.raises(ValueError):
        R.Block(data[:-4])


def test_files_against_the_library(spark, library, texts):
    rows = [(i * 3, t, 1, b"") for i, t in enumerate(texts)] + [(3, "again", 1, b""), (None, "nobody", 1, b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, data binary").repartition(5)
    written = R.write(docs, PATH, block_ids=700, shard_bytes=20000)
    assert written.select("shard").distinct().count() > 1 and written.count() > written.select("shard").distinct().count()
    got = sorted(R.read(written).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    left = {}
    for i, t, *_ in rows:
        left.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert list(r.ids) in left[r.doc_id]
        left[r.doc_id].remove(list(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert R.read(R.write(docs.limit(0), PATH)).collect() == []


def test_pairs_are_replaced_until_none_is_frequent():
    r = np.random.default_rng(9)
    line, passage = r.integers(3, 50_000, 37), r.integers(3, 50_000, 3000)
    docs = [np.tile(line, 3000).astype(np.uint32), *(passage.astype(np.uint32) for _ in range(30)), np.full(70_000, 7, np.uint32)]
    block = R.Block(R.compress(docs))
    assert all((a == b).all() for a, b in zip(block.all_documents(), docs))
    assert block.lengths.max() > 2000
    pairs = Counter(p for i in range(len(docs)) for s in [block.symbols[slice(*block._bounds(i))].tolist()] for p in zip(s, s[1:]))
    assert max(pairs.values(), default=0) < R.LEAST


def test_batches_encode_like_texts_alone(monkeypatch):
    coder = B.Codec(B.vocabulary_file())
    monkeypatch.setattr(B, "KNOWN", 3)
    monkeypatch.setattr(B, "WHOLE", 60)
    texts = [
        "", " ", "\n", "one two one", " led by a blank", "two  blanks", "a\nb\n\nc", "tab\tand　wide", "ends \n", "x" * 61,
        "it's 1,000 né 名前 \U0001f600! <|endoftext|> <|end", "\x1c a\x85b", "two one's", "a b", "été été"]
    for _ in range(2):
        assert coder.encode_all(texts) == [coder.encode(t) for t in texts]
    monkeypatch.setattr(coder, "join_whole", None)
    assert coder.encode_all(texts) == [coder.encode(t) for t in texts]


def test_rounds_look_only_at_what_may_be_frequent(monkeypatch):
    looked = []
    once = R._frequent
    monkeypatch.setattr(R, "_frequent", lambda key: looked.append(len(key)) or once(key))
    rng = np.random.default_rng(5)
    docs = [np.r_[rng.integers(1000, 40_000, 20_000), np.tile(rng.integers(3, 9, 12), 60)].astype(np.uint32) for _ in range(3)]
    got = R.Block(R.compress(docs))
    assert all(np.array_equal(got.document(i), d) for i, d in enumerate(docs))
    assert len(looked) > 2 and max(looked[1:]) < looked[0] / 10


def test_a_batch_looks_every_word_up_once():
    coder, r = B.Codec(B.vocabulary_file()), random.Random(4)
    words = ["one", "one's", "né", "a\nb", "c\nd\ne", "\0", "名前", "x" * 30]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(200)] + ["one", "a\nb", "lone first"]
    asked = []

    class Known(dict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

        def get(self, key, other=None):
            asked.append(key)
            return super().get(key, other)

    coder.known = Known()
    assert coder.encode_all(texts) == [coder.encode(t) for t in texts]
    assert asked and len(asked) == len(set(asked))
