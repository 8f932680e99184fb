import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from timbrel.llm import align as A
from timbrel.llm import queries
from timbrel.llm.bpe import byte_letters

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(FILES[0])
    one.encode_special_tokens = True
    return one, SentencePieceProcessor(model_file=FILES[1])


def whole(libraries, text):
    """(ids, bytes of every token) of both sides, by the libraries on the whole text."""
    one, two = libraries
    letters = byte_letters()
    a = one.encode(" " + text, add_special_tokens=False)
    b = two.encode(text)
    names = [two.id_to_piece(i) for i in b]
    return (a.ids, [bytes(letters[x] for x in t) for t in a.tokens]), (
        b, [bytes([int(n[3:5], 16)]) if two.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)])


def brute(libraries, texts):
    rows, counts = [], Counter()
    for text in texts:
        links, groups = [], []
        if text:
            (a, x), (b, y) = whole(libraries, text)
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ends = lambda t: [sum(map(len, t[: i + 1])) for i in range(len(t))]
                p, q = ends(x), ends(y)
                links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                         if max(p[i] - len(x[i]), q[j] - len(y[j])) < min(p[i], q[j])]
                lo = 0
                for e in sorted(set(p) & set(q)):
                    groups.append(",".join(str(a[i]) for i in range(len(a)) if lo < p[i] <= e) + "|" + ",".join(str(b[j]) for j in range(len(b)) if lo < q[j] <= e))
                    lo = e
            else:
                a = b = []
        else:
            a = b = []
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in rows]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "a\n  b\n\n c", "x\n\t y", "　x  y", "日本語のテキスト", "\U0001F600\U0001F469‍\U0001F467 zß",
    "é é ﬁ ²", "a▁b", "<s> x </s><0x41> <|endoftext|>", "\0a\x07", "don't 'save' it's 'll", "𐍈𐎀 𒀀", "ab" * 300, "word " * 50 + "w" * 200, "!!! ... --- $$ 12345 1.5e-3",
]


def noise(r, n=150):
    letters = "ab ééß日本\U0001F600 \t\n  '.,x1　\xa0▁"
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_segments_join_to_the_whole_encoding(libraries):
    texts = [t for t in ODD if t] + noise(random.Random(1), 1500)
    for t, x in zip(texts, A.store(*FILES).align([" " + t for t in texts])):
        (a, _), (b, q) = whole(libraries, t)
        if b"".join(q) != (" " + t).encode():
            assert None in x
            continue
        groups = [g.split("|") for e in x for g in e[1].split(";")]
        assert [[int(i) for g in groups for i in g[k].split(",")] for k in (0, 1)] == [a, b]


def test_coarse_cuts_and_decoded_bytes():
    def ends(raw, spans, tokens):
        found = A.token_ends(raw, *A.np.array(spans).T, tokens)
        return found if found is None else found.tolist()

    assert ends(b"abc", [(0, 1), (1, 3)], [b"a", b"bc"]) == [1, 3]
    assert ends("é".encode(), [(0, 2), (0, 2)], ["é".encode()[:1], "é".encode()[1:]]) == [1, 2]
    assert ends(b" \xf0\x9f", [(0, 1), (1, 1), (1, 3)], [b" ", b"\xf0", b"\x9f"]) == [1, 2, 3]
    assert ends(b"ab", [(0, 2), (2, 2)], [b"a", b"b"]) == [1, 2]  # ranges that the bytes correct
    assert ends(b"ab", [(0, 1)], [b"a"]) is None


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent,batch", [(500_000, 2 << 20), (40, 300)])
def test_links_against_brute_force(spark, libraries, frequent, batch, monkeypatch):
    monkeypatch.setattr(A, "FREQUENT", frequent)
    monkeypatch.setattr(A, "BATCH_BYTES", batch)
    texts = ODD + noise(random.Random(2)) + ["the cat sat on the mat and the dog"] * 30
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string").repartition(3)
    got = queries.alignment(docs).select(*COLUMNS).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute(libraries, texts)


def test_query_on_the_given_tables(spark, folder, libraries):
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(queries.QUERIES["op12_tokenizer_alignment"](spark, folder).select(*COLUMNS).collect())
    assert [r.doc_id for r in got] == [d.doc_id for d in docs]
    for r, d in zip(got, docs):
        if len(d.text or "") < 1200:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (lambda x: (*x[:4], x[6]))(brute(libraries, [d.text])[0])
    assert sum(r.n_links for r in got) > 100_000


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 30_000
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (1, None), (2, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = A.link_strength(docs, *FILES).collect()
    assert sorted((str(r.doc_id), r.n_a > 0, r.n_links > 80_000) for r in got) == [("1", False, False), ("1", True, False), ("1", True, False), ("2", True, True), ("None", True, False)]
    assert A.link_strength(docs.limit(0), *FILES).collect() == []


def test_sides_and_segments_agree_however_they_are_read(monkeypatch):
    texts = ["one two\tthree", "a  b", "line \n next", "", "x" * 50 + " y", "名前 é\xa0 z", "<|endoftext|> 1,000 'll", "  w\x85 v", "▁ ▁a"]
    for t in texts:
        assert [" " + s for s in A.segmented(t and " " + t)] == A.SEGMENTS.findall(t and " " + t)
    one, two = A.ByteLevel(FILES[0]), A.Pieces(FILES[1])
    assert one.join is not None
    parts = [[" " + s for s in A.segmented(" " + t)] for t in texts if t and t[-1] not in A.SPACES and "▁" not in t]
    plain = [A.entries(one, two, p) for p in parts]
    monkeypatch.setattr(A, "WHOLE", 0)  # every segment by the library and its offsets
    assert [A.entries(one, two, p) for p in parts] == plain and None not in sum(plain, [])
