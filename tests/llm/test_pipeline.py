import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from timbrel.session import materialise


def test_stages_keep_columns_and_drop_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = docs.first()
    planted = [
        (90001, "".join(x.upper() if "a" <= x <= "z" else x for x in clean.text), "en", "src1", 3),  # equal but for case; the larger id stays
        (90002, "", "en", "src1", 0),
        (90003, None, None, None, None),
        (90004, " ".join(w for r in docs.collect()[3:9] for w in r.text.split()[:60]) + " " + bench[0], "en", "src2", 9),
    ]
    long = max(docs.collect(), key=lambda r: (r.lang == "en", len(r.text.split())))
    words = long.text.split()
    words[len(words) // 2] = "altered"
    planted.append((90005, " ".join(words), "en", "src0", 9))
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {}
    for name, stage in P.STAGES:
        rows = materialise(stage(spark, rows, folder), "stage")
        kept[name] = {r[0] for r in rows.select("doc_id").collect()}
        if name != "bpe":
            assert rows.columns == docs.columns
    assert {90002, 90003}.isdisjoint(kept["language_id"]) and len(kept["language_id"]) >= docs.count()
    assert 90001 in kept["exact_dedup"] and clean.doc_id not in kept["exact_dedup"]
    assert 90005 in kept["exact_dedup"] and 90005 not in kept["near_dedup"]
    assert 90004 in kept["near_dedup"] and 90004 not in kept["decontamination"]
    assert kept["bpe"] == kept["decontamination"]
    assert rows.where("not round_trips or n_tokens <> size(ids)").isEmpty()


def test_run_and_empty_input(spark, folder, tmp_path):
    assert P.run(spark, folder).count() > 100
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).collect() == []


def test_exact_dedup_twin(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, group_size, keep_id, kept, text_sha256 from ({entry.oracle_sql()['op8_exact_dedup']})").fetchall())
    got = entry.queries()["op8_exact_dedup"](spark, folder).select("doc_id", "group_size", "keep_id", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want


PER_DOCUMENT = [n for n in sorted(entry.queries()) if n.startswith("op") and n != "op10_benchmark_decontamination"]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_queries_give_every_document_a_row(spark, folder, name):
    want = sorted(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())
    got = entry.queries()[name](spark, folder).where("doc_id is not null").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == want
