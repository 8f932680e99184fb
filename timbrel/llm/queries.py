"""The corpus queries with their production parameters, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from timbrel.llm import align, bpe, decontaminate, exact, lang_id, licences, lm_score, periods, quality, repair, simhash, suffixes, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def op1(spark, folder):
    """Web pages (host, suffix, markup) and documents (source, declared language), each under its own id."""
    pages = table(spark, folder, "pages")
    markup = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    webs = lang_id.identify(pages, body, F.nullif(markup, F.lit("")), lang_id.host_of(F.col("url")), keep=("page_id",))
    docs = lang_id.identify(table(spark, folder, "documents"), F.col("text"), F.col("lang"), F.col("source"), False, keep=("doc_id",))
    said = ("language", "probability", ((F.col("language") != "und") & (F.col("probability") >= lang_id.MIN_PROBABILITY)).alias("kept"))
    return docs.select(F.col("row.doc_id"), F.lit(None).cast("long").alias("page_id"), *said).unionByName(
        webs.select(F.lit(None).cast("long").alias("doc_id"), F.col("row.page_id"), *said))


@query("op2_simhash_near_dedup")
def op2(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


GRADES = 3  # 0 toxic, 1 poor, 2 good


@query("op3_quality_grade")
def op3(spark, folder):
    """Every document's grade from a model of the labels: toxic below poor below good."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = quality.train(docs, labels.select("doc_id", grade.alias("grade")), GRADES)
    return quality.score(docs, model)


@query("op4_bpe_round_trip")
def op4(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), bpe.vocabulary_file())


@query("op5_suffix_array_dedup")
def op5(spark, folder):
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query("op6_repair_token_files")
def op6(spark, folder):
    return repair.read(repair.write(table(spark, folder, "documents"), bpe.vocabulary_file()), with_ids=False)


@query("op7_lm_cross_entropy_difference")
def op7(spark, folder):
    """Documents labelled good are the target, all documents the background."""
    good = table(spark, folder, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, folder, "documents"), good)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op8_exact_dedup", f"""
    with d as (select doc_id, sha256({LOWERED}) as h from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
        doc_id = max(doc_id) over w as kept, h as text_sha256
    from d window w as (partition by h)""")
def op8(spark, folder):
    return exact.groups(table(spark, folder, "documents"))


@query("op9_licence_scan")
def op9(spark, folder):
    return licences.licences(table(spark, folder, "documents"))


@query("op10_benchmark_decontamination")
def op10(spark, folder):
    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start", "similarity")


@query("op11_substring_dedup")
def op11(spark, folder):
    found = windows.drop_repeats(table(spark, folder, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def alignment(docs: DataFrame) -> DataFrame:
    """The links of both tokenizers with the groups reduced to their digest."""
    def digest(found: DataFrame) -> DataFrame:
        sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        return found.withColumn("groups_sha256", sha).drop("groups")

    return align.link_strength(docs, bpe.vocabulary_file(), bpe.vocabulary_file("piece_bpe_32k.model"), digest=digest).drop("pairs", "times")


@query("op12_tokenizer_alignment")
def op12(spark, folder):
    return alignment(table(spark, folder, "documents"))


@query("op13_periodic_runs")
def op13(spark, folder):
    """Every document's periodic runs, with every tenth document made periodic by the checksum of its id."""
    found = periods.periodic_runs(periods.with_planted_runs(table(spark, folder, "documents")))
    best = found.withColumn("best", periods.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periods.run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
