"""Views that the registered queries read, derived from the given tables.

Every view exists twice: as a DataFrame builder and, in ``CTE``, as the SQL text used by the
SQL twins. ``with_views`` puts the SQL views a query needs in front of its body.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.operators.ordered import dense_index
from timbrel.session import configure

MINUTE_US = 60_000_000
N_SUBJECTS = 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def minute_block(us: str = "us") -> Column:
    """Block of time-ordered rows: short enough for a very busy key, and a year has half a
    million of them at most."""
    return F.floor(F.col(us) / MINUTE_US)


def series_ev(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, t, x): one series per user, in time order."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("series_id"),
        micros("ts").alias("us"),
        "event_id",
        F.col("value").alias("x"),
    )
    return dense_index(events, ["series_id"], minute_block(), ["us", "event_id"]).select(
        "series_id", "t", "x"
    )


def signal_ev(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, t, x): ``series_ev`` centred per series and scaled to about +-1.

    Values have two decimals, so the mean is taken over whole hundredths: the result does not
    depend on the order of summation.
    """
    cents = F.round(F.col("x") * 100).cast("long")
    sums = (
        table(spark, folder, "events")
        .select(F.col("user_id").alias("series_id"), F.col("value").alias("x"))
        .groupBy("series_id")
        .agg(F.sum(cents).alias("_s"), F.count("x").alias("_n"))
    )
    return series_ev(spark, folder).join(sums, "series_id").select(
        "series_id", "t",
        ((cents * F.col("_n") - F.col("_s")) / (F.col("_n") * 10000)).alias("x"),
    )


def series_li(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, t, x): quantities per supplier, in shipping order."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.col("l_quantity").alias("x"), *order
    )
    # a block's totals are worth a join only if it has some rows: a day of a supplier has often one
    block = F.trunc("l_shipdate", "month")
    return dense_index(lines, ["series_id"], block, order).select("series_id", "t", "x")


def json_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def audits(df: DataFrame) -> DataFrame:
    """Attach the audit columns that follow from ``k``."""
    k = F.col("k")
    return df.select(
        "*",
        (1 + (k % 9) * 0.5).alias("quality"),
        ((k * 7) % 101).cast("double").alias("ood"),
        ((k * 13) % 101).cast("double").alias("sim_pd"),
        (100 - (k * 3) % 61).cast("double").alias("auth"),
        (k * 0.4).alias("snr"),
        ((k * 11) % 60).cast("double").alias("noise"),
        ((k * 17) % 101).cast("double").alias("coverage"),
        (k % 15).cast("double").alias("duration"),
        (k % 10 == 0).alias("clipped"),
    )


def screenings(spark: SparkSession, folder: str, embedding: bool = False) -> DataFrame:
    """One screening per event, with audits derived from the JSON column."""
    out = audits(
        table(spark, folder, "events").select(
            F.col("event_id").alias("screening_id"),
            F.col("user_id").alias("patient_id"),
            "ts",
            micros("ts").alias("us"),
            (F.least("value", F.lit(100.0)) / 100.0).alias("risk_score"),
            json_k().alias("k"),
        )
    )
    if not embedding:
        return out
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    return out.withColumn("vec_id", F.col("screening_id") % n).join(vectors, "vec_id")


def refs(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, cohort 0/1, embedding as array<double>)."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        (F.col("label") >= 5).cast("long").alias("cohort"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def subject_of(vec_id: Column) -> Column:
    return vec_id % N_SUBJECTS


def vec_name() -> Column:
    return F.concat(
        F.lit("rec_S"), subject_of(F.col("vec_id")).cast("string"), F.lit("_"),
        F.col("vec_id").cast("string"),
    )


def vec_long(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, i, v): vectors in long form."""
    return refs(spark, folder).select(
        "vec_id", "cohort", F.posexplode("embedding").alias("i", "v")
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, y, p): a label and a score."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").cast("long").alias("y"),
        F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"),
    )


def drawings(spark: SparkSession, folder: str) -> DataFrame:
    """(drawing_id, file_name, collection, label, p): named drawing files with a score."""
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    grp = F.when(ck % 2 == 1, "P").otherwise("H")
    shape = F.when(F.floor(ok / 4) % 2 == 0, "E").otherwise("O")
    name = (
        F.when(ok % 4 == 0, F.concat(
            F.lit("V"), F.format_string("%02d", ck % 100), grp, shape,
            (ok % 10).cast("string"), F.lit(".png")))
        .when(ok % 4 == 1, F.concat(
            F.format_string("%04d", ck), F.lit("-"), (ok % 9).cast("string"), F.lit(".jpg")))
        .when(ok % 4 == 2, F.concat(
            F.lit("sp"), (ck % 5).cast("string"), F.lit("-"), grp,
            (ok % 50).cast("string"), F.lit(".jpg")))
        .otherwise(F.concat(
            F.lit("mea"), (ck % 5).cast("string"), F.lit("-"), grp,
            (ok % 50).cast("string"), F.lit(".jpeg")))
    )
    return table(spark, folder, "orders").select(
        ok.alias("drawing_id"),
        name.alias("file_name"),
        F.when(ok % 4 == 0, "coded").when(ok % 4 == 1, "numbered").otherwise("tagged")
        .alias("collection"),
        (ck % 2).alias("label"),
        (F.col("o_totalprice") % 1000 / 1000).alias("p"),
    )


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, name, size): uploaded files."""
    ext = F.element_at(
        F.array(*[F.lit(e) for e in ("wav", "mp3", "webm", "ogg", "txt", "WAV")]),
        (F.col("page_id") % 6 + 1).cast("int"),
    )
    return table(spark, folder, "pages").select(
        "page_id",
        F.concat(F.lit("rec_"), F.col("page_id").cast("string"), F.lit("."), ext).alias("name"),
        (F.length("html").cast("long") * 2000).alias("size"),
    )


def attributions(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, i, value): deviation of every feature from its mean, long form."""
    long = vec_long(spark, folder)
    means = long.groupBy("i").agg(F.avg("v").alias("_m"))
    return long.join(means, "i").select(
        "vec_id", F.col("i").cast("long").alias("i"),
        F.round(F.col("v") - F.col("_m"), 9).alias("value"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, client, ts, us, status, duration): one request per event."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("client"),
        "ts",
        micros("ts").alias("us"),
        F.when(F.col("event_type") == "error", 429).otherwise(200).cast("long").alias("status"),
        (F.col("value") / 1000).alias("duration"),
        "event_type",
    )


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "series_ev": ((), """
        select user_id as series_id,
               row_number() over (partition by user_id order by ts, event_id) - 1 as t,
               value as x
        from events"""),
    "voiced_ev": (("series_ev",), """
        select series_id, row_number() over (partition by series_id order by t) - 1 as t, x
        from series_ev where x > 0"""),
    "signal_ev": (("series_ev",), """
        select series_id, t, (c * count(*) over w - sum(c) over w)::double
                 / (count(*) over w * 10000)::double as x
        from (select *, round(x * 100)::bigint as c from series_ev)
        window w as (partition by series_id)"""),
    "series_li": ((), """
        select l_suppkey as series_id,
               row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey,
                 l_linenumber, l_partkey, l_extendedprice) - 1 as t,
               l_quantity as x
        from lineitem"""),
    "screenings0": ((), """
        select event_id as screening_id, user_id as patient_id, ts, epoch_us(ts) as us,
               least(value, 100.0) / 100.0 as risk_score,
               cast(json_extract_string(props, '$.k') as bigint) as k
        from events"""),
    "screenings": (("screenings0",), """
        select *, 1 + (k % 9) * 0.5::double as quality, ((k * 7) % 101)::double as ood,
               ((k * 13) % 101)::double as sim_pd, (100 - (k * 3) % 61)::double as auth,
               k * 0.4::double as snr, ((k * 11) % 60)::double as noise,
               ((k * 17) % 101)::double as coverage, (k % 15)::double as duration,
               (k % 10 = 0) as clipped
        from screenings0"""),
    "screenings_emb": (("screenings",), """
        select s.*, e.vec_id, e.embedding::double[] as embedding
        from screenings s join embeddings e
          on s.screening_id % (select count(*) from embeddings) = e.vec_id"""),
    "refs": ((), """
        select vec_id, cast(label >= 5 as bigint) as cohort, embedding::double[] as embedding
        from embeddings"""),
    "vec_long": (("refs",), """
        select vec_id, cohort, unnest(range(len(embedding))) as i, unnest(embedding) as v
        from refs"""),
    "scores": ((), """
        select l.doc_id, l.quality::bigint as y, least(1.0, d.n_chars / 4000.0)::double as p
        from labels l join documents d on l.doc_id = d.doc_id"""),
    "drawings": ((), """
        select o_orderkey as drawing_id,
               case when o_orderkey % 4 = 0 then printf('V%02d', o_custkey % 100)
                      || case when o_custkey % 2 = 1 then 'P' else 'H' end
                      || case when (o_orderkey // 4) % 2 = 0 then 'E' else 'O' end
                      || (o_orderkey % 10) || '.png'
                    when o_orderkey % 4 = 1
                      then printf('%04d', o_custkey) || '-' || (o_orderkey % 9) || '.jpg'
                    when o_orderkey % 4 = 2 then 'sp' || (o_custkey % 5) || '-'
                      || case when o_custkey % 2 = 1 then 'P' else 'H' end
                      || (o_orderkey % 50) || '.jpg'
                    else 'mea' || (o_custkey % 5) || '-'
                      || case when o_custkey % 2 = 1 then 'P' else 'H' end
                      || (o_orderkey % 50) || '.jpeg' end as file_name,
               case o_orderkey % 4 when 0 then 'coded' when 1 then 'numbered' else 'tagged' end
                 as collection,
               o_custkey % 2 as label,
               o_totalprice % 1000 / 1000 as p
        from orders"""),
    "uploads": ((), """
        select page_id,
               'rec_' || page_id || '.'
                 || (['wav','mp3','webm','ogg','txt','WAV'])[page_id % 6 + 1] as name,
               length(html) * 2000 as size
        from pages"""),
    "attributions": (("vec_long",), """
        select vec_id, i, round(v - avg(v) over (partition by i), 9) as value
        from vec_long"""),
    "requests": ((), """
        select event_id, user_id as client, ts, epoch_us(ts) as us,
               case when event_type = 'error' then 429 else 200 end::bigint as status,
               value / 1000 as duration, event_type
        from events"""),
}


def with_views(views: str, body: str, extra: str = "") -> str:
    """``WITH`` the named views (and what they need) ``extra`` in front of ``body``."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for need in CTE[name][0]:
                add(need)
            done.append(name)

    for name in views.split():
        add(name)
    parts = [f"{name} as ({CTE[name][1].strip()})" for name in done]
    if extra:
        parts.append(extra.strip())
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
