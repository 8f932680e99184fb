"""Scans and sinks: feature and point files, labelled folders, caches, logs, metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from timbrel.functions import fixed
from timbrel.functions.scalars import drawing, drawing_pools
from timbrel.session import scratch  # noqa: F401

# column names without characters that need quoting, in file order
FEATURE_COLUMNS = (
    "fo_mean", "fhi", "flo", "jitter_pct", "jitter_abs", "rap", "ppq", "ddp", "shimmer_local",
    "shimmer_db", "apq3", "apq5", "apq11", "dda", "nhr", "hnr", "rpde", "dfa", "spread1",
    "spread2", "d2", "ppe",
)
FILE_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in fixed.VOICE_FEATURES]
    + [T.StructField("status", T.IntegerType())]
)
POINT_SCHEMA = T.StructType(
    [
        T.StructField("pca_x", T.DoubleType()), T.StructField("pca_y", T.DoubleType()),
        T.StructField("status", T.IntegerType()),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


# --- files of features and points ---------------------------------------------------------------


def read_features(
    spark: SparkSession, path: str, required: Sequence[str] = (*fixed.VOICE_FEATURES, "status")
) -> DataFrame:
    """Voice feature CSV with header, renamed; jitter becomes percent.

    The header decides which columns there are; a missing required one is an error.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = set(required) - set(header)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    known = {f.name: f for f in FILE_SCHEMA.fields}
    schema = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in header])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    renamed = raw.select(
        *(["name"] if "name" in header else []),
        *[
            F.col(f"`{source}`").alias(name)
            for source, name in zip(fixed.VOICE_FEATURES, FEATURE_COLUMNS)
            if source in header
        ],
        "status",
    )
    if "jitter_pct" in renamed.columns:
        renamed = renamed.withColumn("jitter_pct", F.col("jitter_pct") * 100)
    return renamed


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Projected points (x, y, status); a missing file gives an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], "x double, y double, status int")
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col("pca_x").cast("double").alias("x"), F.col("pca_y").cast("double").alias("y"),
        F.col("status").cast("int").alias("status"),
    )


def write_points(df: DataFrame, path: str) -> None:
    df.select("pca_x", "pca_y", "status").write.mode("overwrite").option("header", True).csv(path)


def compute_or_reuse(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    """Read the table at ``path``; compute and write it first when it is absent."""
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --- folders ----------------------------------------------------------------------------------


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def folder_label(path: Column) -> Column:
    """0 below ``healthy/``, 1 below ``parkinsons/``, else null."""
    folder = F.regexp_extract(path, r"(?:^|/)(healthy|parkinsons)/[^/]+$", 1)
    return F.when(folder == "healthy", 0).when(folder == "parkinsons", 1)


def labelled_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """Keep audio files of the two labelled folders and attach ``label``."""
    return (
        paths.filter(extension(F.col(path)).isin("wav", "mp3"))
        .withColumn("label", folder_label(F.col(path)))
        .filter(F.col("label").isNotNull())
    )


LISTING = "path string, modificationTime timestamp, length long"


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length) below a folder; file contents are not read."""
    try:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        return reader.load(folder).select("path", "modificationTime", "length")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING)


def labelled_files(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled recordings below a folder; an empty typed table when there are none."""
    return labelled_paths(list_files(spark, folder))


def drawing_catalogue(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Image files with kind and subject, one row per pool they belong to."""
    images = files.filter(extension(F.col(name)).isin(*fixed.IMAGE_EXTENSIONS))
    d = drawing(F.col(name), F.col("collection"))
    return (
        images.withColumn("_d", d)
        .select(
            *files.columns, F.col("_d.subject").alias("subject"),
            F.explode_outer(drawing_pools(F.col("_d.kind"))).alias("pool"),
        )
        .filter(F.col("pool").isNotNull())
    )


def expired(
    files: DataFrame, as_of_us: int, us: Column, path: str = "path", keep_seconds: int = 3600
) -> DataFrame:
    """Files older than the retention time with their age; dot-files stay."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    age = (F.lit(as_of_us) - us) / 1e6
    return files.withColumn("age_seconds", age).filter(
        ~name.startswith(".") & (F.col("age_seconds") > keep_seconds)
    )


# --- logs and metrics ------------------------------------------------------------------------

LOG_SCHEMA = (
    "timestamp string, method string, path string, status_code long, client_ip string, "
    "duration_seconds double"
)


def log_lines(requests: DataFrame) -> DataFrame:
    """One JSON object per request in column ``value``."""
    names = [f.split()[0] for f in LOG_SCHEMA.split(", ")]
    rounded = requests.withColumn(
        "duration_seconds", F.rint(F.col("duration_seconds") * 1e4) / 1e4
    )
    return rounded.select(F.to_json(F.struct(*names)).alias("value"))


def write_log(requests: DataFrame, path: str) -> None:
    log_lines(requests).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def metrics_document(metrics: DataFrame, model: str, values: Sequence[str]) -> DataFrame:
    """One nested JSON document {model: {metric: value}} in column ``value``.

    One entry per model: the document is as small as the list of models.
    """
    entry = F.struct(F.col(model).alias("key"), F.struct(*values).alias("value"))
    return metrics.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value")
    )


def write_metrics(metrics: DataFrame, path: str, model: str, values: Sequence[str]) -> None:
    metrics_document(metrics, model, values).write.mode("overwrite").text(path)
