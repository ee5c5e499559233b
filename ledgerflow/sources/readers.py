"""Readers. Columns and limits are part of the plan, so scans are pruned by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import relative_time


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, limit: int | None = None, sep: str = ",") -> DataFrame:
    """All values as text; casts to the dictionary count what fails. A limit reads the first rows."""
    df = spark.read.csv(path, header=True, sep=sep)
    df = df.select(*[f"`{c}`" for c in columns if c in df.columns]) if columns else df
    return df.limit(limit) if limit is not None else df


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_family(spark: SparkSession, paths: dict[str, str]) -> DataFrame | None:
    """Files of one kind, dataset -> path, each row tagged with its dataset; missing files are left out."""
    out = None
    for dataset, path in paths.items():
        if _exists(spark, path):
            df = read_csv(spark, path).withColumn("dataset", F.lit(dataset))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def pipe_files(spark: SparkSession, folder: str) -> list[str]:
    """Files under folder whose first line is the header of pipe-delimited transactions or customers."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(folder)
    first = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), "value").where("start = 0")
    heads = first.groupBy("path").agg(F.min_by("value", "i").alias("head"))
    sep = F.instr("head", "|") > 0
    found = heads.where(sep & (F.contains("head", F.lit("trans_num")) | F.contains("head", F.lit("unix_time"))) & (F.contains("head", F.lit("cc_num")) | F.contains("head", F.lit("first|"))))
    return sorted(r["path"] for r in found.select("path").collect())  # file names


def read_generated(spark: SparkSession, folder: str) -> DataFrame | None:
    paths = pipe_files(spark, folder)
    return read_csv(spark, paths, sep="|") if paths else None


def read_documents(spark: SparkSession, path: str, schema: str, format: str = "json", named_only: bool = False, limit: int | None = None, **options) -> DataFrame:
    """Documents with optional fields; other formats (a document store's connector) take the same arguments."""
    df = spark.read.format(format).schema(schema).options(**options).load(path)
    df = df.where(F.col("merchant_clean_name").isNotNull()) if named_only else df
    return df.limit(limit) if limit is not None else df


def read_enriched(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Parquet rows; event_time is derived only where the file has none."""
    df = spark.read.parquet(path)
    if "event_time" not in df.columns:
        df = df.withColumn("event_time", F.timestamp_seconds("event_time_ts") if "event_time_ts" in df.columns else relative_time(F.col("event_time_ts_raw")))
    return df.limit(limit) if limit is not None else df


def stream_payments(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """The payments topic as typed rows; needs the Kafka package on the session."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("p")).select("p.*")


def stream_files(spark: SparkSession, folder: str, schema, per_trigger: int = 1, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(format).load(folder)
