"""Readers: pages, capture logs, sitemaps, robots files, jobs, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw page table; columns and filters are pushed into the scan."""
    return spark.read.parquet(path)


CAPTURE_SCHEMA = """
time bigint,
options struct<url: string, method: string, body: string, headers: map<string, string>,
  ignoreResponse: boolean, ignoreFailure: boolean, tryCount: int>,
result struct<status: int, headers: map<string, string>, body: string>
"""


def read_fetch_capture(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Recorded requests and answers, one row per request.

    ``form`` is `lines` (one record per line; files are split among tasks) or
    `document` (a JSON array or one object of any layout; read record by record).
    Without it a folder may hold files of both forms, each of which is one cell,
    so it is for small files.
    """
    if form is not None:
        if form not in ("lines", "document"):
            raise ValueError(f"unknown form: {form!r}")
        raw = spark.read.schema(T.StructType.fromDDL(CAPTURE_SCHEMA)).json(path, multiLine=form == "document")
    else:
        files = spark.read.text(path, wholetext=True).withColumn("value", F.trim(F.regexp_replace("value", r"^\s+", "")))
        first = F.regexp_extract("value", r"^([^\r\n]*)", 1)
        whole = F.col("value").startswith("[") | F.try_parse_json(first).isNull()  # an object over several lines
        parts = F.when(whole, F.array("value")).otherwise(F.split("value", r"\r?\n"))
        records = files.select(F.explode(parts).alias("part")).where("trim(part) <> ''")
        kind = T.ArrayType(T.StructType.fromDDL(CAPTURE_SCHEMA))  # a lone record reads as an array of one
        raw = records.select(F.explode(F.from_json("part", kind)).alias("r")).select("r.*")
    return raw.select(
        F.timestamp_millis("time").alias("time"),
        F.col("options.url").alias("url"), F.col("options.method").alias("method"),
        F.col("options.body").alias("request_body"),
        F.col("options.headers").alias("request_headers"),
        F.col("options.tryCount").alias("tries"), F.col("result.status").alias("status"),
        F.col("result.headers").alias("headers"), F.col("result.body").alias("body"))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Sitemap files, plain or gzip by suffix: ``file, xml``."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("xml"))


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """Robots files named ``<host>.txt``, or in folders ``host=<host>``: ``host, text``."""
    file = F.input_file_name()
    folder = F.regexp_extract(file, r"/host=([^/]+)/[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_extract(file, r"([^/]+)\.txt$", 1))
    return spark.read.text(path, wholetext=True).select(
        F.lower(F.coalesce(F.try_url_decode(name), name)).alias("host"), F.col("value").alias("text"))


def read_jobs(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """Job rows with the payload fields used by reports; ``data`` is JSON text."""
    jobs = spark.read.json(path) if path.rstrip("/").endswith(".json") else spark.read.parquet(path)
    return job_payload(jobs, mode)


def job_payload(jobs: DataFrame, mode: str | None = None) -> DataFrame:
    payload = F.try_parse_json("data")
    out = jobs.withColumns({
        "mode": F.try_variant_get(payload, "$.mode", "string"),
        "url": F.try_variant_get(payload, "$.url", "string")})
    return out if mode is None else out.where(F.col("mode") == mode)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
