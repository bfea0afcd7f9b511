"""Writers and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import url as U

# Output fields a document may carry, by the format that asks for them.
FORMAT_FIELDS = {
    "markdown": "markdown", "html": "html", "rawHtml": "raw_html", "links": "links",
    "images": "images", "metadata": "metadata", "attributes": "attributes",
    "changeTracking": "change_status",
}


def coerce_formats(docs: DataFrame, formats, keys=("page_id", "url")) -> DataFrame:
    """Keeps the key columns and the fields of the asked formats."""
    unknown = set(formats) - set(FORMAT_FIELDS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    wanted = [FORMAT_FIELDS[f] for f in FORMAT_FIELDS if f in formats]
    return docs.select(*[k for k in keys if k in docs.columns],
                       *[c for c in wanted if c in docs.columns])


FOLDERS = 64
FILE_BYTES = 256 << 20


def write_documents(docs: DataFrame, path: str, formats, folders: int = FOLDERS, file_bytes: int = FILE_BYTES,
                    mode: str = "overwrite") -> None:
    """Writes the asked fields by registrable domain, in a fixed number of folders.

    A folder (``folder``) holds the domains of one hash; ``domain`` is a column of
    its files, which are sorted by it.  The bytes of each domain are counted first:
    a domain of more than ``file_bytes`` is dealt to as many tasks as it needs, the
    others of a folder go to one.
    """
    rows = U.with_domain(coerce_formats(docs, formats), _site=U.host("url"))
    rows = rows.withColumn("domain", F.coalesce("_site", F.lit("none"))).drop("_site").withColumn(
        "folder", F.pmod(F.xxhash64("domain"), F.lit(folders)).cast("int"))
    held = [F.coalesce(F.octet_length(F.col(c) if t in ("string", "binary") else F.to_json(F.struct(c))), F.lit(0)).cast("long")
            for c, t in rows.dtypes]
    large = rows.groupBy("domain").agg(F.sum(sum(held[1:], held[0])).alias("_bytes")).where(F.col("_bytes") > file_bytes).select(
        "domain", F.ceil(F.col("_bytes") / file_bytes).cast("int").alias("_tasks"))
    dealt = rows.join(large, "domain", "left").withColumn("_task", F.when(F.col("_tasks").isNotNull(), F.concat_ws(
        " ", "domain", F.pmod(F.xxhash64(*rows.columns[:2]), "_tasks").cast("string"))).otherwise(""))
    (dealt.repartition("folder", "_task").sortWithinPartitions("folder", "domain").drop("_tasks", "_task")
     .write.mode(mode).partitionBy("folder").parquet(path))


def merge_rows(current: DataFrame | None, batch: DataFrame, keys, update: bool = True,
               order: str | None = None) -> DataFrame:
    """Insert-or-update (or insert-or-ignore) by key, as a new table version.

    Of several batch rows of one key an update keeps the last by ``order``, an
    ignore the first; without ``order``, and among ties, the columns decide.
    """
    keys = list(keys)
    columns = current.columns if current is not None else [c for c in batch.columns if c != order]
    rest = [c for c in columns if c not in keys]
    fresh = batch.select(*keys, F.struct(*[F.col(c) for c in ([order] if order else [])], *keys, *rest).alias("_by"),
                         F.struct(*columns).alias("_row"))
    pick = F.max_by if update else F.min_by
    fresh = fresh.groupBy(*keys).agg(pick("_row", "_by").alias("_row")).select("_row.*")
    if current is None:
        return fresh
    if update:
        return current.join(fresh.select(*keys), keys, "left_anti").select(*columns).unionByName(fresh)
    return current.unionByName(fresh.join(current.select(*keys), keys, "left_anti").select(*columns))


def _latest(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version, as named by the pointer file."""
    jvm, context = spark._jvm, spark.sparkContext
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    fs = pointer.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return None
    return spark.read.text(str(pointer)).first()[0]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    version = _latest(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{version}")


def upsert_table(batch: DataFrame, path: str, keys, update: bool = True,
                 version: str | int | None = None, order: str | None = None) -> str:
    """Writes the next version of a table and points to it.

    Readers keep the old version until the pointer file is replaced in one
    rename.  Inside ``foreachBatch`` pass the epoch as ``version``: epochs grow,
    so one that is not above the current version was applied and is skipped.
    """
    spark = batch.sparkSession
    current = _latest(spark, path)
    name = f"v-{version if version is not None else uuid.uuid4().hex}"
    if current is not None and (name == current or (
            name[2:].isdigit() and current[2:].isdigit() and int(name[2:]) <= int(current[2:]))):
        return current
    rows = merge_rows(spark.read.parquet(f"{path}/{current}") if current else None, batch, keys, update, order)
    rows.write.mode("overwrite").parquet(f"{path}/{name}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside, target = hadoop.Path(f"{path}/.CURRENT-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/CURRENT")
    config = spark.sparkContext._jsc.hadoopConfiguration()
    out = target.getFileSystem(config).create(aside, True)
    out.write(bytearray(name, "utf-8"))
    out.close()
    rename = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(target.getFileSystem(config).getUri(), config)
    context.rename(aside, target, options)
    return name
