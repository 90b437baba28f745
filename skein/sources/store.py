"""Tables on disk: versioned Parquet with a manifest, file scans with hashes, manifests with lock pins."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def workspace(spark: SparkSession, name: str) -> str:
    """A new path for tables that outlive a plan, in the folder that spark.checkpoint.dir names; on one machine, where that is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/skein-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a workspace and read back: for small tables that a plan uses more than once."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces the partitions that df has (the whole table without partition_by)."""
    out = df.withColumn("schema_version", F.lit(VERSION)).write.mode("overwrite")
    if partition_by:
        out = out.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    out.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table; rows of another version are refused."""
    df = spark.read.parquet(path)
    if df.where(F.col("schema_version") != VERSION).head(1):
        raise ValueError(f"{path} holds another version than {VERSION}")
    return df.drop("schema_version")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a declared schema; broken lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, path, size, sha256 and whether the first kilobyte has a PDF mark, of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.contains(F.substring("content", 1, 1024), F.lit(b"%PDF-")).alias("is_pdf"))


def verify_files(files: DataFrame, pins: DataFrame) -> DataFrame:
    """name, status: ok, changed, missing or unpinned."""
    joined = files.select("name", "sha256").join(pins.select("name", F.col("sha256").alias("pinned")), "name", "full_outer")
    return joined.select("name", F.when(F.col("pinned").isNull(), "unpinned").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("pinned"), "ok").otherwise("changed").alias("status"))


def overlay_pins(manifest: DataFrame, pins: DataFrame) -> DataFrame:
    """Manifest entries with the lock's hash and size where it has them."""
    p = pins.select("doc_id", F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    return manifest.join(p, "doc_id", "left").withColumn("sha256", F.coalesce("_sha", "sha256")).withColumn("size_bytes", F.coalesce("_size", "size_bytes")).drop("_sha", "_size")


def merge_pins(old: DataFrame, new: DataFrame) -> DataFrame:
    """The lock after a run: new pins, and old ones of documents that weren't seen."""
    n = new.select("doc_id", F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    return old.join(n, "doc_id", "full_outer").select("doc_id", F.coalesce("_sha", "sha256").alias("sha256"), F.coalesce("_size", "size_bytes").alias("size_bytes"))
