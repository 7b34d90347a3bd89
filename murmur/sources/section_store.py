"""Stored sections in hash buckets: an upsert writes only the buckets it touches.

``data`` holds a folder for each version and bucket that was written; ``manifest`` is an append-only
table that lists, for each version, the folder of every bucket. A version exists once its
manifest rows do, and these arrive as one file, so a reader sees a version whole or not at all.
There is one writer at a time; what a broken upsert left behind is overwritten by the next.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmur.operators.corpus import upsert_sections

MANIFEST = "version long, bucket int, path string, buckets int, schema string"
KEYS = ("store_version", "store_bucket")  # folder names, left out of what is read


def create(spark: SparkSession, root: str, sections: DataFrame, buckets: int = 256) -> int:
    """First version of a store; ``section_id`` is unique and not null.

    Buckets are hashes of single ids, so a document with a third of all sections is spread.
    Choose ``buckets`` for the rows expected: a bucket is what one task rewrites.
    """
    columns = [f for f in sections.schema if f.name not in KEYS]
    _commit(spark, root, 1, _write(sections, root, 1, buckets), buckets, StructType(columns).json())
    return 1


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Sections of a version, by default the latest."""
    entry = _entry(spark, root, version)
    return _rows(spark, root, entry, list(entry["paths"].values()))


def upsert(spark: SparkSession, root: str, current: DataFrame) -> int:
    """Next version: as ``upsert_sections``; buckets without a row of ``current`` keep their folder.

    Returns the version; an empty ``current`` makes no new one.
    """
    entry = _entry(spark, root, None)
    bucket = _bucket(entry["buckets"])
    touched = [r[0] for r in current.select(bucket).distinct().collect()]  # at most all buckets
    if not touched:
        return entry["version"]
    stored = _rows(spark, root, entry, [entry["paths"][b] for b in touched if b in entry["paths"]])
    version = entry["version"] + 1
    merged = upsert_sections(stored, current).select(*stored.columns)
    paths = {**entry["paths"], **_write(merged, root, version, entry["buckets"])}
    _commit(spark, root, version, paths, entry["buckets"], entry["schema"])
    return version


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("section_id").cast("string")), F.lit(buckets)).cast("int")


def _write(sections: DataFrame, root: str, version: int, buckets: int) -> dict[int, str]:
    """Folders of the buckets that got rows."""
    folder = f"{root}/data/{KEYS[0]}={version}"
    (sections.withColumn(KEYS[1], _bucket(buckets)).repartition(KEYS[1])
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(KEYS[1]).parquet(folder))
    spark = sections.sparkSession
    if spark.read.schema(sections.schema).parquet(folder).isEmpty():
        return {}
    held = spark.read.parquet(folder).select(KEYS[1]).distinct().collect()
    return {r[0]: f"{folder}/{KEYS[1]}={r[0]}" for r in held}


def _commit(spark: SparkSession, root: str, version: int, paths: dict[int, str], buckets: int,
            schema: str) -> None:
    rows = [(version, -1, None, buckets, schema)]  # a version without rows has this one
    rows += [(version, b, p, buckets, None) for b, p in sorted(paths.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _entry(spark: SparkSession, root: str, version: int | None) -> dict:
    listed = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    if version is None:
        version = listed.agg(F.max("version")).first()[0]
    rows = listed.where(F.col("version") == version).collect()  # one for each bucket
    if not rows:
        raise ValueError(f"no version {version} in {root}")
    head = next(r for r in rows if r["bucket"] < 0)
    return {"version": version, "buckets": head["buckets"], "schema": head["schema"],
            "paths": {r["bucket"]: r["path"] for r in rows if r["bucket"] >= 0}}


def _rows(spark: SparkSession, root: str, entry: dict, paths: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(entry["schema"]))
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths)
            .select(*schema.names))
