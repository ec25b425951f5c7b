"""Versioned Parquet snapshots of a parsed corpus."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from noteframe.schemas import NOTE_LINKS, NOTES

FORMAT_VERSION = 2
HEAD = StructField("head", StringType())
STORED_NOTES = StructType([*NOTES.fields, HEAD, StructField("root", StringType())])
_POINTER = "_current"


def _path(spark: SparkSession, location: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(location)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_pointer(spark: SparkSession, root: str) -> dict | None:
    """The newest pointer; one small JSON row, written whole before use."""
    target, fs = _path(spark, f"{root}/{_POINTER}")
    if not fs.exists(target):
        return None
    versions = sorted(
        int(s.getPath().getName().split("=")[1])
        for s in fs.listStatus(target)
        if s.isDirectory()
        and s.getPath().getName().startswith("v=")
        and _path(spark, f"{s.getPath()}/_SUCCESS")[1].exists(_path(spark, f"{s.getPath()}/_SUCCESS")[0])
    )
    if not versions:
        return None
    row = spark.read.text(f"{root}/{_POINTER}/v={versions[-1]}").first()
    return json.loads(row[0]) if row else None


def packed(notes: DataFrame) -> DataFrame:
    """Notes as they are stored: a ``raw`` that ends with the body is kept as the text before it, ``head``, and not twice."""
    if not {"raw", "body"} <= set(notes.columns):
        return notes
    shared = F.coalesce(F.endswith("raw", "body"), F.lit(False))
    head = F.when(shared, F.left("raw", F.length("raw") - F.length("body")))
    return notes.withColumns({"head": head, "raw": F.when(~shared, F.col("raw"))})


def unpacked(stored: DataFrame) -> DataFrame:
    """The notes of stored rows; only who reads ``raw`` reads what it is made of."""
    if "head" not in stored.columns:
        return stored
    return stored.withColumn("raw", F.coalesce(F.concat("head", "body"), "raw")).drop("head")


def save_snapshot(spark: SparkSession, root: str, notes: DataFrame, resolve, derive: dict | None = None) -> int:
    """Write a new version beside the old one, then move the pointer to it.

    ``resolve`` turns the written notes into links, so the parse runs once;
    ``derive`` names further tables and how they follow from the written notes; a table "titles" among them
    is handed on to ``resolve``.
    """
    current = _read_pointer(spark, root)
    version = (current["version"] if current else 0) + 1
    data = f"{root}/data/v={version}"
    # Top-level folder as partition: a folder prefix prunes the scan.
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("")
    packed(notes).withColumn("root", top).write.mode("overwrite").partitionBy("root").parquet(f"{data}/notes")
    written = unpacked(spark.read.parquet(f"{data}/notes"))
    derive = derive or {}
    for name, make in derive.items():
        make(written).write.mode("overwrite").parquet(f"{data}/{name}")
    held = [spark.read.parquet(f"{data}/titles")] if "titles" in derive else []
    resolve(written, *held).write.mode("overwrite").parquet(f"{data}/links")
    pointer = json.dumps({"version": version, "format": FORMAT_VERSION, "data": data, "derived": sorted(derive)})
    spark.range(1).select(F.lit(pointer)).write.mode("overwrite").text(f"{root}/{_POINTER}/v={version}")
    return version


def load_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """(notes, links) of the current version, or None when a rebuild is needed."""
    current = _read_pointer(spark, root)
    if not current or current.get("format") != FORMAT_VERSION:
        return None
    found = spark.read.parquet(f"{current['data']}/notes").drop("root")
    if {f.name: f.dataType for f in found.schema} != {f.name: f.dataType for f in [*NOTES, HEAD]}:
        return None
    return (
        unpacked(spark.read.schema(STORED_NOTES).parquet(f"{current['data']}/notes")),
        spark.read.schema(NOTE_LINKS).parquet(f"{current['data']}/links"),
    )


def load_derived(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The derived tables of the current version by name."""
    current = _read_pointer(spark, root) or {}
    return {name: spark.read.parquet(f"{current['data']}/{name}") for name in current.get("derived", [])}
