"""Text sources and sinks with the contracts of the curation work: strict reads, safe writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wareloom.functions import vectors as V
from wareloom.operators.validate import missing_fields, raise_if_any, repeated_keys
from wareloom.sources.json_object import file_system


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv_text(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with a header, all columns text, quoted line breaks allowed, byte-order mark dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing from {path}: {lacking}")
    return df


def read_scoped(df: DataFrame, scope: str, key: str) -> DataFrame:
    """The rows of one scope, whose keys must be unique."""
    rows = df.where(F.col("scope") == scope)
    raise_if_any(repeated_keys(rows, [key]), f"repeated {key} in scope {scope}")
    return rows


def read_catalogue(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """A catalogue whose required fields are all there and whose keys are unique; never empty."""
    if df.isEmpty():
        raise ValueError("the catalogue is empty")
    raise_if_any(missing_fields(df, key, required), "required field missing")
    raise_if_any(repeated_keys(df, [key]), "repeated key")
    return df


def slice_rows(df: DataFrame, ordinal: str, start: int, count: int) -> DataFrame:
    """Rows ``start`` to ``start + count - 1`` by a dense ordinal from 0; too few rows are an error."""
    part = df.where((F.col(ordinal) >= start) & (F.col(ordinal) < start + count))
    found = part.count()
    if found < count:
        raise ValueError(f"{count} rows asked for from {start}, {found} found")
    return part


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write to a place that must not exist; Spark's commit protocol makes it all or nothing."""
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_related(outputs: dict[str, DataFrame], root: str, version: str) -> str:
    """Write several outputs under one new version folder and publish it by one manifest row.

    Readers take the newest manifest, so they see all of the outputs or none of them.
    """
    for name, df in outputs.items():
        write_new(df, f"{root}/{version}/{name}")
    spark = next(iter(outputs.values())).sparkSession
    manifest = spark.createDataFrame([(version, sorted(outputs))], "version string, outputs array<string>")
    append_log(manifest, f"{root}/_manifest")
    return f"{root}/{version}"


def load_config(path: str, required: Sequence[str]) -> dict:
    """A JSON object from any file system; a missing key or another kind of value is an error."""
    system, inner = file_system(path)
    with system.open_input_stream(inner) as stream:
        config = json.loads(stream.read().decode("utf-8-sig"))
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no object")
    lacking = [key for key in required if key not in config]
    if lacking:
        raise ValueError(f"keys missing from {path}: {lacking}")
    return config


def write_report(df: DataFrame, path: str) -> None:
    """A report of exactly one row as one readable JSON file, which must not exist."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a report has exactly one row")
    system, inner = file_system(path)
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    with system.open_output_stream(inner) as stream:
        stream.write((json.dumps(json.loads(rows[0]), ensure_ascii=False, indent=2) + "\n").encode())


def replace_output(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside an output and put the new one in its place by two renames; a failed write leaves the old one."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    new, old = f"{path}._new_{mark}", f"{path}._old_{mark}"
    write_new(df, new, fmt)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = system.exists(hadoop.Path(path))
    if there and not system.rename(hadoop.Path(path), hadoop.Path(old)):
        raise OSError(f"{path} cannot be moved away")
    if not system.rename(hadoop.Path(new), hadoop.Path(path)):
        raise OSError(f"{new} cannot be moved to {path}")
    if there:
        system.delete(hadoop.Path(old), True)


def existing_files(df: DataFrame, path: str) -> DataFrame:
    """Add ``exists``: whether the file a row names is there; null and blank names are not."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch[path]:
                if not name or not name.strip():
                    found.append(False)
                    continue
                system, inner = file_system(name)
                found.append(system.get_file_info(inner).type == fs.FileType.File)
            yield batch.assign(exists=found)

    return df.mapInPandas(look, StructType([*df.schema.fields, StructType().add("exists", "boolean").fields[0]]))



def write_vector_index(vectors: DataFrame, path: str, dim: int) -> None:
    """Store unit vectors (``id, embedding``) for exact search, with a description the reader checks.

    Unusable vectors are left out; rows are sorted within their files, so ranges of ids are skipped.
    """
    sound = vectors.select("id", V.doubles(F.col("embedding")).alias("v")).where(V.usable(F.col("v"), dim))
    write_new(sound.select("id", V.normalise(F.col("v")).cast("array<float>").alias("embedding")).sortWithinPartitions("id"), f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    write_report(stored.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.lit(dim).alias("dim")), f"{path}/index.json")


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored vectors; an index whose rows, ids or lengths are not as described is an error."""
    about = load_config(f"{path}/index.json", ["rows", "ids", "dim"])
    stored = spark.read.parquet(f"{path}/vectors")
    found = stored.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.size("embedding") != about["dim"]).alias("wrong")).head()
    if (found["rows"], found["ids"], found["wrong"]) != (about["rows"], about["ids"], 0) or found["rows"] != found["ids"]:
        raise ValueError(f"the index at {path} is not as described: {about} and {found.asDict()}")
    return stored
