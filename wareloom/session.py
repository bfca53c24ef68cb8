"""Session helpers: building a local session, reading tables, cutting lineage."""

from __future__ import annotations

import gc
import os
import re
import struct
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str | int = 8, app: str = "wareloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the session is given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one table; naming the columns keeps the scan narrow even behind opaque operators."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; set one only where none is set (local runs).

    ``spark.checkpoint.dir`` in the session configuration is honoured by Spark itself when
    the context starts; an unset folder on a non-local master is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "wareloom-checkpoints"))
    else:
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The address of a new folder beside the checkpoints, for files that tasks write and read themselves."""
    from pyarrow import fs

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{re.sub(r'^file:/+', 'file:///', base)}/files-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return folder


def write_parts(folder: str, name: str, *parts: bytes) -> None:
    """A file of the shared folder: how many bytes each part has, and the parts."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)))
        for part in parts:
            out.write(part)


def read_parts(folder: str, name: str) -> list[bytes]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{name}") as stored:
        number = struct.unpack("<q", stored.read(8))[0]
        sizes = struct.unpack(f"<{number}q", stored.read(8 * number))
        return [stored.read(size) for size in sizes]


def drop_folder(folder: str) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.delete_dir(path)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Materialise in a compressed table of the shared folder, for the caller to drop: many narrow rows take a quarter of a checkpoint's room."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(f"{folder}/table")
    return df.sparkSession.read.parquet(f"{folder}/table"), folder


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few, dense files at least one partition per core; larger scans stay as they are."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
