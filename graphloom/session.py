"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_WRITTEN: list[str] = []


def get_session(app: str = "graphloom", cpus: str | int = "*") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; one of our own only where that is unset
    on a local master (tests), which is removed at the end of the process. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, True)
    return folder


def scratch_table(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives lost executors.

    Loops use it rather than ``DataFrame.checkpoint``, which carries the estimated size of the plan along: where a table
    joins itself in every round the estimate is squared each time. A written table has the true size of its files, so
    joins pick their side to broadcast by a checked size.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_counted(df: DataFrame, condition: Column, label: str = "t") -> tuple[DataFrame, int]:
    """A scratch table and the number of its rows that meet a condition, counted while it is written."""
    seen = Observation()
    out = scratch_table(df.observe(seen, F.count_if(condition).alias("n")), label)
    return out, seen.get["n"]


def forget(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more, as a loop leaves one behind in each round."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if own := [x for x in _WRITTEN if f.endswith(x.rsplit("/", 1)[1])]:
                _WRITTEN.remove(own[0])
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this process wrote with ``scratch_table``; frames built on them can't be read afterwards."""
    jvm = spark._jvm
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
