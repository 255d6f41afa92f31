"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder of intermediate tables: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session in which neither the setting nor a checkpoint directory exists (tests) gets a
    temporary folder, which goes when the process ends; a cluster without either is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


_WRITTEN: list[str] = []
_CLEARED = [0]


def cleared() -> int:
    """How often tables were cleared: what is kept between queries must not outlive that."""
    return _CLEARED[0]


def clear_tables(spark: SparkSession) -> int:
    """Removes the intermediate tables that this process wrote so far, and tells how many. Frames that still read them
    can't be evaluated any more: call it between independent queries."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = 0
    _CLEARED[0] += 1
    while _WRITTEN:
        path = hadoop(_WRITTEN.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``clear_tables`` removes."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    The written table outlives executors, cuts the lineage and is read by any number of consumers;
    ``clear_tables`` removes it.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*columns) if columns else out


def spread(df: DataFrame) -> DataFrame:
    """``df`` (scans and projections) over all cores where a few files would keep most of them idle: for steps that work
    much on each byte. Input with half as many partitions as there are cores, or more, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
