"""Session settings and shared scratch space.

Intermediate results that must outlive the loss of an executor are written as Parquet tables under the folder
named by ``spark.checkpoint.dir``, which a cluster points at shared storage. Only where that setting is absent and the
master is local (tests, a laptop) a folder of this machine is used; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CREATED: dict[str, tuple] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quern-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared scratch space, which goes when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _CREATED[path] = (spark,)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, (spark,) in list(_CREATED.items()):
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _remove(spark, path)
        except Exception:  # the JVM has gone: the folder stays for the cluster's own cleaning
            pass


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: tuple[int, list[str]] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table scan.

    Cuts the lineage, so that loops don't recompute what came before, and survives the loss of executors.
    With ``bucket_by`` the table is bucketed, and joins on these columns with a table bucketed alike need no
    shuffle. The table goes when the application ends.
    """
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    path = f"{scratch_dir(spark)}/{table}"
    _CREATED[path] = (spark,)
    if bucket_by:
        n, columns = bucket_by
        # As many tasks as buckets, by the same hash: each writes one file for a bucket and a partition.
        writer = df.repartition(n, *columns).write.mode("overwrite").format("parquet").option("path", path).bucketBy(n, *columns)
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
        return spark.table(table).select(*df.columns)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
