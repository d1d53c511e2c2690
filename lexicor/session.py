"""Session helpers: one place for the Spark settings the jobs rely on.

On a cluster the session is created by the platform; ``get_session`` only
builds one for local runs and tests. ``checkpoint_dir`` reads the shared
checkpoint folder from the session and sets a scratch one only where none is
configured (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lexicor") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or max(8, cpus * 2)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEXICOR_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only a local master may do without one
    (a scratch folder is made then): on a cluster a machine's own folder
    would be lost to the other executors."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="lexicor-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_RUN = uuid.uuid4().hex[:12]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables-{_RUN}/{name}-{uuid.uuid4().hex[:12]}"


def release_scratch(spark: SparkSession) -> None:
    """Delete the written tables of this process: for the end of a job, when
    no DataFrame that reads them is in use any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/tables-{_RUN}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage through a Parquet table written under the shared
    checkpoint folder: later stages read files that survive executor loss,
    and the columnar write is much cheaper than serialising rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``, the row's position from 0 in ``order`` (columns);
    rows are dealt by ranges and numbered there, and only one count a range
    meets the others."""
    ranges = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rng = F.shiftright("_at", 33).alias("_range")
    counts = ranges.groupBy(rng).agg(F.count("*").alias("n")).orderBy("_range").collect()
    starts, total = {}, 0
    for r in counts:
        starts[r["_range"]] = total
        total += r["n"]
    table = df.sparkSession.createDataFrame(list(starts.items()), "_range long, _start long")
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranges.withColumn("_range", rng).join(F.broadcast(table), "_range")
            .withColumn(name, place).drop("_range", "_start", "_at"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
