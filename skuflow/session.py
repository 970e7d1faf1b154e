"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "skuflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            root = tempfile.mkdtemp(prefix="skuflow-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; ``drop_scratch`` removes what is written there."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(path: str) -> bool:
    system, place = _file_system(SparkSession.active(), path)
    return system.exists(place)


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` for the operating system where it is in a local or mounted folder, else None."""
    system, place = _file_system(spark, path)
    return place.toUri().getPath() if system.getUri().getScheme() == "file" else None


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch tables this application has made so far."""
    return len(_SCRATCH.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, since: int = 0) -> int:
    """Remove the scratch tables of this application, from the ``since``-th on, and say how many were there.

    Results that read them must have been written before; DataFrames that still need them can't be used any more.
    """
    paths = _SCRATCH.get(spark.sparkContext.applicationId, [])
    dropped, removed = paths[since:], 0
    del paths[since:]
    for path in dropped:
        system, place = _file_system(spark, path)
        removed += bool(system.delete(place, True))
    return removed


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut and lost executors cost nothing.

    A Parquet table is smaller than a checkpoint of rows, is read by column and tells the planner its size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for work bound by computation, which should not be merged by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
