"""Session defaults and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pricelattice", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC dates and runtime re-planning; a cluster's own settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(named: str | None, warehouse: str, master: str) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only a local session may do without the
    setting, in its warehouse folder."""
    if named:
        return named.rstrip("/")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return warehouse.rstrip("/")


def _root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    return shared_root(named, spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes with the session."""
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder; checkpoints go with the session."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{_root(spark)}/checkpoints")
    return df.checkpoint(eager=eager)
