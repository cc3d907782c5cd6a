"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Everything else stays at the cluster's own values.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

_scratch_roots: set[str] = set()


def build_session(app: str = "setspan", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder; on a cluster a
    missing setting is an error, because a machine-local folder dies with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="setspan-checkpoint-")
    sc.setCheckpointDir(folder)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name next to the checkpoints, for files a job writes and reads back.

    All of an application's lie in one folder that its file system removes when the application
    ends.
    """
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    root = f"{sc.getCheckpointDir().rstrip('/')}/scratch-{sc.applicationId}"
    if root not in _scratch_roots:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch_roots.add(root)
    return f"{root}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def task_slots(spark: SparkSession) -> int:
    """Number of tasks worth creating for a stage with few but heavy rows."""
    return max(
        spark.sparkContext.defaultParallelism * 4,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
