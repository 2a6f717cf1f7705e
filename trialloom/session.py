"""Session set-up, table access and the two guards every operator uses.

``materialize`` cuts lineage in the folder the cluster names in
``spark.checkpoint.dir``; ``bounded_broadcast`` hints a broadcast only after the
side was counted.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast by ``bounded_broadcast``.
BROADCAST_ROWS = 10_000


def get_spark(app: str = "trialloom", master: str | None = None, **conf: str) -> SparkSession:
    """The session with the settings the operators are tuned for; an active one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over all cores, if its files give fewer partitions than there are cores.

    For scans ahead of work that costs far more than moving the rows: a few
    well-compressed files would leave most cores idle. Larger tables have more
    partitions than cores and stay as they are, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage; a temporary one, removed at the end, only in local mode.

    Checkpoints are removed once nothing refers to their rows any more.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="trialloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
        # Read from the context's own settings whenever a checkpoint is made.
        context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share; it is removed when this process ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder as long as the session lives; a stopped one leaves it to the owner of the shared folder."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - at the end of a process there is nobody to tell
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: partitions and their order stay as they are."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is."""
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)
