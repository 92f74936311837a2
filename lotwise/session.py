"""SparkSession construction and cluster-level settings."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every lotwise job relies on.  Dates are computed with DATE(ts) in
# UTC, so the session time zone is pinned; AQE coalesces the small per-dealer
# shuffles and splits skewed join partitions at run time.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizeNullAwareAntiJoin": "true",
}

# Rows of the dashboard's tables are small and compress well, so that a partition of
# Spark's usual 64 MB is more than a task can sort in memory.
DASHBOARD_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def build_session(master: str | None = None, app_name: str = "lotwise",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session configured for lotwise.

    On a cluster, pass ``master=None`` and let spark-submit decide; locally
    (tests, bench) pass ``local[N]``.  The web UI stays off.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(CORE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in CORE_CONF.items():
        spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset on a local master
    (unit tests on a laptop) is a private folder created and registered;
    elsewhere executors could not see such a folder, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lotwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def _own_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, with its file system's scheme.

    A checkpoint folder without a scheme is on Hadoop's default file system, which
    other readers of the path would not know.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_dir(spark).rstrip('/')}/lotwise-{spark.sparkContext.applicationId}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return path.getFileSystem(conf).makeQualified(path).toString()


def scratch(spark: SparkSession, name: str, new: bool = True) -> str:
    """A path in the shared checkpoint folder, under this application's own folder.

    Always a new one, unless ``new`` is false: then the same for the same name.
    """
    own = _own_folder(spark)
    if own not in _folders:
        _folders[own] = spark
        atexit.register(_clear_at_exit, own)
    return f"{own}/{name}-{uuid.uuid4().hex}" if new else f"{own}/{name}"


_folders: dict[str, SparkSession] = {}


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.

    Frames that still read them become unusable, so call it once the results are
    written; it also runs when the driver's Python exits with the session alive.
    """
    own = _own_folder(spark)
    _folders.pop(own, None)
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _clear_at_exit(own: str) -> None:
    spark = _folders.get(own)
    if spark is not None and spark.sparkContext._jsc is not None:
        clear_scratch(spark)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and return a frame reading it.

    Used where an intermediate feeds several branches of a plan: it is computed
    once, survives lost executors, and its size is known, so that small ones are
    broadcast under Spark's own threshold.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
