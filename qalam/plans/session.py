"""Session construction and lineage cutting.

On a cluster the session comes from the platform; ``get_spark`` is for local
runs and tests.  ``materialize`` cuts lineage with a reliable ``checkpoint``
into the directory the cluster names in ``spark.checkpoint.dir``; a private
temporary directory is set only when the session has none (local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int | None = None,
              app: str = "qalam", memory: str = "8g") -> SparkSession:
    parts = shuffle_partitions or (8 if cores == "*" else max(2, int(cores)))
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", memory)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024)))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[int, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; set a private temporary one only when the session
    has none (local runs and tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: no SparkContext)
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        conf = conf or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = _LOCAL_DIRS.get(id(spark)) or tempfile.mkdtemp(
            prefix="qalam-ckpt-", dir=os.environ.get("QALAM_SCRATCH", "/tmp"))
        _LOCAL_DIRS[id(spark)] = conf
    if sc is not None:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    return conf


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the frame as Parquet into a fresh folder under the
    shared checkpoint directory and read it back.

    One pass (an eager ``Dataset.checkpoint`` computes the plan twice: once to
    count, once to write), survives executor loss (the data sits in shared
    storage, not on executors), and stops Catalyst from re-running an
    expensive projection under every filter pushed below it.
    """
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex[:16]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition of a *table read* that has fewer files or splits
    than the cluster has task slots.

    A small table stored as one row group scans as a single task, which leaves
    a CPU-heavy regex chain on one core.  Only scans are looked at (their file
    splits are known without running anything); at scale they have thousands of
    splits and this is a no-op.
    """
    if df.isStreaming:
        return df
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "Exchange" in plan or "Join" in plan or "Aggregate" in plan:
            return df
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001  (Spark Connect: leave placement to the server)
        return df
    if have >= want:
        return df
    return df.repartition(want)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``qalam`` importable by the Python workers: its pandas UDFs are
    pickled by module reference.  Zips the package once per SparkContext and
    adds it with ``addPyFile`` (on a cluster this is ``--py-files``)."""
    import zipfile
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: ship with the client's artifacts instead)
        return
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import qalam
    pkg = os.path.dirname(os.path.abspath(qalam.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="qalam-pkg-"), "qalam.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
