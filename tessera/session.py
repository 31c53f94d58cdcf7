"""Session helpers.

Nothing here is needed on a managed cluster: pass your own SparkSession to every
operator.  ``get_spark`` only builds a local session for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every session used with this library should have.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tessera") -> SparkSession:
    """Local session for tests / bench.  UI off, UTC, AQE on."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to shared storage and we only read
    it.  Only when it is unset (local tests) do we create a scratch folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():  # set once a session: Spark adds a folder of its own each time
        d = sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path under ``spark.checkpoint.dir`` for a table of intermediate rows; it is deleted
    by ``release_materialized``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def size_estimate(df: DataFrame) -> int | None:
    """The optimizer's size estimate of ``df`` in bytes (plan statistics; no job runs)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except Exception:  # noqa: BLE001 - no estimate (e.g. a remote session)
        return None


def broadcast_bounded(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast hint for ``df`` only when its size estimate is at most ``max_bytes``
    (session option ``tessera.broadcast.maxBytes``, default 64 MiB).  Beyond that no hint
    is given: AQE measures the real shuffle output at runtime and chooses a broadcast or
    a sort-merge join itself.  Estimates of derived tables are upper bounds (Spark sizes
    an aggregate like its input), so the check errs towards not broadcasting."""
    if max_bytes is None:
        max_bytes = int(df.sparkSession.conf.get("tessera.broadcast.maxBytes", str(BROADCAST_MAX_BYTES)))
    est = size_estimate(df)
    return F.broadcast(df) if est is not None and est <= max_bytes else df


def _plan_weight(df: DataFrame) -> int:
    """Number of shuffle-producing nodes (joins, windows, aggregates) in the analyzed plan."""
    p = df._jdf.queryExecution().analyzed().toString()
    return sum(p.count(k) for k in ("Join ", "Window [", "Aggregate [", "Union "))


def materialize(df: DataFrame, min_weight: int = 2, pin: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` before it is used twice (rows and per-block summaries).

    Chained ordered-series operators each read their input twice; without a cut the
    upstream plan would be recomputed 2**k times.  When the plan of ``df`` has at least
    ``min_weight`` joins / windows / aggregates it is written once as a parquet table in
    the shared ``spark.checkpoint.dir`` (one job, columnar, survives executor loss; an RDD
    ``checkpoint()`` would compute the input twice) and read back; plain scans and
    projections are returned unchanged.  Session option ``tessera.materialize=false``
    disables it, but for ``pin``: such a table is always written, because it fixes values
    that depend on the physical layout.
    """
    spark = df.sparkSession
    if not pin:
        if spark.conf.get("tessera.materialize", "true").lower() == "false":
            return df
        if _plan_weight(df) < min_weight:
            return df
    path = scratch_path(spark, "tessera-mat")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release_materialized(spark: SparkSession) -> int:
    """Delete the tables of intermediate rows (``scratch_path``) written in this process, lineage
    cuts included (call it once the jobs reading them have finished).  Uses the Hadoop file system of each path,
    so it works on shared storage.  Returns the number of tables removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        p = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        if p.getFileSystem(conf).delete(p, True):
            n += 1
    return n
