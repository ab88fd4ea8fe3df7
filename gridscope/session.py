"""Session construction and table loading."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, cores: int | None = None,
                  shuffle_partitions: int | None = None,
                  app_name: str = "gridscope", extra: dict | None = None,
                  cluster: bool = False) -> SparkSession:
    """Create (or reuse) a session with the settings every operator assumes.

    ``cluster=True`` (under spark-submit) leaves the master, executor sizing
    and the shuffle-partition count to the cluster's configuration; AQE then
    coalesces small partitions and splits skewed ones.  Locally the master is
    ``local[cores]`` and the shuffle-partition count follows the core count.
    """
    b = SparkSession.builder.appName(app_name)
    conf = {}
    if not cluster:
        if master is None:
            cores = cores or int(os.environ.get("BENCH_CPUS", "0") or 0) or os.cpu_count() or 4
            master = f"local[{cores}]"
        b = b.master(master)
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (cores or 8) * 2)
        conf["spark.driver.memory"] = os.environ.get("GRIDSCOPE_DRIVER_MEMORY", "8g")
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update({
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets this to a shared file system.  A folder of our own is only
    made up when the setting is missing and the master is local (tests); a
    cluster without the setting is an error, because each executor would write
    to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = local_checkpoint_dir(sc.master)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_checkpoint_dir(master: str) -> str:
    """A temporary folder, for a master in one process only."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="gridscope-ckpt-")


_WRITTEN: list[str] = []


def remember(path: str) -> None:
    """Let ``release`` delete ``path`` too."""
    _WRITTEN.append(path)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder (shared storage
    on a cluster) and read it back: lineage is cut, the result survives lost
    executors, and - unlike ``checkpoint()`` without a cache - the plan runs
    only once.  ``release`` deletes these folders when results have been read."""
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/gridscope-{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    remember(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete everything ``materialize`` has written so far; returns how many
    folders went.  Call it when the results built on them have been consumed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a parquet scan (filters/projections push down)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable by the Python workers (pandas UDFs,
    ``mapInPandas``): zip it once and hand it to ``addPyFile``, which Spark
    distributes to every executor.  Done once per SparkContext."""
    import zipfile
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="gridscope-pkg-"), "gridscope.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
