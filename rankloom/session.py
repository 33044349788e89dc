"""Session helpers: building a session for tests/bench, written tables, size-checked broadcast."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults used only when the cluster has not configured them already.
_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "rankloom") -> SparkSession:
    """A local session for tests and the benchmark (clusters bring their own)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("RANKLOOM_DRIVER_MEM", "16g")))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set one only when unset (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    target = conf_dir or fallback
    if target is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster "
                             "(checkpoints and index tables are written there)")
        import tempfile
        target = tempfile.mkdtemp(prefix="rankloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# Tables written by ``materialize`` while a ``temporary_tables`` block is open.
_SCOPES: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession):
    """Delete the tables that ``materialize`` writes within the block when it ends (a stream's
    micro-batch, a job that has written its result)."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint directory and read it back.

    Cuts the lineage (like a reliable checkpoint) but keeps a columnar, prunable table with
    statistics, so later scans read only the columns they need."""
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/rankloom/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    with without_shuffle_files(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session that holds within the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def without_shuffle_files(spark: SparkSession):
    """Shuffle files of what is written within the block go when it is written, not when the driver happens to
    collect its garbage: nothing reads them again, as the table is read in their place."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _bucketed_name(path: str) -> str:
    import hashlib
    return f"rankloom_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int) -> None:
    """Write ``df`` as a bucketed folder. What the catalog knew of the path goes: the entry this
    write needs, and that of an older table with other buckets (their files are external)."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {_bucketed_name(path)}")
    name = f"{_bucketed_name(path)}_write"
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    with without_shuffle_files(df.sparkSession):
        df.write.mode("overwrite").bucketBy(buckets, by).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def bucketed_table(spark: SparkSession, path: str, schema: str, by: str, buckets: int) -> DataFrame:
    """A bucketed folder as a table of the session's catalog, which holds the bucketing: one entry for
    each path, however often it is read."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_bucketed_name(path)} ({schema}) USING parquet CLUSTERED BY ({by}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_bucketed_name(path))


# Broadcasts above this proven size are not asked for (Spark refuses them at 8 GB).
BROADCAST_BYTES = 512 << 20


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of the rows' text, from one pass over ``columns`` of a (small) query table."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def broadcast_below(df: DataFrame, size: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if ``size``, a proven bound of the side's bytes, allows it; otherwise
    Spark plans a shuffle join (and AQE splits its hot keys)."""
    return F.broadcast(df) if size <= most else df


def data_version(spark: SparkSession, sf_dir: str, table: str) -> str:
    """Length and time of a table's files: what was built from them is reused only while they
    are the same."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return f"{sum(f.getLen() for f in files)}-{max((f.getModificationTime() for f in files), default=0)}"


# Tables up to this size come back in a few splits and are dealt to all cores; larger ones have
# splits enough and are never reshuffled.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin a small table over the cores: CPU-heavy per-row work (regex tokenising,
    markup parsing) would otherwise run in the one or two tasks of its few splits. The size is
    that of the files, known when planning."""
    size = df._jdf.queryExecution().analyzed().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:          # a Scala BigInt comes as an int or an object
        return df
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
