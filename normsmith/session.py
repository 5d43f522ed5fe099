"""Session helpers.

The library never sets cluster-sizing options itself: partition counts,
memory and the checkpoint folder belong to whoever launches the job.  The
helpers here only build a local session for tests/bench and read the shared
checkpoint folder from the session.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "normsmith") -> SparkSession:
    """A local session for tests and bench (AQE on, UTC, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("NORMSMITH_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any (works on a
    classic session and, through the SQL conf only, on Spark Connect)."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None:
        d = sc.getCheckpointDir()
        if d:
            return d
        d = sc.getConf().get("spark.checkpoint.dir", None)
    else:
        d = None
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:
            d = None
    if d and sc is not None:
        sc.setCheckpointDir(d)
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder; only when none is set on a local
    master (tests, bench) take a fresh local one.  A cluster must name one:
    a folder of one machine is not seen by the others."""
    d = checkpoint_dir(spark)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    d = tempfile.mkdtemp(prefix="normsmith-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder when one is configured,
    otherwise the plan is returned unchanged (lineage recomputation is then
    the recovery path).  Never a local checkpoint: executor loss must not
    lose the data."""
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    return df


_scratch: list[list[str]] = []


def track(path: str) -> None:
    """Have the innermost ``scratch`` block delete ``path`` at its end."""
    if _scratch:
        _scratch[-1].append(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are staged inside the block are deleted when it ends.  As
    results are lazy, write or collect them inside the block."""
    mine: list[str] = []
    _scratch.append(mine)
    try:
        yield
    finally:
        _scratch.remove(mine)
        for path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as parquet below the checkpoint folder and read again:
    later steps see one fixed set of rows, read only the columns they need
    and know its size.  Deleted by ``discard``, or by the ``scratch`` block
    around it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/normsmith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    track(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    _delete(df.sparkSession, df._staged_path)
