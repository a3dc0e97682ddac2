"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Meter stamps are zone-free; a fixed UTC session keeps casts between the two
    # timestamp types lossless.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One client may own a third of all rows: let AQE split its partition even
    # when the split costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method of more than 8,000 bytes. A stage that makes one (dozens of
    # one-hot columns, say) runs far faster as split methods than as one interpreted one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str, cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


#: The folder of the innermost open scope.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder.
    """
    base = _SCOPE.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_dir()
    return f"{base.rstrip('/')}/gridlens-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Loops over levels call this so that plans stay short and a lost executor costs a file
    read, not a replay of every level.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go to one folder, which is cleared at the end, also after an
    error. Tables that are to stay must be written elsewhere before."""
    base = shared_dir(spark)
    token = _SCOPE.set(base)
    try:
        yield base
    finally:
        _SCOPE.reset(token)
        remove_dir(spark, base)
