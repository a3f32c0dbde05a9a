"""Session settings the jobs rely on, and the shared folder they write to."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only: every one of them can be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split by AQE; forcing it keeps the split when an aggregate follows the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vitrine") -> SparkSession:
    """A local session for tests and the bench; clusters pass their own session to `configure`."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_INSIDE: contextvars.ContextVar[str | None] = contextvars.ContextVar("inside", default=None)


@contextlib.contextmanager
def own_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """What is written to the shared folder inside lies in one folder there, which can be removed as a whole."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    mark = _INSIDE.set(path)
    try:
        yield path
    finally:
        _INSIDE.reset(mark)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a fresh temporary one only for a local master. Inside `own_folder` that one."""
    if inside := _INSIDE.get():
        return inside
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="vitrine-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Spark's own switch: the shuffle files of a query go when it ends, not when the driver's garbage collector runs.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_end_with_the_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(SHUFFLE_CLEANUP, before)
        else:
            spark.conf.unset(SHUFFLE_CLEANUP)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several steps read to the shared folder, once, and read it back.

    Unlike a cache it survives lost executors, and readers prune its columns. The write is planned for itself, so
    nothing else reads its shuffle files, and executors need not keep them until the whole job ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_the_query(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPREAD_BYTES_PER_CORE = 16 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input the optimizer estimates as small, such as one file of a few megabytes.

    Anything larger already arrives in enough partitions and is left as it is; nothing large is shuffled.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, 64)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SPREAD_BYTES_PER_CORE else df
