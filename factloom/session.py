"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Parquet of repeated strings is many times smaller on disk than in memory; broadcasts are decided on the latter.
    "spark.sql.sources.fileCompressionFactor": "8.0",
    # Rows and bytes of a batch that goes to Python; texts may be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    # Joins whose shuffled side is small in every partition hash it instead of sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time options every operator relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Paths given out inside the blocks of ``temporary`` that this thread of work is in.
_open_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("open_blocks", default=())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing else uses it."""
    path = f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}"
    for given in _open_blocks.get():
        given.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A block whose intermediate tables are removed at its end; what is wanted of it must be written elsewhere by then."""
    given: list[str] = []
    before = _open_blocks.set((*_open_blocks.get(), given))
    try:
        yield
    finally:
        _open_blocks.reset(before)
        for name in given:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage for loops and for tables read more than once; files survive lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, by: str, label: str) -> DataFrame:
    """Distinct rows of ``df`` written in buckets of ``by``: joins on it do not deal them out again."""
    spark = df.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"factloom_{uuid.uuid4().hex}"
    rows = df.repartition(parts, by).distinct()
    rows.write.bucketBy(parts, by).sortBy(by).option("path", scratch_path(spark, label)).format("parquet").saveAsTable(name)
    return spark.table(name)
