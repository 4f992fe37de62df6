"""What the operators need of the session: a shared place to cut lineage, and input sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, set as the session's checkpoint folder.

    Where none is set, a temporary folder serves a session that runs on this machine alone; on a
    cluster, whose executors couldn't read it, that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


#: The folder of the block's own tables.
_tables: ContextVar[str | None] = ContextVar("tables", default=None)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; in a block of passing(), one of its tables."""
    folder = _tables.get()
    if folder is None:
        return checkpointed(df)
    own = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(own)
    return df.sparkSession.read.schema(df.schema).parquet(own)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A block whose durable() tables are Parquet in the shared folder and go with its end: nothing that reads them may be left lazy.

    A checkpoint is read in a task for each task that wrote it, however little that was, and the driver keeps account of each; small files are read many to a task."""
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    before = _tables.set(folder)
    try:
        yield
    finally:
        _tables.reset(before)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: a count that sizes partitions, never a limit."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


#: Partitions of a shuffle that a driver can track with ease; beyond, partitions grow and not their number.
MOST_PARTITIONS = 1 << 15


def partitions(spark: SparkSession, total: int, each: int) -> int:
    """Enough partitions for ``total`` bytes at ``each`` a partition, and no fewer than the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-total // each), MOST_PARTITIONS), 1)
