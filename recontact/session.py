"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One participant may own a third of the rows: split that key even when the
    # split costs one more exchange further down the plan.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Shuffled bytes of one task at most where partitions are joined or split. Rows of days, pairs and counts weigh up to
#: a hundred times more in memory than in a compressed shuffle, so Spark's own 64 MB and 256 MB are gigabytes to a task.
TASK_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 32 << 20,
}


def _bytes(spark: SparkSession, size: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size))


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, most in TASK_BYTES.items():
        if _bytes(spark, spark.conf.get(key)) > most:
            spark.conf.set(key, f"{most}b")
    # A size guessed from compressed files knows nothing of the rows that a window graph adds to
    # them, so joins are broadcast by the size that was measured after their exchange, or by a hint.
    guessed = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if guessed != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", guessed)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        shared = tempfile.mkdtemp(prefix="recontact-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def checkpointed(frame: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder, so a lost executor cannot change them."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Each thread records its own stages: fits that run at the same time must not remove one another's.
_recorders = threading.local()


def _recording() -> list[list[str]]:
    if not hasattr(_recorders, "lists"):
        _recorders.lists = []
    return _recorders.lists


@contextmanager
def recorded_stages() -> Iterator[list[str]]:
    """The folders of all stages that are written meanwhile, so that whoever knows when they are read no more can remove them."""
    paths: list[str] = []
    _recording().append(paths)
    try:
        yield paths
    finally:
        _recording()[:] = [made for made in _recording() if made is not paths]


def record_stage(path: str) -> None:
    for paths in _recording():
        paths.append(path)


def remove_stages(spark: SparkSession, paths: list[str], still_read: DataFrame | None = None) -> list[str]:
    """Delete written stages; those that hold an input file of ``still_read`` stay and are returned."""
    files = still_read.inputFiles() if paths and still_read is not None else []
    names = {path: path.rstrip("/").rsplit("/", 1)[-1] for path in paths}
    kept = [path for path in paths if any(f"/{names[path]}/" in file for file in files)]
    jvm = spark._jvm
    for path in paths:
        if path not in kept:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return kept


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a stage of a study as Parquet in the shared folder and go on from the file.

    Later stages read it with column pruning and known size, their plans stay small, and a lost
    executor only costs a re-read.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{name}-{uuid.uuid4().hex}"
    record_stage(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
