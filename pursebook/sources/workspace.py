"""The shared folder for checkpoints and tables written on the way."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local-mode session without that setting gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="pursebook-")
    return _local_folders[context.applicationId]


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run of something."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: of files that one query writes for itself to read: bodies and texts take about half of what they take by default
COMPACT = {"compression": "zstd"}


def written(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written once to the shared folder and read again, so that readers don't make them anew and their size is known."""
    folder = run_folder(rows.sparkSession, name)
    rows.write.options(**COMPACT).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def checkpointed(rows: DataFrame) -> DataFrame:
    """Write `rows` to the shared folder and cut their lineage there."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)
