"""Tables written on the way, and reading text columns inside tasks."""

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.sources.workspace import run_folder

SLICE = 512
_shipped: set[str] = set()


def in_tasks(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`rows.mapInArrow`, with this package sent along, so that workers can import it wherever they run."""
    context = rows.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="pursebook-")) / "pursebook.zip"
        with zipfile.ZipFile(archive, "w") as files:
            for source in sorted(package.rglob("*.py")):
                files.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return rows.mapInArrow(function, schema)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written once to the cluster's shared folder and read again: cuts the lineage and survives lost executors."""
    spark = rows.sparkSession
    folder = run_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def named(values: DataFrame, name: str) -> DataFrame:
    """The distinct rows of `values`, sorted, each with an integer `name` of its own; written, so that names stay as they are."""
    spread = values.distinct().sortWithinPartitions(*values.columns)
    return stored(spread.withColumn("name", F.monotonically_increasing_id()), name)


def same(left: DataFrame, right: DataFrame, *columns: str):
    """Equality of the given columns, where NULL equals NULL."""
    condition = F.lit(True)
    for column in columns:
        condition = condition & left[column].eqNullSafe(right[column])
    return condition


def texts(batch: pa.RecordBatch, *others: str) -> Iterator[tuple]:
    """(the text's UTF-8 bytes, the other columns' values) of each row; a NULL text is empty. Few rows at a time become Python objects."""
    for start in range(0, batch.num_rows, SLICE):
        part = batch.slice(start, SLICE)
        binary = part.column("text").cast(pa.binary()).to_pylist()
        columns = [part.column(name).to_pylist() for name in others]
        for text, *values in zip(binary, *columns, strict=True):
            yield (text or b"", *values)
