"""Writing micro-batches so that a repeated one changes nothing."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pursebook.sources.workspace import COMPACT


def write_batches(
    stream: DataFrame,
    folder: str,
    mode: str,
    outputs: Callable[[DataFrame, int], Iterable[tuple[str, DataFrame]]] = lambda batch, _: [("rows", batch)],
    every: str | None = None,
) -> StreamingQuery:
    """Run `stream` over all that is available, or for good with a batch `every` so often.

    A batch overwrites its own `batch=<id>` folders. `outputs` names its tables; each is written
    before the next one is asked for.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for name, rows in outputs(batch, batch_id):
            rows.write.mode("overwrite").options(**COMPACT).parquet(batch_folder(folder, name, batch_id))

    writer = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def batch_folder(folder: str, name: str, batch_id: int) -> str:
    return f"{folder}/{name}/batch={batch_id}"
