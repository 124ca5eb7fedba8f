"""Repeated lines, dropped with the help of levelled sorted runs of line hashes.

Documents come in batches, the largest doc_ids first. A run is a table of line hashes, bucketed and
sorted by hash, with the number of documents that hold the line and, in the run that saw it first,
the document that keeps it. Each batch is merge-joined with the runs there are: lines found in none
are new and keep their largest document; the others only add to the count. The batch then becomes a
run itself. Runs of one level are merged into one of the next level, so that few runs are left at any
time. Runs have the same buckets, so neither the joins nor the merges shuffle them.

Lines of enough documents are then looked up by hash and dropped from their documents.
"""

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.tables import in_tasks, stored, texts
from pursebook.sources.workspace import run_folder

BATCHES = 4
MERGED_RUNS = 2
LEAST_POINTS = 20
LEAST_DOCUMENTS = 3
BLANKS = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, least_points: int) -> bytes | None:
    """128 bits of the line's key; None if the key is too short. The key: no blanks at its ends, A-Z lower-cased."""
    key = line.strip(BLANKS).lower()
    if len(key) < least_points or (not key.isascii() and len(key.decode()) < least_points):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(least_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for text, doc_id in texts(batch, "doc_id"):
                own = {line_hash(line, least_points) for line in text.split(b"\n")} - {None}
                ids.extend([doc_id] * len(own))
                hashes.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["doc_id", "h"])

    return run


class Runs:
    """The levelled runs of (h, keep, n)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _written(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        spread = rows.select("h", "keep", "n").repartition(self.buckets, "h")
        writer = spread.write.bucketBy(self.buckets, "h").sortBy("h").option("path", run_folder(self.spark, name))
        writer.saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch's (h, keep, n) with the runs: known lines lose their `keep`. Then it is a run."""
        for run in self.tables():
            seen = run.select("h", F.lit(True).alias("seen"))
            batch = batch.join(seen, "h", "left").select("h", F.when(F.col("seen").isNull(), F.col("keep")).alias("keep"), "n")
        self._put(0, self._written(batch))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == MERGED_RUNS:
            merged = self.merged([self.spark.table(n) for n in self.levels[level]])
            self.levels[level] = []
            self._put(level + 1, self._written(merged))

    @staticmethod
    def merged(tables: list[DataFrame]) -> DataFrame:
        """One row per hash: the counts of all runs together, and the `keep` that one of them has."""

        def two(left: DataFrame, right: DataFrame) -> DataFrame:
            right = right.withColumnsRenamed({"keep": "other_keep", "n": "other_n"})
            total = (F.coalesce("n", F.lit(0)) + F.coalesce("other_n", F.lit(0))).alias("n")
            return left.join(right, "h", "full").select("h", F.coalesce("keep", "other_keep").alias("keep"), total)

        return reduce(two, tables)

    def drop(self) -> None:
        """Forget the tables' names; the files stay for what still reads them."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_lines(documents: DataFrame, least_points: int, least_documents: int, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """The lines by document (doc_id, h), and (h, keep) of the lines that enough documents hold."""
    spark = documents.sparkSession
    known = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    shares = [i / batches for i in range(1, batches)]
    bounds = known.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") > bound, 0).otherwise(1) for bound in bounds), F.lit(0))
    folder = run_folder(spark, "line-hashes")
    hashed = in_tasks(known, _hashes(least_points), "doc_id long, h binary").withColumn("batch", batch)
    hashed.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema("doc_id long, h binary, batch int").parquet(folder)
    runs = Runs(spark)
    for i in range(len(bounds) + 1):
        found = lines.where(F.col("batch") == i).groupBy("h")
        runs.add(found.agg(F.max("doc_id").alias("keep"), F.count_distinct("doc_id").alias("n")))
    repeated = stored(runs.merged(runs.tables()).where(F.col("n") >= least_documents).select("h", "keep"), "repeated-lines")
    runs.drop()
    return lines.select("doc_id", "h"), repeated


def _without(least_points: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, *([("kept_text", pa.string())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, doc_id, dropped in texts(batch, "doc_id", "dropped"):
                lines = kept = text.split(b"\n")
                if dropped:
                    gone = set(dropped)
                    kept = [line for line in lines if line_hash(line, least_points) not in gone]
                    text = b"\n".join(kept)
                row = doc_id, len(lines), len(lines) - len(kept), hashlib.sha256(text).hexdigest()
                rows.append((*row, text.decode()) if with_text else row)
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def without_repeated_lines(
    documents: DataFrame,
    least_points: int = LEAST_POINTS,
    least_documents: int = LEAST_DOCUMENTS,
    batches: int = BATCHES,
    with_text: bool = False,
) -> DataFrame:
    """One row per row of `documents`: doc_id, n_lines, n_dropped, kept_sha256, and on demand kept_text.

    Texts are cut at line feeds; a NULL or empty text is one empty line. Lines with equal keys of at
    least `least_points` code points that are in at least `least_documents` documents are dropped but
    from the largest doc_id; there all its lines stay. Rows that share a doc_id are one document.
    Rows without doc_id count for no line and lose none. Other columns are not looked at.
    """
    documents = documents.select("doc_id", "text")
    lines, repeated = repeated_lines(documents, least_points, least_documents, batches)
    dropped = lines.join(repeated, "h").where("doc_id <> keep").groupBy("doc_id").agg(F.collect_set("h").alias("dropped"))
    with_dropped = documents.join(dropped, "doc_id", "left")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return in_tasks(with_dropped, _without(least_points, with_text), schema)
