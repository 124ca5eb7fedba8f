"""From raw documents to packed training sequences, in stages; each is written as Parquet and read again by the next.

All stages but the last return the columns of documents, further ones too, whatever their names. A row is dropped only by its
own stage's decision. Decisions are by doc_id: rows that repeat one share them, and rows without doc_id stay until they are
packed. An empty table stays empty through all stages.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.exact import exact_duplicates
from pursebook.llm.minhash import near_duplicates
from pursebook.llm.packing import packed_sequences
from pursebook.llm.quality import quality
from pursebook.llm.tables import stored
from pursebook.llm.toxicity import toxicity


def _only(docs: DataFrame, verdicts: DataFrame, keep: str) -> DataFrame:
    """The rows of `docs` that `verdicts` keeps, by doc_id; rows without doc_id are all kept."""
    dropped = verdicts.where(f"NOT {keep} AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; a NULL, empty or wordless text is not toxic. Texts are read whole."""
    verdicts = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, verdicts.select("doc_id", (F.col("predicted") == 0).alias("clean")), "clean")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go, among them all without words (NULL and empty texts too)."""
    return _only(docs, quality(docs), "kept")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the longest stays, of equally long ones the smallest doc_id; NULL counts as empty."""
    return _only(docs, exact_duplicates(docs), "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8) the smallest doc_id stays; a text without words is a group by itself."""
    return _only(docs, near_duplicates(docs, words=5, percent=80), "kept")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences; a NULL or empty text is its end token."""
    return packed_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_filter),
    ("quality", quality_filter),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("packing", pack),
]

#: SQL can express neither the learned filters nor the packing; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
