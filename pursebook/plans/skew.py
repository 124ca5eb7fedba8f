"""Joining rows to their parent, and grouping them by it, when one parent owns much of the rows.

A join and a grouping on the same key share one shuffle, so all rows of a parent meet in one task.
Here the rows of a large parent are spread over salts first, and its parent row is repeated for
each; grouping by the parent afterwards combines inside the salts before it shuffles.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE_BITS = 20


def large_parents(rows: DataFrame, key: list[str], share_bits: int = SHARE_BITS) -> DataFrame:
    """Keys with more than 2^share_bits rows and the number of salts to spread them over.

    There are at most rows / 2^share_bits of them, a key and an int each: some 20 MB for 10^12 rows. That bound
    is what allows to broadcast the result.
    """
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    salts = F.ceil(F.col("_rows") / F.lit(1 << share_bits)).cast("int")
    return counted.where(F.col("_rows") > (1 << share_bits)).select(*key, salts.alias("_salts"))


def join_parent(
    rows: DataFrame, parents: DataFrame, key: str | list[str], *row_id: str, how: str = "inner", share_bits: int = SHARE_BITS
) -> DataFrame:
    """`rows` joined to the one row of `parents` with the same `key`; `row_id` tells rows apart."""
    key = [key] if isinstance(key, str) else key
    large = F.broadcast(large_parents(rows.select(*key), key, share_bits))
    salts = F.coalesce("_salts", F.lit(1))
    spread = rows.join(large, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*row_id), salts).cast("int"))
    repeated = parents.join(large, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.drop("_salts").join(repeated.drop("_salts"), [*key, "_salt"], how).drop("_salt")


def join_grid(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, share_bits: int = SHARE_BITS) -> DataFrame:
    """`left` joined to `right` where both may have very many rows of one `key`.

    A key with more than 2^share_bits rows on a side is a grid: its rows of the left are dealt to lines, those of the right to
    columns, and a row is repeated for each cell of its line or column. Cells are joined apart, so each has a bounded share of both
    sides. Other keys are one cell, and their rows are not repeated.
    """
    lines = F.broadcast(large_parents(left.select(key), [key], share_bits).withColumnRenamed("_salts", "_lines"))
    columns = F.broadcast(large_parents(right.select(key), [key], share_bits).withColumnRenamed("_salts", "_columns"))
    one = F.lit(1)

    def cells(rows: DataFrame, own: str, own_id: str, other: str) -> DataFrame:
        gridded = rows.join(lines, key, "left").join(columns, key, "left")
        dealt = F.pmod(F.xxhash64(own_id), F.coalesce(f"_{own}s", one)).cast("int")
        repeated = F.explode(F.sequence(F.lit(0), F.coalesce(f"_{other}s", one) - 1))
        return gridded.withColumn(f"_{own}", dealt).withColumn(f"_{other}", repeated).drop("_lines", "_columns")

    spread = cells(left, "line", left_id, "column").join(cells(right, "column", right_id, "line"), [key, "_line", "_column"])
    return spread.drop("_line", "_column")
