"""Running totals and ranks inside groups of any size.

A plain window puts a whole group into one task. Here the group is cut into blocks that follow its
order: a window runs inside each (group, block), a second one runs over one row per block, and the
two are added. No task ever holds more than a block, or one row for each block of a group.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pursebook.functions.times import day_number

# Ids of one block differ only in their low bits, so it holds at most 2^BLOCK_BITS rows.
BLOCK_BITS = 16


def id_block(row_id: Column | str) -> Column:
    return F.shiftright(row_id, BLOCK_BITS)


def newest_day_first(moment: Column | str) -> Column:
    return -day_number(moment)


def with_earlier_totals(
    rows: DataFrame,
    keys: list[str],
    block: Column,
    order_by: list[Column],
    sums: dict[str, Column],
    whole: dict[str, tuple[Callable[[Column], Column], Column]] | None = None,
) -> DataFrame:
    """Add to each row the `sums` over the rows before it in its group.

    `block` must not decrease along `order_by`, and `order_by` must be a total order. `whole` adds
    values of the entire group: name -> (sum, min or max, column).
    """
    whole = whole or {}
    # Never NULL, so that the join below adds no filter to one side and both share their input.
    rows = rows.withColumn("_block", F.coalesce(block, F.lit(0)))
    per_block = rows.groupBy(*keys, "_block").agg(
        *[F.sum(value).alias(f"_in_{name}") for name, value in sums.items()],
        *[merge(value).alias(name) for name, (merge, value) in whole.items()],
    )
    group = Window.partitionBy(*keys)
    blocks_before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys,
        "_block",
        *[
            F.coalesce(F.sum(f"_in_{name}").over(blocks_before), F.lit(0)).alias(f"_before_{name}")
            for name in sums
        ],
        *[merge(F.col(name)).over(group).alias(name) for name, (merge, _) in whole.items()],
    )
    rows_before = (
        Window.partitionBy(*keys, "_block").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = rows.select(
        "*",
        *[
            F.coalesce(F.sum(value).over(rows_before), F.lit(0)).alias(f"_inside_{name}")
            for name, value in sums.items()
        ],
    )
    joined = inside.join(offsets, [*keys, "_block"])
    return joined.select(
        *[c for c in rows.columns if c != "_block"],
        *[(F.col(f"_before_{name}") + F.col(f"_inside_{name}")).alias(name) for name in sums],
        *whole,
    )


def with_position(
    rows: DataFrame,
    keys: list[str],
    block: Column,
    order_by: list[Column],
    name: str = "position",
    whole: dict[str, tuple[Callable[[Column], Column], Column]] | None = None,
) -> DataFrame:
    """Add the 1-based place of each row in its group."""
    ranked = with_earlier_totals(rows, keys, block, order_by, {name: F.lit(1).cast("bigint")}, whole)
    return ranked.withColumn(name, F.col(name) + 1)


def newest_first(rows: DataFrame, key: str, row_id: str, **options) -> DataFrame:
    """Rank by created_on, latest first; the higher id goes first on equal times."""
    return with_position(
        rows,
        [key],
        newest_day_first("created_on"),
        [F.desc("created_on"), F.desc(row_id)],
        **options,
    )
