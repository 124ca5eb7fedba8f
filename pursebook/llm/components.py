"""Connected components of a graph given as links.

Alternating large-star and small-star steps: every step is a grouped minimum (combined before the
shuffle) joined back to the links, so that a vertex with many links never has to fit in a task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.llm.tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id that has a link, the smallest id it reaches.

    Links with a NULL end or to itself are passed over; repeated and reversed links count once.
    Without links the result is empty.
    """
    ends = [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    current = stored(links.where(F.col(a) != F.col(b)).select(*ends).distinct(), "links")
    before = None
    while True:
        state = _state(current)
        if state == before or state[0] == 0:
            break
        before = state
        current = stored(_small_star(_large_star(current)), "links")
    stars = current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.union(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    """Count and checksum of the links: equal after a round in which nothing moved."""
    checksum = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    return tuple(links.agg(F.count(F.lit(1)), checksum).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest of its neighbours and itself."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
