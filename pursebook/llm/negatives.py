"""Hard negatives for anchors, by lists that the anchors of a cluster share.

Anchors and rows are dealt to the nearest of some centres. Groups of anchors and blocks of rows, both of bounded size and each
made of neighbouring clusters, meet in a task at most once. There, for each cluster of anchors, the block's rows are sorted
once by the highest score that any anchor of the cluster could reach with them, from their angle to the centre; each
anchor walks down that list until nothing below it can enter its result any more. Groups first walk the blocks that hold
rows of their own clusters. What an anchor found there is its floor elsewhere, and blocks whose highest possible scores
lie below the floors of a group aren't sent to it. Scores are exact integers.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pursebook.llm.tables import in_tasks, stored

CENTRES = 64
SAMPLED = 4096
# Components of all anchors of a group, and of all rows of a block and cluster.
CELL = 1 << 20
SLICE = 512
ANY = (-(1 << 62), 1 << 62)

Centres = dict[int, np.ndarray]


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
    scale: int = 256,
    cell: int = CELL,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Components become floor(scale * x); a score is the integer inner product, higher first, ties by smaller vec_id. An
    anchor's positives are its first other rows with the same label; a positive's negatives are the first rows with another
    label whose score is at least `least_percent` and at most `most_percent` of the positive's. Rows without vec_id, label or
    vector, with a NULL or non-finite component, or of a length of 2^31 or more (so that scores fit) take no part; of several rows
    with one vec_id the least by label and vector does. Vectors of different sizes never meet. Where fewer rows qualify,
    fewer are returned, and none without anchors. Centres are fitted on at most SAMPLED anchors, drawn by a hash; they decide
    on the work, not on the result.
    """
    rows = stored(_whole(vectors, is_anchor, scale), "vectors")
    centres = _centres(rows)
    cells = stored(_cells(_with_centres(rows, centres), cell), "cells")
    anchors = cells.where("is_anchor")
    every = F.array(_want(F.lit(0), F.lit(ANY[0]), F.lit(ANY[1])))
    near = _first(_search(anchors.withColumn("wants", every), cells, centres, True, positives), positives)
    near = near.select("anchor_id", F.col("rank").alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stored(near, "positives")
    # The whole scores between the percentages.
    share = F.col("positive_score").cast("decimal(28,0)")
    low, high = F.ceil(share * least_percent / 100).cast("long"), F.floor(share * most_percent / 100).cast("long")
    bands = near.where(low <= high).groupBy("anchor_id").agg(F.sort_array(F.collect_list(_want(F.col("want"), low, high))).alias("wants"))
    asking = anchors.join(bands.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _first(_search(asking, cells, centres, False, negatives), negatives)
    found = found.select("anchor_id", "want", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor_id", "want"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _want(want: Column, low: Column, high: Column) -> Column:
    """What an anchor looks for: its rows with scores from `low` to `high`."""
    return F.struct(want.cast("int").alias("want"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def _whole(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """(vec_id, label, v, norm, is_anchor, size): the rows that take part, in whole numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    floors = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    fitting = (
        usable.select("vec_id", F.col("label").cast("long").alias("label"), floors.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
        .withColumn("norm", norm)
        .where(F.col("norm") < float(1 << 31))
    )
    least = F.min(F.struct("label", F.transform("v", lambda x: x.cast("long")).alias("v"), "norm", "is_anchor")).alias("row")
    return fitting.groupBy("vec_id").agg(least).select("vec_id", "row.*", F.size("row.v").alias("size"))


def _centres(rows: DataFrame) -> Centres:
    """Per vector size unit centres, at most CENTRES, by a few rounds of spherical k-means on a bounded sample of anchors."""
    drawn = rows.where("is_anchor AND norm > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED).select("size", "v", "norm").toPandas()
    found = {}
    for size, part in drawn.groupby("size"):
        units = _matrix(part["v"]) / part["norm"].to_numpy()[:, None]
        centres = units[: max(1, min(CENTRES, math.isqrt(len(units))))]
        for _ in range(8):
            nearest = np.argmax(units @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, units)
            lengths = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), centres)
        found[int(size)] = centres
    return found


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64)


def _angles(vectors: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each vector to each centre; of a vector of length 0 a right angle."""
    return np.arccos(np.clip(vectors @ centres.T / np.maximum(norms, 1.0)[:, None], -1, 1))


def _with_centres(rows: DataFrame, centres: Centres) -> DataFrame:
    """Add the nearest centre, the angle to it, and how many there are; sizes without a centre make one cluster of any width."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select(["v", "norm", "size"]).to_pandas()
            centre, angle, of = np.zeros(len(frame), np.int32), np.full(len(frame), math.pi), np.ones(len(frame), np.int32)
            for size, part in frame.groupby("size"):
                if size in centres:
                    angles = _angles(_matrix(part["v"]), part["norm"].to_numpy(), centres[size])
                    centre[part.index], angle[part.index], of[part.index] = angles.argmin(axis=1), angles.min(axis=1), len(centres[size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre), pa.array(angle), pa.array(of)], [*batch.schema.names, "centre", "angle", "of"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return in_tasks(rows, nearest, f"{kinds}, centre int, angle double, of int")


def _cells(centred: DataFrame, cell: int) -> DataFrame:
    """Add the `block` of each row and the `group` it is in as an anchor.

    Neighbouring clusters share a block or group of about `cell` components; a larger cluster is cut into several by a hash.
    """
    most = F.greatest(F.floor(F.lit(cell) / F.greatest("size", F.lit(1))), F.lit(1))
    counts = centred.groupBy("size", "centre").agg(F.count(F.lit(1)).alias("_rows"), F.count_if("is_anchor").alias("_anchors"))
    whole = Window.partitionBy("size")
    cuts = counts.select(
        "size",
        "centre",
        *[F.greatest(F.ceil(F.sum(f"_{name}").over(whole) / most), F.lit(1)).alias(f"_all_{name}") for name in ("rows", "anchors")],
        *[F.greatest(F.ceil(F.col(f"_{name}") / most), F.lit(1)).alias(f"_cut_{name}") for name in ("rows", "anchors")],
    )

    def place(name: str, seed: int) -> Column:
        shared = F.floor(F.col("centre") * F.least(f"_all_{name}", "of") / F.col("of"))
        return F.concat_ws(":", "size", shared, F.pmod(F.xxhash64("vec_id", F.lit(seed)), f"_cut_{name}"))

    spread = centred.join(cuts, ["size", "centre"])
    return spread.select(*centred.columns, place("rows", 1).alias("block"), place("anchors", 2).alias("group"))


def _first(found: DataFrame, k: int) -> DataFrame:
    """Add `rank` to the first k rows of each want; there are at most k of each group and block that met."""
    order = Window.partitionBy("anchor_id", "want").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(asking: DataFrame, cells: DataFrame, centres: Centres, same: bool, k: int) -> DataFrame:
    """(anchor_id, want, vec_id, score): the first k rows of each want and perhaps some more; of the same label or of others."""
    mine, theirs = asking.select("size", "centre", "group").distinct(), cells.select("size", "centre", "block").distinct()
    home = stored(mine.join(theirs, ["size", "centre"]).select("group", "block").distinct(), "home")
    found = stored(_walked(asking, cells, home, centres, same, k), "found")
    floors = _first(found, k).where(F.col("rank") == k).select(F.col("anchor_id").alias("vec_id"), "want", F.col("score").alias("floor"))
    wants = asking.select("vec_id", F.inline("wants")).join(floors, ["vec_id", "want"], "left")
    raised = wants.groupBy("vec_id").agg(F.sort_array(F.collect_list(_want(F.col("want"), F.greatest("low", "floor"), F.col("high")))).alias("wants"))
    raised = stored(asking.drop("wants").join(raised, "vec_id"), "raised")
    rest = stored(_reaching(raised, cells, centres).join(home, ["group", "block"], "left_anti"), "rest")
    return found.unionByName(_walked(raised, cells, rest, centres, same, k))


def _slack(norms):
    """More than rounding can take off a bound, for a vector of length 1."""
    return norms * 1e-6


def _reaching(asking: DataFrame, cells: DataFrame, centres: Centres) -> DataFrame:
    """The (group, block) pairs in which an anchor may reach its floor, from one row of each cluster of each.

    Vectors of two clusters are at least as far apart as the centres less both widths.
    """
    apart = [
        (size, a, b, float(angle))
        for size, of_size in centres.items()
        for a, row in enumerate(np.arccos(np.clip(of_size @ of_size.T, -1, 1)))
        for b, angle in enumerate(row)
    ]
    between = asking.sparkSession.createDataFrame(apart, "size int, centre int, other int, apart double")
    floor = F.array_min(F.transform("wants", lambda want: want["low"]))
    need = F.when(F.col("norm") > 0, (floor - 1) / F.col("norm")).otherwise(F.lit(-math.inf))
    groups = asking.groupBy("size", "centre", "group").agg(F.min(need).alias("need"), F.max("angle").alias("wide"))
    blocks = cells.groupBy("size", F.col("centre").alias("other"), "block").agg(F.max("norm").alias("longest"), F.max("angle").alias("broad"))
    nearest = F.cos(F.greatest(F.col("apart") - F.col("wide") - F.col("broad"), F.lit(0.0)))
    reach = F.greatest(nearest, F.lit(0.0)) * F.col("longest") + _slack(F.col("longest"))
    return groups.join(between, ["size", "centre"]).join(blocks, ["size", "other"]).where(reach >= F.col("need")).select("group", "block").distinct()


def _walked(asking: DataFrame, cells: DataFrame, pairs: DataFrame, centres: Centres, same: bool, k: int) -> DataFrame:
    anchors = asking.select("group", "size", "centre", "vec_id", "label", "v", "norm", "wants").join(pairs, "group")
    # New names: both sides come from one table.
    rows = cells.select("block", "vec_id", "label", "v", "norm").toDF("block", "row_id", "row_label", "row_v", "row_norm").join(pairs, "block")
    rows = rows.withColumnsRenamed({"group": "row_group", "block": "row_block"})
    together = anchors.groupBy("group", "block").cogroup(rows.groupBy("row_group", "row_block"))
    return together.applyInPandas(
        lambda mine, theirs: _walk(mine, theirs, centres, same, k), "anchor_id long, want int, vec_id long, score long"
    )


def _walk(mine: pd.DataFrame, theirs: pd.DataFrame, centres: Centres, same: bool, k: int) -> pd.DataFrame:
    """All clusters of a group of anchors against a block of rows."""
    found = []
    if len(mine) and len(theirs):
        theirs = theirs.sort_values("row_id", kind="stable")
        block = _matrix(theirs["row_v"]), *(theirs[name].to_numpy() for name in ("row_norm", "row_label", "row_id"))
        of_size = centres.get(int(mine["size"].iloc[0]))
        angles = None if of_size is None else _angles(block[0], block[1], of_size)
        for centre, members in mine.groupby("centre"):
            found += _walk_list(members, block, None if angles is None else (angles[:, centre], of_size[centre]), same, k)
    return pd.DataFrame(found, columns=["anchor_id", "want", "vec_id", "score"]).astype({"anchor_id": "int64", "want": "int32", "vec_id": "int64", "score": "int64"})


def _walk_list(members: pd.DataFrame, block: tuple, around: tuple | None, same: bool, k: int) -> list[tuple]:
    """One cluster's shared list, walked by its members slice by slice, each until its end is certain."""
    rows, lengths, labels, ids = block
    own, own_norm = _matrix(members["v"]), members["norm"].to_numpy()
    own_label, own_id = members["label"].to_numpy(), members["vec_id"].to_numpy()
    if around is None:
        reach = lengths
    else:
        wide = _angles(own, own_norm, around[1][None]).max()
        reach = lengths * np.cos(np.maximum(around[0] - wide, 0.0))
    listed = np.argsort(-reach, kind="stable")
    wants = [(m, w["want"], w["low"], w["high"]) for m, found in enumerate(members["wants"]) for w in found]
    member, low, high = (np.array([w[i] for w in wants], dtype=np.int64) for i in (0, 2, 3))
    best: list[list[tuple[int, int]]] = [[] for _ in wants]
    # Products of whole numbers below 2^53 are exact as doubles, which multiply faster.
    kind = float if own_norm.max() * lengths.max() < 2**52 else np.int64
    own, rows = own.astype(kind), rows.astype(kind)
    longest = lengths.max()
    for first in range(0, len(listed), SLICE):
        bound = own_norm * (reach[listed[first]] + _slack(longest)) + 1
        walking = np.flatnonzero(bound[member] >= low)
        if not len(walking):
            break
        # In the order of vec_id, as the block is.
        part = np.sort(listed[first : first + SLICE])
        movers, place = np.unique(member[walking], return_inverse=True)
        scores = (own[movers] @ rows[part].T).astype(np.int64)
        fits = (own_label[movers][:, None] == labels[part][None]) == same
        fits &= own_id[movers][:, None] != ids[part][None]
        for i in np.unique(place):
            mask = fits[i]
            row = scores[i]
            for want in walking[place == i]:
                hits = np.flatnonzero(mask & (row >= low[want]) & (row <= high[want]))
                if len(hits):
                    if len(hits) > k:
                        hits = hits[np.argsort(-row[hits], kind="stable")[:k]]
                    new = zip((-row[hits]).tolist(), ids[part[hits]].tolist(), strict=True)
                    best[want] = sorted([*best[want], *new])[:k]
                    if len(best[want]) == k:
                        low[want] = max(low[want], -best[want][-1][0])
    return [(own_id[m], want, vec_id, -score) for (m, want, *_), kept in zip(wants, best, strict=True) for score, vec_id in kept]
