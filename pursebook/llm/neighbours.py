"""Near-duplicate vectors by NN-descent.

1. Equal vectors of a label form one class, which is compared once and counts by its size.
2. A projection sorts the vectors of a label; stretches of that order are the blocks, of bounded size. A task holds a block.
3. Start, in each block: several random projections sort its vectors; in short overlapping runs of each order every vector
   takes its best neighbours. A list has LIST places.
4. Descent: each vertex takes a sample of its neighbours, in both directions, and compares them with each other:
   neighbours of neighbours. Pairs that improve a list go into it. Only entries that were sampled at both ends count as
   asked. Rounds end when no list changes. What the links in the lists connect is a star, known by its smallest id.
5. Then every vector is checked against all vectors of its label, each two blocks in a task: that counts its links, those in
   no list too, and joins the stars that a link connects. So no link is lost, whatever the descent has found.

A group of m near copies makes a star and a count for each copy, not m^2 rows. The comparisons of the check grow with the square of a
label; what a task holds doesn't.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.llm.components import components
from pursebook.llm.tables import in_tasks, stored

LIST = 6
SAMPLE = 12
TABLES = 8
RUN = 96
#: signs that sort the vectors of a block: so many at least, and one more whenever a block has twice as many vectors
LEAST_BITS = 10
VECTORS_A_SECTOR = 8
#: signs that sort the vectors of a label into blocks
MOST_BITS = 48
#: vectors of a block at most, and bytes of their components; blocks of fewer bytes than LEAST_BYTES are not worth a task
BLOCK = 1 << 14
MOST_BYTES = 1 << 23
LEAST_BYTES = 1 << 20
#: vectors that meet a whole block at once, and pairs that wait for a place in a list
TILE = 256
WAITING = 1 << 21


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """The vectors in double precision, one a row, of length 1."""
    rows = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their components in double precision, scaled by a power of two against overflow."""
    for batch in batches:
        packed = []
        for values in batch.column("embedding").to_pylist():
            row = np.array(values, np.float64)
            packed.append(np.ldexp(row, -int(np.frexp(np.abs(row).max())[1])).tobytes())
        columns = [batch.column("id"), batch.column("n"), batch.column("cell"), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "cell", "vector"])


def _groups(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[dict[str, list]]:
    """The columns of each group of rows with the same key, of up to `most` rows at a time; the rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.array(batch.column(key).to_pylist())
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1)] if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and held[0].column(key)[0].as_py() != keys[start]:
                yield _columns(held)
                held = []
            while most and (room := most - sum(part.num_rows for part in held)) < end - start:
                held.append(batch.slice(start, room))
                start += room
                yield _columns(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> dict[str, list]:
    return {name: [v for part in parts for v in part.column(name).to_pylist()] for name in parts[0].schema.names}


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a vector lies in a random order: the signs of projections, and one projection within equal signs."""
    for batch in batches:
        places = []
        for raw in batch.column("vector").to_pylist():
            row = _matrix([raw])[0]
            at = _planes(len(row)) @ row
            places.append((int((at[:-1] > 0) @ (1 << np.arange(MOST_BITS - 1, -1, -1))), float(at[-1])))
        columns = [batch.column(c) for c in ("id", "n", "cell", "vector")]
        columns += [pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "cell", "vector", "sector", "place"])


_known_planes: dict[int, np.ndarray] = {}


def _planes(size: int) -> np.ndarray:
    if size not in _known_planes:
        _known_planes[size] = np.random.default_rng(size).standard_normal((MOST_BITS + 1, size))
    return _known_planes[size]


class _Lists:
    """The best neighbours found of each vector of a block: their numbers, best first, and whether they are still to be asked."""

    def __init__(self, rows: np.ndarray, places: int):
        self.rows, self.places = rows, min(places, len(rows) - 1)
        shape = (len(rows), self.places)
        self.near, self.sims, self.fresh = np.full(shape, -1), np.full(shape, -2.0), np.zeros(shape, bool)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, sim, fresh) of each place that is taken."""
        u, at = np.nonzero(self.near >= 0)
        return u, self.near[u, at], self.sims[u, at], self.fresh[u, at]

    def offer(self, u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> bool:
        """Take in the pairs that are better than a list's last; whether there were new ones."""
        better = sim > self.sims[u, -1]
        u, v, sim = u[better], v[better], sim[better]
        touched = np.zeros(len(self.rows), bool)
        touched[u] = True
        known = self.entries()
        known = [part[touched[known[0]]] for part in known]
        u, v, sim = np.concatenate([known[0], u]), np.concatenate([known[1], v]), np.concatenate([known[2], sim])
        new = np.arange(len(u)) >= len(known[0])
        fresh = np.concatenate([known[3], np.ones(len(u) - len(known[0]), bool)])
        # What is known comes first of equal pairs.
        _, first = np.unique(u * len(self.rows) + v, return_index=True)
        u, v, sim, new, fresh = u[first], v[first], sim[first], new[first], fresh[first]
        order = np.lexsort((v, -sim, u))
        u, v, sim, new, fresh = u[order], v[order], sim[order], new[order], fresh[order]
        rank = _rank(u)
        kept = rank < self.places
        at = u[kept], rank[kept]
        self.near[at], self.sims[at], self.fresh[at] = v[kept], sim[kept], fresh[kept]
        return bool(new[kept].any())


def _rank(keys: np.ndarray) -> np.ndarray:
    """The place of each of the sorted `keys` among its equals."""
    at = np.arange(len(keys))
    starts = np.ones(len(keys), bool)
    starts[1:] = keys[1:] != keys[:-1]
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def _start(lists: _Lists, rng: np.random.Generator, tables: int, run: int) -> None:
    """Each vector's best neighbours among the next ones in several random orders."""
    rows = lists.rows
    bits = max(LEAST_BITS, math.ceil(math.log2(len(rows) / VECTORS_A_SECTOR)))
    for _ in range(tables):
        at = rows @ rng.standard_normal((rows.shape[1], bits + 1))
        order = np.lexsort((at[:, bits], (at[:, :bits] > 0) @ (1 << np.arange(bits))))
        found = []
        for start in range(0, max(len(order) - run // 2, 1), run // 2):
            own = order[start : start + run]
            sims = rows[own] @ rows[own].T
            np.fill_diagonal(sims, -2.0)
            k = min(lists.places, len(own) - 1)
            if k > 0:
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                found.append((np.repeat(own, k), own[best].ravel(), np.take_along_axis(sims, best, 1).ravel()))
        if found:
            lists.offer(*(np.concatenate([f[i] for f in found]) for i in range(3)))


def _round(lists: _Lists, rng: np.random.Generator, sample: int) -> bool:
    """Compares the sampled neighbours of each vertex with each other; whether a list has changed."""
    count = len(lists.rows)
    u, v, _, fresh = lists.entries()
    active = np.zeros(count, bool)
    active[u[fresh]] = active[v[fresh]] = True
    pairs = np.unique(np.concatenate([u * count + v, v * count + u]))
    pairs = pairs[active[pairs // count]]
    sizes = np.bincount(pairs // count, minlength=count)[pairs // count]
    pairs = pairs[rng.random(len(pairs)) * sizes < np.maximum(sample, 2.2 * np.sqrt(sizes))]
    asked = np.isin(u * count + v, pairs) & np.isin(v * count + u, pairs)
    row, place = np.nonzero(lists.near >= 0)
    lists.fresh[row, place] = fresh & ~asked
    at, nb = pairs // count, pairs % count
    # Vertices with equally many sampled neighbours are joined together, without any padding.
    many = np.bincount(at, minlength=count)[at]
    order = np.lexsort((at, many))
    nb, many = nb[order], many[order]
    changed, found, waiting = False, [], 0
    for m, start, end in zip(*_stretches(many), strict=True):
        if m < 2:
            continue
        groups = nb[start:end].reshape(-1, m)
        step = max(1, WAITING // (m * max(m, lists.rows.shape[1])))
        for own in (groups[i : i + step] for i in range(0, len(groups), step)):
            rows = lists.rows[own]
            sims = rows @ rows.transpose(0, 2, 1)
            sims[:, np.arange(m), np.arange(m)] = -2.0
            g, i, j = np.nonzero(sims > lists.sims[own, -1][:, :, None])
            found.append((own[g, i], own[g, j], sims[g, i, j]))
            waiting += len(g)
            if waiting > WAITING:
                changed |= lists.offer(*(np.concatenate([f[i] for f in found]) for i in range(3)))
                found, waiting = [], 0
    if found:
        changed |= lists.offer(*(np.concatenate([f[i] for f in found]) for i in range(3)))
    return changed


def _stretches(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(value, start, end) of each stretch of equal ones."""
    starts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1)] if len(values) else []
    return [int(values[s]) for s in starts], starts, [*starts[1:], len(values)][: len(starts)]


def _joined(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `count` vertices the smallest one it reaches by the links (a, b)."""
    least = np.arange(count)
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return least


def _descents(threshold: float, places: int, block: int, tables: int, run: int, sample: int):
    """The vectors with their block and the star that the links among their best neighbours make them part of."""

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, group in enumerate(_groups(batches, "cell", block), first):
            ids = np.array(group["id"], np.int64)
            # By id, so that the first of a star is its smallest.
            order = np.argsort(ids)
            ids, vectors = ids[order], [group["vector"][i] for i in order]
            stars = ids
            if len(ids) > 1:
                lists, rng = _Lists(_matrix(vectors), places), np.random.default_rng(len(ids))
                _start(lists, rng, tables, run)
                while _round(lists, rng, sample):
                    pass
                u, v, sims, _ = lists.entries()
                linked = sims >= threshold
                stars = ids[_joined(len(ids), u[linked], v[linked])]
            for start in range(0, len(ids), TILE * 8):
                part = slice(start, start + TILE * 8)
                columns = [pa.array(ids[part]), pa.array([group["n"][i] for i in order[part]], pa.int64()), pa.array(group["cell"][part])]
                columns += [pa.array(vectors[part], pa.binary()), pa.array([number] * len(ids[part]), pa.int64()), pa.array(stars[part])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "cell", "vector", "block", "star"])

    return in_blocks


def _checked(threshold: float):
    """(id, others, root): how many links each vector has between two blocks, and for stars that links join the smallest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "pair"):
            second = np.array(group["second"])
            order = np.argsort(second, kind="stable")
            ids, sizes = np.array(group["id"], np.int64)[order], np.array(group["n"], np.int64)[order]
            rows = _matrix([group["vector"][i] for i in order])
            stars, star = np.unique(np.array(group["star"], np.int64)[order], return_inverse=True)
            root, others = np.arange(len(stars)), np.zeros(len(ids), np.int64)
            within = not second.any()
            first = len(ids) - int(second.sum())
            for start in range(0, first, TILE):
                end, right = min(start + TILE, first), start if within else first
                linked = rows[start:end] @ rows[right:].T >= threshold
                i, j = np.nonzero(np.triu(linked, 1) if within else linked)
                i, j = i + start, j + right
                np.add.at(others, i, sizes[j])
                np.add.at(others, j, sizes[i])
                a, b = root[star[i]], root[star[j]]
                apart = np.unique(a[a != b] * len(stars) + b[a != b])
                root = _joined(len(stars), apart // len(stars), apart % len(stars))[root]
            has, moved = np.flatnonzero(others), np.flatnonzero(root != np.arange(len(stars)))
            columns = [np.concatenate([ids[has], stars[moved]]), np.concatenate([others[has], np.zeros_like(moved)])]
            columns += [np.concatenate([ids[has], stars[root[moved]]])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "others", "root"])

    return run


def _blocks(vectors: DataFrame, threshold: float, places: int) -> DataFrame:
    """(id, n, cell, vector, block, star): the blocks after the descent in each of them."""
    held = vectors.agg(F.sum(F.length("vector"))).first()[0] or 0
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-held // MOST_BYTES), min(cores, held // LEAST_BYTES), 1)
    placed = in_tasks(vectors, _sketch, "id long, n long, cell string, vector binary, sector long, place double")
    order = ["cell", "sector", "place", "id"]
    ordered = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("id", "n", "cell", "vector")
    descents = _descents(threshold, places, BLOCK, TABLES, RUN, SAMPLE)
    return stored(in_tasks(ordered, descents, "id long, n long, cell string, vector binary, block long, star long"), "blocks")


def links(vectors: DataFrame, threshold: float, places: int = LIST) -> tuple[DataFrame, DataFrame]:
    """Of (id, n, cell, vector) rows, n of which are equal: (id, others), how many rows of its cell are similar enough to a vector that is
    not equal; and (u, v), what these links connect, as many at most as there are vectors in the blocks that meet."""
    rows = _blocks(vectors, threshold, places)
    blocks = rows.select("cell", "block").distinct()
    met = blocks.join(blocks.select("cell", F.col("block").alias("other")), "cell").where("block <= other")
    pairs = stored(met.select("block", "other", F.concat_ws("/", "block", "other").alias("pair")), "block-pairs")
    either = pairs.select("block", "pair", F.lit(False).alias("second")).union(pairs.where("block <> other").select("other", "pair", F.lit(True)))
    grouped = rows.join(either, "block").select("pair", "second", "id", "n", "vector", "star")
    grouped = grouped.repartition(max(pairs.count(), 1), "pair").sortWithinPartitions("pair")
    checked = stored(in_tasks(grouped, _checked(threshold), "id long, others long, root long"), "checked")
    counts = checked.where("others > 0").groupBy("id").agg(F.sum("others").alias("others"))
    stars = rows.where("id <> star").select(F.col("id").alias("u"), F.col("star").alias("v"))
    return counts, stars.union(checked.where("id <> root").select("id", "root"))


def _comparable(embedding: Column) -> Column:
    """Neither NULL, nor empty, nor all zero, nor with a component that is NULL or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors of equal labels and lengths are linked if their cosine is at least `threshold`; those
    with a NULL label, a NULL, empty or zero vector, or a component that is NULL or not finite, are
    linked with nothing. `n_links` counts other vec_ids; rows that repeat vec_id, label and vector
    count once. Rows without vec_id are linked with nothing, have no component, and are kept. Other
    columns are not looked at.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    fit = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _comparable(F.col("embedding"))).alias("fit")
    rows = rows.select("*", F.coalesce(fit, F.lit(False)).alias("fit"))
    classes = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n"))
    classes = stored(classes, "vector-classes")
    cell = F.concat_ws(":", "label", F.size("embedding")).alias("cell")
    packed = stored(in_tasks(classes.select("id", "n", cell, "embedding"), _packed, "id long, n long, cell string, vector binary"), "vectors")
    linked, connected = links(packed, threshold)
    reached = components(connected, "u", "v")
    placed = classes.join(linked, "id", "left").join(reached, "id", "left").select(
        F.col("label").alias("_label"),
        F.col("embedding").alias("_embedding"),
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    matching = F.col("fit") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    return rows.join(placed, matching, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
