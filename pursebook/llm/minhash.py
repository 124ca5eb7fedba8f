"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Each document's set of word shingles is hashed once; the hash's top bits choose one of BINS bins and
each bin keeps its least value. An empty bin takes the value of the first filled bin in an order of
its own, the same for all documents, so that two documents still agree in it with the probability of
their similarity, independently of the other bins. Bands of ROWS bins are the buckets.

Documents with equal word sequences form one class, which is compared once. A bucket gives one
candidate per member: to its centre, a star instead of all pairs. The candidates are confirmed on
the full sets. A star alone could miss a link between two members that are both unlike the centre,
so buckets whose members are not yet connected get new centres, round after round, until a round
links few of its pairs. That only makes the rest small: the members of buckets that are still not
connected then go through an exact join on the rare shingles of their sets.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.llm.components import components
from pursebook.llm.tables import in_tasks, stored, texts

#: 32 bands of 4: a pair at similarity 0.8 shares no bucket with probability (1 - 0.8^4)^32 = 5e-8.
BIN_BITS = 7
BINS = 1 << BIN_BITS
ROWS = 4
BANDS = BINS // ROWS
#: rounds with centres at random before
RANDOM_ROUNDS = 2
#: a round that confirms no more than one of so many pairs is the last: large buckets of unlike members cost a pair each in every further one
FRUITLESS = 20
#: rows of one shingle that a part of the exact join compares with each other row of it
BLOCK = 2000
#: how far labels look for the least id between two rounds
STEPS = 4
WORDS_KEPT = 500_000

_SEED = np.random.default_rng(20)
_FACTORS = _SEED.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BOUNDS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
#: for each bin, the order in which it asks the others
_ORDER = np.stack([_SEED.permutation(BINS) for _ in range(BINS)])


class _Hashes(dict):
    """64-bit hashes of words, remembered; emptied when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_HASHES = _Hashes()


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text: A-Z lower-cased, cut at `[\x20\x09-\x0D]+`."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `size` words; of the whole sequence if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total += _mixed(hashes[i : len(words) - width + 1 + i] + _FACTORS[i]) * _FACTORS[i]
    return np.unique(_mixed(total))


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band, from sorted shingle hashes."""
    first = np.searchsorted(shingles, _BOUNDS)
    filled = np.append(first[1:], len(shingles)) > first
    values = shingles[np.minimum(first, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        asked = _ORDER[empty]
        values[empty] = values[asked[np.arange(len(empty)), filled[asked].argmax(axis=1)]]
    rows = values.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        total = _mixed(total * _FACTORS[8 + i] + rows[:, i])
    return total


def _signatures(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, keys, bands = [], [], [], []
            for text, doc_id in texts(batch, "doc_id"):
                words = words_of(text)
                shingles = shingle_hashes(words, size)
                ids.append(doc_id)
                counts.append(len(shingles))
                keys.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                bands.append(band_hashes(shingles).view(np.int64) if words else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip((ids, counts, keys, bands), schema, strict=True)], schema=schema
            )

    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for text, doc_id in texts(batch, "doc_id"):
                ids.append(doc_id)
                sets.append(shingle_hashes(words_of(text), size).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, schema.field(1).type)], schema=schema)

    return run


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return pairs.join(right, "b").join(left, "a").where(100 * shared >= percent * union).select("a", "b").distinct()


def _centres(members: DataFrame, *order: Column) -> DataFrame:
    """The centre of each bucket: its first member in the given order. Buckets whose members are all connected have none."""
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "id", "n", "component")).alias("first")
    groups = members.groupBy("bucket").agg(first, F.min("component").alias("lo"), F.max("component").alias("hi"))
    columns = [F.col("first.id").alias("centre"), F.col("first.n").alias("centre_n"), F.col("first.component").alias("centre_component")]
    return groups.where("lo < hi").select("bucket", *columns)


def _pairs(members: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Each bucket's star: its centre with its members of other components, where sizes allow a link."""
    similar_size = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    stars = members.join(centres, "bucket").where("component <> centre_component").where(similar_size)
    return stars.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _labels(links: DataFrame) -> DataFrame:
    """(id, component): the least id within STEPS links, a cheap stand-in for the component: equal ones are connected."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component"))
    for _ in range(STEPS - 1):
        of_b = labels.withColumnRenamed("a", "b")
        labels = both.join(of_b, "b").groupBy("a").agg(F.min("component").alias("component"))
    return labels.withColumnRenamed("a", "id")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, component, shingle, df, at): the rarest shared shingles of each of the sets (id, component, shingles).

    All sets have their shingles in one order, by how many sets hold them. `at` is the place in it, from
    0. Two sets that are similar enough share a shingle that has at least the shingles they must have in
    common from its place on, in both; only those that can be such are there.
    """
    #: a doc_id with different texts has a set for each
    sets = sets.withColumn("own", F.xxhash64("shingles")).dropDuplicates(["id", "own"])
    holders = sets.select("id", "own", F.explode("shingles").alias("shingle"))
    df = holders.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = holders.join(df, "shingle").groupBy("id", "own").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    sized = sets.select("id", "component", F.size("shingles").cast("long").alias("n"), "own").join(shared, ["id", "own"])
    first = F.col("n") - F.size("shared")
    #: the places up to which at least percent * n / 100 shingles follow
    places = F.floor((100 - percent) * F.col("n") / F.lit(100)) + 1 - first
    sized = sized.select("id", "n", "component", first.alias("first"), "shared", places.cast("int").alias("places")).where("places > 0")
    listed = sized.select("id", "n", "component", "first", F.posexplode(F.slice("shared", F.lit(1), F.col("places"))).alias("place", "of"))
    return listed.select("id", "n", "component", F.col("of.shingle").alias("shingle"), F.col("of.df").alias("df"), (F.col("first") + F.col("place")).alias("at"))


def _exact_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of different components that may be linked, of buckets that are not connected.

    A bucket of two has had its one pair compared by its first star.
    """
    open_ = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    chosen = members.join(open_.where("lo < hi AND size > 2").select("bucket"), "bucket", "left_semi").select("id", "component").distinct()
    prefixes = stored(_prefixes(sets.join(chosen, "id"), percent), "prefixes")
    parts = F.ceil(F.col("df") / F.lit(BLOCK)).cast("int")
    #: the smaller set's shingle has 2 * percent / (100 + percent) of it from its place on, as the other one is no smaller
    small = prefixes.where((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n"))
    small = small.select("shingle", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"small_{c}") for c in ("id", "n", "component", "at")])
    large = prefixes.select("*", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    common = F.least(F.col("n") - F.col("at"), F.col("small_n") - F.col("small_at"))
    fits = (100 + percent) * common >= percent * (F.col("n") + F.col("small_n"))
    pairs = large.join(small, ["shingle", "part"]).where("(small_n, small_id) < (n, id) AND component <> small_component").where(fits)
    return pairs.select(F.least("id", "small_id").alias("a"), F.greatest("id", "small_id").alias("b")).distinct()


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between the members of the buckets: enough to connect all that have one.

    At first the smallest id is a bucket's centre. Later only buckets with members that aren't known
    to be connected take part: in some rounds with a centre at random, then with one from a random
    component of the bucket, which meets every member that it isn't connected with. A round costs at
    most one pair per member of a bucket. When one confirms few of its pairs, the exact join finds all
    links that are left.
    """
    alone = members.withColumn("component", F.col("id"))
    tried = stored(_pairs(alone, _centres(alone, F.col("id")), percent), "pairs")
    links = stored(_confirmed(sets, tried, percent), "links")
    turn = 0
    while True:
        turn += 1
        labels = stored(_labels(links), "labels")
        placed = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        last = turn > RANDOM_ROUNDS
        if last:
            sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
            placed = placed.join(sizes, "component", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        placed = stored(placed, "placed")
        #: uniform in (0, 1]; for the last rounds a race in which each component is as likely to win, however large
        chance = (F.pmod(F.xxhash64("id", "bucket", F.lit(turn)), F.lit(1 << 30)) + 1) / float(1 << 30)
        order = -F.ln(chance) * F.col("size") if last else chance
        centres = _centres(placed, order)
        pairs = stored(_pairs(placed, centres, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stored(_confirmed(sets, pairs, percent), "links")
        tried, links = tried.union(pairs), links.union(found)
        if found.count() * FRUITLESS <= pairs.count():
            break
    placed = members.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    pairs = stored(_exact_pairs(stored(placed, "placed"), sets, percent), "pairs")
    return links.union(stored(_confirmed(sets, pairs, percent), "links"))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of `words`-word
    shingles; a shorter document's whole sequence is its one shingle. Documents without words have no
    shingles and are linked with nothing. `component_id` is the smallest doc_id reachable by links.
    Rows that share a doc_id are the same document: they share its component and are kept alike. A row
    without doc_id is its own, with NULL component, and kept. Other columns are not looked at.
    """
    documents = documents.select("doc_id", "text")
    schema = "doc_id long, n_shingles long, key binary, bands array<long>"
    rows = stored(in_tasks(documents, _signatures(words), schema), "signatures")
    filled = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    #: of rows with equal words the smallest doc_id stands for all
    first = F.min(F.struct("doc_id", "n_shingles", "bands")).alias("first")
    classes = stored(filled.groupBy("key").agg(first).select("key", "first.*"), "classes")
    buckets = classes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    classes = classes.select("key", F.col("doc_id").alias("id"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    members = stored(buckets.join(shared, "bucket", "left_semi"), "buckets")
    chosen = documents.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(in_tasks(chosen, _sets(words), "id long, shingles array<long>"), "shingle-sets")
    links = _links(members, sets, percent)
    #: rows of one doc_id with different texts are one document
    several = filled.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("doc_id")
    if not several.isEmpty():
        owned = filled.join(several, "doc_id", "left_semi").join(classes, "key").select("doc_id", "id").distinct()
        lowest = owned.groupBy("doc_id").agg(F.min("id").alias("lo"))
        links = links.union(owned.join(lowest, "doc_id").select(F.col("id").alias("a"), F.col("lo").alias("b")))
    placed = classes.join(components(links), "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    return rows.join(placed, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
