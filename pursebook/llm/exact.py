"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and
each gets an integer name; then the names of adjacent blocks are paired, the distinct pairs are
sorted and named, and so on until every document is left with a single name. Two texts of the same
length have the same name exactly if they are equal.

Only the distinct blocks move as text. A block's occurrences carry its 64-bit hash instead, which
finds the name; blocks that share a hash with a different block are found by counting and then
looked up by their bytes, so a collision can't join two texts.

Distinct values are combined before each shuffle and the names are joined back with joins that
Spark may split, so a text that makes up a third of all rows has no task of its own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.llm.tables import named, same, stored

#: The characters deleted before texts are compared: `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _blocks(raw: Column, length: Column, size: int) -> Column:
    last = F.greatest(F.ceil(length / size).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _hash(block: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - bits) if bits < 64 else F.xxhash64(block)


def text_identities(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, n_points, n_bytes, name) of each row; (n_bytes, name) tells normalised texts apart.

    NULL text counts as empty; an empty text has one empty block. Rows with the same doc_id, NULL
    too, are told apart by their text. `hash_bits` is lowered in tests to make hashes collide.
    """
    raw = documents.select("doc_id", "text", normalised(F.col("text")).cast("binary").alias("raw"))
    blocks = _blocks(F.col("raw"), F.length("raw"), block_bytes)
    hashed = raw.select(
        "doc_id",
        F.sha2("raw", 256).alias("text_sha256"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        F.length("raw").cast("long").alias("n_bytes"),
        F.transform(blocks, lambda block: _hash(block, hash_bits)).alias("hashes"),
    )
    rows = stored(hashed, "block-hashes")

    exploded = raw.select(F.explode(blocks).alias("block"))
    distinct = exploded.select(_hash(F.col("block"), hash_bits).alias("h"), "block").distinct()
    sorted_blocks = distinct.sortWithinPartitions("block").select("h", F.monotonically_increasing_id().alias("name"))
    names = stored(sorted_blocks, "block-names")
    clashing = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")

    keyed = rows.select("doc_id", "text_sha256", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    if clashing.isEmpty():
        parts = keyed.join(names, "h").select("doc_id", "text_sha256", "n", "pos", "name")
    else:
        parts = _named_by_bytes(raw, keyed, names, clashing, blocks, hash_bits)
    singles = _paired(stored(parts.distinct(), "block-sequence"))
    return rows.join(
        singles.withColumnsRenamed({"doc_id": "_doc", "text_sha256": "_sha"}),
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_sha256") == F.col("_sha")),
    ).select("doc_id", "text_sha256", "n_points", "n_bytes", "name")


def _named_by_bytes(
    raw: DataFrame, keyed: DataFrame, names: DataFrame, clashing: DataFrame, blocks: Column, hash_bits: int
) -> DataFrame:
    """The parts, where blocks whose hash stands for several blocks are looked up by their bytes."""
    plain = keyed.join(names.join(clashing, "h", "left_anti"), "h")
    found = raw.select("doc_id", F.sha2("raw", 256).alias("text_sha256"), F.posexplode(blocks).alias("pos", "block"))
    found = stored(found.withColumn("h", _hash(F.col("block"), hash_bits)).join(clashing, "h", "left_semi"), "clashing")
    #: negative names, so that they differ from those of the other blocks
    own = named(found.select("block"), "clashing-names").withColumn("name", -1 - F.col("name"))
    lengths = keyed.select("doc_id", "text_sha256", "n").distinct()
    found = found.join(own, "block").select("doc_id", "text_sha256", "pos", "name")
    clashed = found.join(lengths, same(found, lengths, "doc_id", "text_sha256")).select(
        found["doc_id"], found["text_sha256"], "n", "pos", "name"
    )
    return plain.select("doc_id", "text_sha256", "n", "pos", "name").union(clashed)


def _paired(parts: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, name): the one name left of each sequence of names."""
    done = None
    while True:
        single = parts.where("n = 1").select("doc_id", "text_sha256", "name")
        done = single if done is None else done.union(single)
        open_parts = parts.where("n > 1")
        if open_parts.isEmpty():
            return done
        half = [F.max(F.when(F.col("pos") % 2 == odd, F.col("name"))).alias(side) for odd, side in ((0, "a"), (1, "b"))]
        groups = ["doc_id", "text_sha256", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.shiftright("pos", 1).alias("pos")]
        pairs = open_parts.groupBy(*groups).agg(*half)
        #: an odd one out is paired with nothing; NULL is written as the least number, which is no name
        pairs = stored(pairs.fillna({"b": -(1 << 63)}), "pairs")
        names = named(pairs.select("a", "b"), "pair-names")
        parts = stored(pairs.join(names, ["a", "b"]).select("doc_id", "text_sha256", "n", "pos", "name"), "block-sequence")


def exact_duplicates(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of `documents`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without blanks (NULL counts as empty). Of equal texts the
    row with the most code points in its text stays, then the smallest doc_id; a NULL doc_id comes
    last. Rows that repeat both doc_id and text count in group_size, and are kept or dropped alike.
    Other columns are not looked at. An empty table gives an empty result.
    """
    rows = stored(text_identities(documents, block_bytes, hash_bits), "identities")
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("id"))).alias("best")
    groups = rows.groupBy("n_bytes", "name").agg(best, F.count(F.lit(1)).alias("group_size"))
    keep = groups.select("n_bytes", "name", F.bitwise_not(F.col("best.id")).alias("keep_id"), "group_size")
    return rows.join(keep, ["n_bytes", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
