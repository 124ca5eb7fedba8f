"""The corpus operators as queries over their whole tables, and SQL for those that SQL can express.

The SQL of op2, op9, op11 and op12 reads the same tables by plain grouping and joins. The others are checked in tests/llm
against a brute-force version, the tokenizer's own library, an exact round trip or held-out labels.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.collocations import collocations
from pursebook.llm.exact import exact_duplicates
from pursebook.llm.katz import katz_scores
from pursebook.llm.lines import without_repeated_lines
from pursebook.llm.minhash import near_duplicates
from pursebook.llm.negatives import hard_negatives
from pursebook.llm.neighbours import near_vectors
from pursebook.llm.packing import packed_sequences
from pursebook.llm.pieces import encoded_pieces
from pursebook.llm.quality import quality
from pursebook.llm.token_counts import token_counts
from pursebook.llm.toxicity import toxicity
from pursebook.llm.urls import Rule, url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(_table(spark, sf_dir, "documents"), least_points=20, least_documents=3)


URL_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op3_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(_table(spark, sf_dir, "documents"), window=2048)


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_pieces(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=30, top=2000)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), is_anchor=F.col("vec_id") % 50 == 0)


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"), held_out=F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_near_vectors,
        op2_repeated_lines,
        op3_url_verdicts,
        op4_retrieval_packing,
        op5_toxic_segments,
        op6_weak_label_quality,
        op7_sentence_pieces,
        op8_token_counts,
        op9_exact_duplicates,
        op10_minhash_duplicates,
        op11_collocations,
        op12_hard_negatives,
        op13_katz_scores,
    )
}

ORACLE_SQL = {
    "op2_repeated_lines": r"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
        keyed AS (
            SELECT doc_id, line, pos,
                   translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), repeated AS (
            SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), judged AS (
            SELECT keyed.*, keep IS NOT NULL AND keep <> doc_id AS dropped FROM keyed LEFT JOIN repeated USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op9_exact_duplicates": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare,
                   length(coalesce(text, '')) AS points
            FROM documents
        ), ranked AS (
            SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY bare) AS group_size
            FROM texts
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), listed AS (
            SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces
        ), counted AS (
            SELECT lang, array_to_string(gram, ' ') AS phrase, len(gram) AS size, CAST(count(*) AS BIGINT) AS f
            FROM (SELECT lang, unnest([w[i:i + size - 1] FOR i IN range(1, len(w) - size + 2)]) AS gram
                  FROM listed, (VALUES (1), (2), (3), (4)) AS sizes(size) WHERE len(w) >= size)
            GROUP BY lang, gram
        ), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang),
        often AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 30),
        cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, CAST(c.f AS HUGEINT) * 2000000 // (l.f + r.f) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1) c
            JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
            JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), covered AS (
            SELECT lang, array_to_string(w[i:i + part - 1], ' ') AS phrase, max(f) AS longer
            FROM (SELECT *, unnest(range(1, size - part + 2)) AS i
                  FROM (SELECT *, unnest(range(2, size)) AS part FROM often WHERE size > 2) p) q
            GROUP BY 1, 2
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
               CAST(score AS BIGINT) AS score
        FROM lowest LEFT JOIN covered USING (lang, phrase) JOIN totals USING (lang)
        WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
    "op12_hard_negatives": r"""
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM whole a JOIN whole b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INT) AS rank, s.vec_id AS negative_id, positive_score,
               score AS negative_score
        FROM positives p JOIN scored s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
        QUALIFY row_number() OVER best <= 3
    """,
}
