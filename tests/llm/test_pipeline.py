"""The pipeline's stages, one after the other, against what each must do."""

import re
from collections import defaultdict

import corpus_pipeline
from conftest import FOLDER
from corpus import AWKWARD, documents
from test_duplicates import hot_group, near_by_hand
from test_tokens import check_packing

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    given = pairs(docs)
    calm = STAGES["toxicity"](spark, docs, FOLDER)
    assert calm.columns == COLUMNS
    left = {i for i, _ in pairs(calm)}
    clean = [i for i, _ in given if i in labels and labels[i]["toxic"] == 0]
    assert sum(i in left for i in clean) >= 0.98 * len(clean)

    good = STAGES["quality"](spark, calm, FOLDER)
    assert good.columns == COLUMNS
    kept = pairs(good)
    sound = [i for i, _ in pairs(calm) if i in labels and labels[i]["quality"] == 1]
    assert sum(i in dict(kept) for i in sound) >= 0.98 * len(sound)

    groups = defaultdict(list)
    for i, text in kept:
        groups[re.sub("[\x20\x09-\x0d]", "", text)].append((-len(text), i))
    unique = STAGES["exact dedup"](spark, good, FOLDER)
    assert unique.columns == COLUMNS
    assert sorted(i for i, _ in pairs(unique)) == sorted(min(g)[1] for g in groups.values())

    single = STAGES["near dedup"](spark, unique, FOLDER)
    assert single.columns == COLUMNS
    assert sorted(i for i, _ in pairs(single)) == sorted(r[0] for r in near_by_hand(pairs(unique), 5, 80) if r[3])

    check_packing(pairs(single), STAGES["packing"](spark, single, FOLDER).collect())


def test_near_dedup_of_a_hot_template(table):
    """Near copies that meet only in buckets of hundreds of texts of one template."""
    rows = hot_group(500, 50)
    single = STAGES["near dedup"](None, documents(table, rows), FOLDER)
    assert sorted(i for i, _ in pairs(single)) == sorted(r[0] for r in near_by_hand(rows, 5, 80) if r[3])


def test_run_goes_through_all_stages(spark):
    found = corpus_pipeline.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    check_packing(pairs(docs), found)


def test_stages_stand_awkward_rows(spark, table):
    for rows in (AWKWARD, []):
        docs = documents(table, rows)
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, FOLDER)
            assert result.count() <= 10 * len(rows)
            if name != "packing":
                assert result.columns == docs.columns
