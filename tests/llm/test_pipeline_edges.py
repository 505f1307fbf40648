"""The pipeline's stages on toxic, repeated and clashing rows, and on nothing."""

import random

import pytest
from conftest import CLASHING, DOCUMENTS
from pyspark.sql import functions as F

import corpus_pipeline


def texts():
    """Ids, texts and labels: ordinary and toxic texts, of which some have no label, and rows that repeat."""
    rng = random.Random(9)
    plain, bad = [f"w{k}" for k in range(400)], [f"vile{k}" for k in range(12)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(30, 60))]
        if toxic:
            for _ in range(12):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels = texts()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[1][1])], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def test_stages_carry_all_columns(spark, folder):
    rows, _ = texts()
    rows = [*rows, rows[2], rows[2], (None, rows[3][1]), (1000, None), (1001, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS).select("*", *[F.lit("other").alias(c) for c in CLASHING])
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    kept = [r["doc_id"] for r in clean.collect()]
    ordinary = [i for i, _ in rows if i is None or i >= 400 or i % 4]
    # No ordinary text goes, repeated rows stay together, and toxic ones without a label are found too.
    assert sorted(map(str, (i for i in kept if i is None or i >= 400 or i % 4))) == sorted(map(str, ordinary))
    assert sum(i is not None and i < 400 and i % 4 == 0 for i in kept) <= 5
    for name, stage in corpus_pipeline.STAGES[1:]:
        after = stage(spark, clean, folder)
        assert after.columns[: len(docs.columns)] == docs.columns and (name == "sentencepiece" or len(after.columns) == len(docs.columns))
        assert {tuple(r) for r in after.select(*CLASHING).distinct().collect()} == {("other",) * len(CLASHING)}
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert len(ids) == len(kept) - (name == "decontamination"), name  # the leaked text goes


def test_stages_of_nothing(spark, folder):
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        assert after.columns[:5] == docs.columns and after.count() == 0
