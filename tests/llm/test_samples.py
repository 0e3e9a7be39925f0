"""What the classifiers fit on is bounded in rows, also where one id has very many."""

from pyspark.sql import functions as F

from sensorloom.llm import frames, langid, quality_lines, toxicity
from tests.llm.conftest import words

ROWS = 100_000


def crowded(corpus, spark):
    """Forty documents, and one id of the learning fold on very many rows, each with its own text."""
    ids = [r.id for r in spark.range(200).where(frames.learning_fold(F.col("id"))).collect()][:41]
    docs = corpus.documents([(i, " ".join(words(60, seed=i)) + "\n") for i in ids[1:]], "en")
    hot = spark.range(ROWS).select(
        F.lit(ids[0]).cast("long").alias("doc_id"), F.concat(F.lit("words again "), F.col("id")).alias("text"),
        F.lit("en").alias("lang"), F.lit("here").alias("source"), F.lit(12).cast("long").alias("n_chars"),
    )
    labels = spark.createDataFrame([(i, n % 2, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    return docs.unionByName(hot), labels


def test_one_row_for_each_id(corpus, spark, monkeypatch):
    docs, labels = crowded(corpus, spark)
    seen = {}
    monkeypatch.setattr(langid, "train", lambda samples, languages: seen.update(languages=len(samples)))
    monkeypatch.setattr(quality_lines, "train", lambda features, owners, states: seen.update(lines=owners.max() + 1))
    monkeypatch.setattr(toxicity, "train", lambda toxic, others, prior: seen.update(toxic=len(toxic), others=len(others)))
    langid.fit(docs)
    quality_lines.fit(docs, labels)
    toxicity.fit(docs, labels)
    assert seen == {"languages": 41, "lines": 41, "toxic": 20, "others": 41}


def test_limits_count_ids(spark):
    ids = spark.range(5_000).selectExpr("id as doc_id").unionByName(spark.range(ROWS).selectExpr("7L as doc_id"))
    ordered = [r.doc_id for r in spark.range(5_000).selectExpr("id as doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    for count in (10, 1_000, 4_999, 6_000):
        assert {r.doc_id for r in frames.smallest_hashes(ids, count).collect()} == set(ordered[:count])
    assert frames.smallest_hashes(ids.limit(0), 3).count() == 0
