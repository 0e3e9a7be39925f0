import random
import zlib

import numpy as np

from sensorloom.llm import langid

from .conftest import by_id

SYLLABLES = {"aa": ["ba", "no", "ti", "ka", "ru"], "bb": ["sch", "ung", "ein", "ver", "ß"], "cc": ["éau", "ou", "tion", "ê", "le"]}


def sentence(lang, seed, count=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(count))


def mixed(spark, count=300):
    langs = list(SYLLABLES)
    rows = [(i, sentence(langs[i % 3], i), langs[i % 3]) for i in range(count)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_and_calibration(spark):
    docs = mixed(spark)
    rows = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in rows.items())
    assert np.mean([rows[i].lang_pred == truth[i] for i in rows if held_out(i)]) > 0.97


def test_learns_from_its_fold_only(spark):
    docs = mixed(spark, 90)
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'zz', lang) lang")
    columns = ("lang_pred", "score")
    assert by_id(langid.predict(docs, langid.fit(docs)), *columns) == by_id(langid.predict(docs, langid.fit(other)), *columns)


def test_what_is_foreign_is_rejected(spark):
    docs = mixed(spark)
    model = langid.fit(docs)
    foreign = spark.createDataFrame([(1, "жщ ъы юя " * 20), (2, sentence("aa", 7))], "doc_id long, text string")
    assert by_id(langid.predict(foreign, model, reject=True), "lang_pred")[1] == (2, "aa")
    model.least_score = 2.0
    assert {r.lang_pred for r in langid.predict(foreign, model, reject=True).collect()} == {"und"}


def test_the_table_equals_embedding_then_softmax(spark):
    data = np.frombuffer("some text\nof Two rows".encode(), np.uint8)
    offsets = np.array([0, 9, 21])
    table = np.random.default_rng(0).normal(size=(langid.BUCKETS, 3))
    logits = langid.Model(["a", "b", "c"], table, np.zeros(3)).logits(data, offsets)
    for row in range(2):
        own = np.concatenate([b[r == row] for b, r in langid.subwords(data, offsets)])
        assert np.allclose(logits[row], table[own].mean(0))


def test_odd_rows(corpus, spark):
    model = langid.fit(mixed(spark))
    rows = langid.predict(corpus.odd(), model).collect()
    assert len(rows) == corpus.odd().count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in SYLLABLES for r in rows if r.doc_id in (4, 5, 6, 7, 8, None))
    assert langid.fit(corpus.none()) is None
    assert {r.lang_pred for r in langid.predict(corpus.odd(), None).collect()} == {"und"}
    assert langid.fit(corpus.odd()) is not None
    assert langid.predict(corpus.none(), model).count() == 0
