import random
import zlib

import numpy as np

from sensorloom.llm import toxicity

from .conftest import by_id, words

BAD = ["vile", "nasty", "rotten", "foul"]


def in_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


def labelled(corpus, spark, count=1_500, share=0.15):
    rng = random.Random(6)
    texts, marks = [], []
    for i in range(count):
        own = words(rng.randint(5, 120), i, 300)
        toxic = rng.random() < share
        if toxic:
            for _ in range(rng.randint(1, 3)):
                own.insert(rng.randrange(len(own) + 1), rng.choice(BAD).capitalize() + rng.choice(["", ",", "!"]))
        texts.append(" ".join(own))
        marks.append((i, 1, int(toxic)))
    known = [m for m in marks if rng.random() < 0.5]
    return corpus.documents(texts), spark.createDataFrame(known, "doc_id long, quality int, toxic int"), marks


def test_held_out_accuracy(corpus, spark):
    docs, labels, marks = labelled(corpus, spark)
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.held_out == (not in_fold(i)) and 0 <= r.score <= 1 for i, r in rows.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [(toxic, rows[i].predicted) for i, _, toxic in marks if not in_fold(i)]
    assert np.mean([p for toxic, p in held if toxic]) > 0.9
    assert np.mean([p for toxic, p in held if not toxic]) < 0.02


def test_labels_outside_the_fold_change_nothing(corpus, spark):
    docs, labels, _ = labelled(corpus, spark, 400)
    flipped = labels.collect()
    flipped = [(r.doc_id, r.quality, r.toxic if in_fold(r.doc_id) else 1 - r.toxic) for r in flipped]
    other = spark.createDataFrame(flipped, labels.schema)
    assert by_id(toxicity.score(docs, toxicity.fit(docs, labels)), "score") == by_id(
        toxicity.score(docs, toxicity.fit(docs, other)), "score"
    )


def test_unlabelled_toxic_text_is_not_learnt_as_clean():
    rng = np.random.default_rng(5)
    noise = [np.unique(rng.integers(100, 400, 20)).astype(np.uint64) for _ in range(900)]
    marked = [np.append(np.uint64(1), n) for n in noise[:150]]
    hidden = [np.append(np.uint64(1), n) for n in noise[150:300]]
    model = toxicity.train(marked, hidden + noise[300:], 0.2)
    assert list(model.vocabulary) == [1]
    assert 1 / (1 + np.exp(-(model.bias + model.weights[0]))) > 0.5
    assert 1 / (1 + np.exp(-model.bias)) < 0.2


def test_odd_rows(corpus, spark):
    labels = spark.createDataFrame([(None, 1, 1), (6, None, None), (6, 1, 1), (1, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(corpus.odd(), toxicity.fit(corpus.odd(), labels)).collect()
    assert len(rows) == corpus.odd().count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("toxic = 0")
    assert toxicity.fit(corpus.odd(), none) is None
    assert {r.score for r in toxicity.score(corpus.odd(), None).collect()} == {0.0}
    assert toxicity.score(corpus.none(), toxicity.fit(corpus.none(), labels)).count() == 0


def test_rejected_documents_go(corpus, spark):
    docs, labels, _ = labelled(corpus, spark, 600)
    model = toxicity.fit(docs, labels)
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(600)) - rejected
    assert toxicity.keep_clean(corpus.odd(), model).columns == corpus.odd().columns
    assert toxicity.keep_clean(corpus.odd(), model).count() == corpus.odd().count()


def test_the_words_of_the_sample_stay_with_the_executors(corpus, spark, monkeypatch):
    """The driver trains on places in a vocabulary, and gets what training on all words gives."""
    docs, labels, _ = labelled(corpus, spark, 400)
    given = []
    plain = toxicity._descend
    monkeypatch.setattr(toxicity, "_descend", lambda *a: given.append(a) or plain(*a))
    monkeypatch.setattr(toxicity, "_telling_words", lambda *a: 1 / 0)
    model = toxicity.fit(docs, labels)
    (vocabulary, marked, others, _), = given
    assert len(vocabulary) and (np.diff(vocabulary.astype(float)) >= 0).all()
    assert all(len(row) <= len(vocabulary) for row in marked + others)
    assert list(model.vocabulary) == list(vocabulary)
