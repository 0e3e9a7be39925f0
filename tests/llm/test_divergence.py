import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sensorloom.llm import divergence

from .conftest import words

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least_docs, shown):
    """Rows of (text, lang, source)."""
    docs = [tuple(x or "" for x in row) for row in rows]
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = TERM.findall(text.translate(UPPER))
        groups[lang, source].update(found)
        seen[lang].update(set(found))
    result = []
    for lang in seen:
        kept = sorted(t for t, n in seen[lang].items() if n >= least_docs)
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(counts):
            total = sum(counts.values()) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (n + 2) // total for t, n in counts.items()}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, shown)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                result += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(result)


def rows_of(seed, count=160, sources=11):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = rng.choice(["en", "en", "en", "fr", None])
        source = rng.choice([None, "hot", "hot", *(f"s{k}" for k in range(sources))])
        text = " ".join(words(rng.randint(0, 40), i, 60)) + rng.choice([" Éa b1c", " THE the_End", ""])
        rows.append((text if rng.random() > 0.05 else None, lang, source))
    return rows + [("rare", "it", "only"), ("1 2", "it", "other"), (None, "it", None), ("rare rare", "alone", "s0")]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, *row, None) for i, row in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("least_docs, shown, terms, sources", [(3, 10, 16_384, 128), (2, 3, 7, 3), (1, 500, 20, 1)])
def test_equals_brute_force(spark, monkeypatch, least_docs, shown, terms, sources):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    rows = rows_of(6)
    found = divergence.audit(frame_of(spark, rows), least_docs, shown, sources)
    assert sorted(map(tuple, found.collect())) == brute(rows, least_docs, shown)


def test_equals_its_sql(spark):
    frame = frame_of(spark, rows_of(8, 300))
    with duckdb.connect() as con:
        con.register("documents", frame.toArrow())
        stated = sorted(con.sql(divergence.SQL).fetchall())
    assert sorted(map(tuple, divergence.audit(frame).collect())) == stated
    assert any(row[2] == "term" for row in stated)


def test_shares_stay_exact_for_huge_counts(spark):
    counts = [(n, total, v) for n in (0, 7, 10**12, 3 * 10**17) for total, v in ((10**18, 10**7), (n + 1, 3))]
    frame = spark.createDataFrame(counts, "n long, total long, v long")
    share = divergence._share(frame.n, frame.total, frame.v)
    found = [row.p for row in frame.select(share.alias("p")).collect()]
    assert found == [1 + 1_000_000_000 * (n + 2) // (total + 2 * v) for n, total, v in counts]


def test_counts_are_added_up_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 10)
    rows = rows_of(2)
    found = divergence.term_counts(frame_of(spark, rows))
    assert found.count() == found.select("lang", "source", "term").distinct().count()
    assert found.where("term IS NULL").agg({"n_docs": "sum"}).first()[0] == len(rows)
    assert sorted(map(tuple, divergence.audit(frame_of(spark, rows), 3).collect())) == brute(rows, 3, 10)


def test_no_pair_of_postings_is_emitted(spark):
    """One source holds most rows: what leaves the tiles is groups times groups, once a block of terms."""
    rows = [(" ".join(words(30, i, 50)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    model = divergence.Model(frame_of(spark, rows), 2)
    tiles = model._tiles(128)
    assert tiles.count() == 6
    assert model.pairs().count() == 6 * 5


def test_odd_rows(corpus):
    rows = [(r.text, r.lang, r.source) for r in corpus.odd().collect()]
    assert sorted(map(tuple, divergence.audit(corpus.odd(), 2).collect())) == brute(rows, 2, 10)
    assert divergence.audit(corpus.none()).count() == 0


def test_accumulated_sums_are_whole_numbers():
    side = divergence._Side.__new__(divergence._Side)
    side.names, side.absent = ["a", "b"], np.array([500_000_001, 900_000_001])
    side.sizes, side.first, side.ends = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    side.number, side.share, side.owner = np.array([0]), np.array([1_000_000_001]), np.array([0])
    sums = list(divergence._accumulated(side, side, 2))

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    assert sums[0].tolist() == [0, f(1_000_000_001, 900_000_001) + f(500_000_001, 900_000_001)]
