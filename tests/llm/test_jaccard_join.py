import random
import re
import tracemalloc

import numpy as np
import pytest

from sensorloom.llm import jaccard_join

from .conftest import by_id, words


def members(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def brute(rows, width, percent):
    """(doc_id, set size, component) of each row by comparing all pairs."""
    sets = [members(text, width) for _, text in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if sets[i] and sets[k] and 100 * both >= percent * len(sets[i] | sets[k]):
                old, new = label[i], label[k]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label):
        if doc_id is not None:
            least[x] = min(doc_id, least.get(x, doc_id))
    return sorted(((doc_id, len(s), least.get(x)) for (doc_id, _), s, x in zip(rows, sets, label)), key=str)


def copies(count, seed):
    """Groups of near copies around the threshold, exact copies, and a line many texts share."""
    rng = random.Random(seed)
    made, common = [], " ".join(words(15, 99))
    while len(made) < count:
        base = words(rng.choice([3, 6, 20, 60, 200]), rng.randint(0, 10**6))
        for _ in range(rng.choice([1, 1, 2, 8])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(["new", "Words", "here"])
            text = " ".join(own)
            made += [text, text.upper()] if rng.random() < 0.1 else [text + " " + common] if rng.random() < 0.4 else [text]
    return list(enumerate(made[:count]))


@pytest.mark.parametrize("cell_nodes", [1_000, 2])
def test_equals_comparing_all_pairs(corpus, monkeypatch, cell_nodes):
    monkeypatch.setattr(jaccard_join, "ORDER_TIMES", 3)
    rows = copies(150, 5)
    frame = jaccard_join.connect(corpus.documents(rows), 4, 85, cell_nodes)
    assert by_id(frame, "n_shingles", "component_id") == brute(rows, 4, 85)


def test_a_chain_is_one_component(corpus):
    base = words(100, 3, 5000)
    rows = []
    for i in range(12):
        rows.append((20 - i, " ".join(base[i * 4 :] + words(i * 4, 1000, 5000))))
    frame = jaccard_join.connect(corpus.documents(rows), 4, 85, 3)
    assert by_id(frame, "n_shingles", "component_id") == brute(rows, 4, 85)


def test_the_tree_loses_nothing():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    members = [np.unique(rng.choice(pool[: rng.integers(50, 3000)], rng.integers(1, 120))) for _ in range(700)]
    members = sorted(members, key=len)
    sizes = np.array([len(m) for m in members])
    points = jaccard_join._points(members)
    tree = jaccard_join.CountTree(points, sizes)
    for i in (5, 300, 699):
        low = int(np.searchsorted(sizes[:i], sizes[i] // 2))
        needed = np.full(i - low, sizes[i] // 3)
        close = [k for k in range(low, i) if len(np.intersect1d(members[i], members[k])) >= sizes[i] // 3]
        assert set(close) <= set(tree.search(points[i], low, i, needed))


def test_odd_rows(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.odd().collect()]
    frame = jaccard_join.connect(corpus.odd())
    assert by_id(frame, "n_shingles", "component_id") == [
        (d, n, d if not n else c) for d, n, c in brute(rows, 4, 85)
    ]
    assert jaccard_join.connect(corpus.none()).count() == 0


def test_one_of_each_group_stays(corpus):
    text = " ".join(words(80, 1))
    docs = corpus.documents([(9, text), (4, text), (5, text + " more"), (4, text), (1, ""), (2, ""), (None, text), (7, "alone")])
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    assert by_id(kept) == sorted([(4,), (1,), (2,), (None,), (7,)], key=str)
    odd = jaccard_join.keep_one(corpus.odd(), 5, 80)
    assert odd.columns == corpus.odd().columns
    assert by_id(odd) == sorted([(1,), (2,), (3,), (None,), (4,), (5,), (6,), (7,), (7,), (8,)], key=str)
    assert jaccard_join.keep_one(corpus.none()).count() == 0


def test_points_of_many_short_rows_take_little_memory():
    count = 8_000
    sizes = np.arange(count) % 3  # rows without members too
    rows = np.repeat(np.arange(count), sizes)
    members = np.random.default_rng(1).integers(0, 1 << 62, len(rows)).astype(np.uint64)
    cuts = np.searchsorted(rows, np.arange(count + 1))
    tracemalloc.start()
    try:
        packed = jaccard_join._packed_points(members, rows, cuts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20  # all at once: 98 MB
    unpack = jaccard_join.zstandard.ZstdDecompressor()
    points = np.stack([jaccard_join._point_of(unpack.decompress(raw)) for raw in packed])
    assert np.array_equal(points, jaccard_join._counts(members, rows, count))


def chance_texts(count, seed):
    """Texts of words that are frequent and rare as in prose, which share n-grams by chance only; some with a near copy."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, 3_001)
    texts = []
    for size in rng.integers(40, 400, count):
        own = [f"w{i}" for i in rng.choice(3_000, size, p=share / share.sum())]
        texts.append(" ".join(own))
        if rng.random() < 0.05:
            own[rng.integers(size)] = "new"
            texts.append(" ".join(own))
    return list(enumerate(texts))


def test_chance_n_grams_make_few_groups(corpus, monkeypatch):
    """Rows of groups, each of which moves a point, do not grow with what documents share by chance."""
    rows, seen = chance_texts(1_500, 4), {}
    plain = jaccard_join.frames.written

    def counted(frame, purpose):
        kept = plain(frame, purpose)
        seen.setdefault(purpose, kept.count())
        return kept

    monkeypatch.setattr(jaccard_join.frames, "written", counted)
    found = {r.doc_id: r.component_id for r in jaccard_join.connect(corpus.documents(rows), 3, 80).collect()}
    copies = sum("new" in text.split() for _, text in rows)
    assert seen["groups"] < 4 * copies
    # near copies follow their originals
    assert sorted(d for d, c in found.items() if c != d) == [d for d, text in rows if "new" in text.split()]


def test_blocks_lose_no_link(corpus, spark):
    rng = np.random.default_rng(2)
    for percent in (50, 80, 85, 100):
        pool = rng.integers(0, 1 << 63, 2_000).astype(np.uint64)
        bases = [rng.choice(pool, n, replace=False) for n in rng.integers(1, 600, 60)]
        sets = [np.unique(np.where(rng.random(len(b)) < rng.random() / 5, rng.choice(pool, len(b)), b)) for b in bases * 5]
        rows = []
        for node, own in enumerate(sets):
            place = np.arange(min(len(own), len(own) - (percent * len(own) + 99) // 100 + 1))
            keys = jaccard_join._keys(own[place], np.full(len(place), len(own)), len(own) - place)
            rows += [(node, len(own), keys.view(np.int64).tolist())] * (1 + (node % 7 == 0))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # runs go on over batches
        try:
            found = jaccard_join.groups(spark.createDataFrame(rows, "node long, n_shingles long, keys array<long>"), percent)
            leads = {}
            for row in found.collect():
                leads.setdefault(row.node, set()).add(row.lead)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        linked = 0
        for i in range(len(sets)):
            for k in range(i):
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                    linked += 1
                    assert leads.get(i, set()) & leads.get(k, set())
        assert linked


def test_codes_of_sizes_ascend():
    values = np.array([0, 1, 2, 254, 255, 256, 257, 511, 512, 513, 99_999, (1 << 31) - 1])
    codes = jaccard_join._coded(values)
    assert (np.diff(codes.astype(np.int64)) >= 0).all() and codes.max() < 1 << 12
    assert (jaccard_join._least_of(codes) <= values).all()
    assert (jaccard_join._least_of(codes + np.uint64(1)) > values).all()
    assert np.array_equal(jaccard_join._least_of(codes[:5]), values[:5])


def test_texts_of_single_documents_are_not_shuffled(corpus):
    rows = chance_texts(200, 7) + [(900 + i, " ".join(words(50, i % 3))) for i in range(9)]
    rows += [(900, rows[-9][1])] * 2  # the smallest id of a component three times
    kept = jaccard_join.keep_one(corpus.documents(rows), 3, 80)
    wanted = {c for _, _, c in brute(rows, 3, 80)}
    assert by_id(kept) == sorted(((c,) for c in wanted), key=str)
    plan = kept._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "Union" not in plan and "Aggregate [" not in plan.split("Join LeftOuter")[0]
    assert plan.count("Join") == 1  # with the bitmap, which is broadcast
