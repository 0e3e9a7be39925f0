import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sensorloom.llm import decontaminate

from .conftest import by_id, words

ITEM_SCHEMA = "item_id long, text string, source string"


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def distance(item, text):
    """Least edits of the item to any run of the text's words."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        after = [i]
        for j, other in enumerate(text, 1):
            after.append(min(row[j - 1] + (word != other), row[j] + 1, after[-1] + 1))
        row = after
    return min(row)


def whole_distance(item, text):
    row = list(range(len(text) + 1))
    for i, word in enumerate(item, 1):
        after = [i]
        for j, other in enumerate(text, 1):
            after.append(min(row[j - 1] + (word != other), row[j] + 1, after[-1] + 1))
        row = after
    return row[-1]


def planted(seed, count=150):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng.choice([2, 4, 6, 14, 25, 50]), 500 + i, 2_000)).capitalize() + ".") for i in range(30)]
    texts = []
    for i in range(count):
        own = words(rng.randint(0, 60), i, 2_000)
        if rng.random() < 0.7:
            inner = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, max(1, len(inner) // 4))):
                at = rng.randrange(len(inner))
                change = rng.random()
                if change < 0.4:
                    inner[at] = "changed"
                elif change < 0.7 and len(inner) > 1:
                    del inner[at]
                else:
                    inner.insert(at, "added")
            at = rng.randint(0, len(own))
            own[at:at] = inner
        texts.append(" ".join(own))
    return items, texts


def brute(items, texts):
    found = {}
    for i, text in enumerate(texts):
        for item_id, item in items:
            own = tokens(item)
            edits = distance(own, tokens(text))
            if own and edits <= decontaminate.most_edits(len(own)):
                found[i, item_id] = edits
    return found


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 1_500])
def test_exact_pairs_at_the_target_recall(corpus, spark, chunk_bytes):
    items, texts = planted(3)
    benchmark = spark.createDataFrame([(*item, "s") for item in items], ITEM_SCHEMA)
    found = decontaminate.contaminated(corpus.documents(texts), benchmark, chunk_bytes).collect()
    truth = brute(items, texts)
    pairs = {(r.doc_id, r.item_id): r.edits for r in found}
    assert len(pairs) == len(found)
    # the seed is fixed: on these texts no pair is missed and every edit count is the least
    assert pairs == truth
    for row in found:
        own, text = tokens(items[row.item_id][1]), tokens(texts[row.doc_id])
        ends = range(row.first_word, min(len(text), row.first_word + row.item_words + row.edits) + 1)
        assert min(whole_distance(own, text[row.first_word : end]) for end in ends) == row.edits


def test_best_distance_equals_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(30):
        item = rng.integers(0, 5, rng.integers(1, 9)).astype(np.uint64)
        spans = rng.integers(0, 5, (6, 12)).astype(np.uint64)
        ends = decontaminate.best_distance(item, spans)
        assert list(ends.min(1)) == [distance(list(item), list(span)) for span in spans]
        ends = decontaminate.best_distance(item, spans, anchored=True)
        assert list(ends[:, -1]) == [whole_distance(list(item), list(span)) for span in spans]


def test_some_block_and_some_run_of_it_survive_any_edits():
    for size in range(1, 400):
        blocks = decontaminate.blocks_of(size)
        assert [first for first, _, _ in blocks] == [sum(n for _, n, _ in blocks[:i]) for i in range(len(blocks))]
        assert sum(n for _, n, _ in blocks) == size and max(n for _, n, _ in blocks) <= decontaminate.BLOCK_WORDS
        # more edits than its share in every block are more than the item may have
        assert sum(edits + 1 for _, _, edits in blocks) > decontaminate.most_edits(size)
        for _, length, edits in blocks:
            assert (edits + 1) * (decontaminate.run_width(length, edits) - 1) < length - edits


def test_a_walk_writes_each_word_at_least_once():
    rng = np.random.default_rng(2)
    sequence = rng.integers(1, 1 << 60, 40).astype(np.uint64)
    written = decontaminate.walk(sequence, np.array([3, 30]), np.array([20, 40]), 300, 1)
    for column, stretch in zip(written.T, (sequence[3:20], sequence[30:40])):
        kept = column[column != 0]
        assert kept[np.concatenate([[True], kept[1:] != kept[:-1]])].tolist() == stretch.tolist()


def test_edits_within_the_limit_leave_samples_that_agree():
    """Recall of the samples alone: windows of 25 words with five random edits."""
    rng = random.Random(5)
    caught = 0
    for i in range(200):
        item = [f"w{rng.randrange(9_000)}" for _ in range(25)]
        text = list(item)
        for _ in range(5):
            at = rng.randrange(len(text))
            change = rng.randrange(3)
            text[at : at + (change < 2)] = [] if change == 1 else ["changed"]
        items = decontaminate.Items([(1, " ".join(item))])
        ((_, hashes, found),) = decontaminate._text_words(pa.array([" ".join(text)]))
        caught += bool(items.matches(hashes, found))
    assert caught >= 0.95 * 200


def test_a_text_of_one_repeated_run_against_many_like_items():
    rng = random.Random(6)
    items = [(i, "which of the following is " + " ".join(f"w{rng.randrange(50_000)}" for _ in range(20))) for i in range(500)]
    texts = ["which of the following is " * 4_000, items[7][1] + " " + "which of the following is " * 300]
    ((_, hashes, found),) = decontaminate._text_words(pa.array(texts))
    assert decontaminate.Items(items).matches(hashes, found) == [(1, 7, 0, 0)]


def test_the_first_word_of_a_match_with_inserted_words(corpus, spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(20)]
    texts = []
    for _, item in items:
        inner = item.split()
        inner[40:40] = ["new"] * 6
        texts.append("a b c d e " + " ".join(inner) + " z z z")
    benchmark = spark.createDataFrame([(*item, "s") for item in items], ITEM_SCHEMA)
    found = decontaminate.contaminated(corpus.documents(texts), benchmark)
    assert by_id(found, "item_id", "edits", "first_word") == sorted(((i, i, 6, 5) for i in range(20)), key=str)


def test_contaminated_documents_go(corpus, spark):
    items, texts = planted(8, 80)
    benchmark = spark.createDataFrame([(*item, "s") for item in items], ITEM_SCHEMA)
    docs = corpus.documents(texts)
    bad = {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()}
    for chunk_bytes in (1 << 24, 1_500):
        kept = decontaminate.keep_clean(docs, benchmark, chunk_bytes)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == set(range(80)) - bad


def test_odd_rows(corpus, spark):
    benchmark = spark.createDataFrame(
        [(1, None, None), (2, "", None), (3, "...", None), (None, "one id with another", None), (4, "same words in the same row", None)], ITEM_SCHEMA
    )
    found = decontaminate.contaminated(corpus.odd(), benchmark)
    assert by_id(found, "item_id", "edits") == sorted([(6, 4, 0), (6, 4, 0), (7, None, 0)], key=str)
    assert decontaminate.contaminated(corpus.none(), benchmark).count() == 0
    nothing = spark.createDataFrame([], ITEM_SCHEMA)
    assert decontaminate.contaminated(corpus.odd(), nothing).count() == 0
    assert decontaminate.keep_clean(corpus.odd(), nothing).count() == corpus.odd().count()


@pytest.mark.parametrize("size", [25, 100, 400, 1_000])
def test_items_at_the_edit_limit_are_found_at_any_length(corpus, spark, size):
    rng = random.Random(size)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(size))) for i in range(12)]
    texts = []
    for _, item in items:
        inner = item.split()
        for _ in range(decontaminate.most_edits(size)):
            at = rng.randrange(len(inner))
            change = rng.randrange(3)
            inner[at : at + (change < 2)] = [] if change == 1 else ["changed"]
        texts.append(" ".join(["before"] * rng.randint(0, 40) + inner + ["after"] * rng.randint(0, 40)))
    benchmark = spark.createDataFrame([(*item, "s") for item in items], ITEM_SCHEMA)
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(corpus.documents(texts), benchmark).collect()}
    assert set(found) == {(i, i) for i in range(12)}
    for i in range(2):
        assert found[i, i] == distance(tokens(items[i][1]), tokens(texts[i]))
