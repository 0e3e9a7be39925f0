import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import suffix_dedup

from .conftest import by_id, words

LENGTH = 60
COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def covered(texts, length):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    masks = []
    for b in raw:
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                mask[p : p + length] = True
        masks.append(mask)
    return raw, masks


def brute(rows, length):
    raw, masks = covered([t for _, t in rows], length)
    expected = []
    for (doc_id, _), b, mask in zip(rows, raw, masks):
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        expected.append((doc_id, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(expected, key=str)


def passages(seed, count=60):
    """Texts that share passages of lengths around the limit, within and across documents, and copies."""
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abcé ", k=rng.randint(LENGTH // 2, 3 * LENGTH))) for _ in range(8)]
    made = []
    for i in range(count):
        parts = []
        for _ in range(rng.randint(0, 5)):
            piece = rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choices("abcdéfgh ", k=rng.randint(1, 150)))
            if rng.random() < 0.3:
                piece = piece[rng.randint(0, 20) : len(piece) - rng.randint(0, 20)]
            parts.append(piece)
        made.append("".join(parts))
    made += rng.choices(made, k=count // 6) + ["ab" * 200, "a" * 500, "a" * LENGTH, "a" * (LENGTH - 1)]
    return list(enumerate(made))


@pytest.mark.parametrize("group_rows", [2_000, 2])
@pytest.mark.parametrize("piece_rows", [20_000, 3])
def test_equals_brute_force(corpus, monkeypatch, group_rows, piece_rows):
    monkeypatch.setattr(suffix_dedup, "PIECE_ROWS", piece_rows)
    rows = passages(group_rows + piece_rows)
    frame = suffix_dedup.removals(corpus.documents(rows), LENGTH, group_rows)
    assert by_id(frame, *COLUMNS) == brute(rows, LENGTH)


def test_sorted_suffixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (500, 21)).astype(np.uint8)
    rows[100:200] = rows[:100]
    rows[200:300, :17] = rows[:100, :17]
    order, common = suffix_dedup.multikey_order(rows)
    ordered = [bytes(r) for r in rows[order]]
    assert ordered == sorted(bytes(r) for r in rows)
    for a, b, shared in zip(ordered, ordered[1:], common[1:]):
        assert shared == next((i for i in range(21) if a[i] != b[i]), 21)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    inner = "".join(rng.choices("abcd", k=300)).encode()
    found = []
    for before, after in ((b"xy" * 40, b"qq" * 90), (b"", b""), (b"a" * 7, b"b")):
        data = np.frombuffer(before + inner + after, np.uint8)
        row, first, count, ahead, anchor, _ = suffix_dedup.territories(data, np.array([0, len(data)]), 200)
        anchors = {p: f + a for f, c, a in zip(first, count, ahead) for p in range(f, f + c)}
        assert sorted(anchors) == list(range(len(data) - 199))
        found.append([anchors[len(before) + p] - len(before) for p in range(101)])
    assert found[0] == found[1] == found[2]


def test_odd_rows(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.odd().collect()]
    assert by_id(suffix_dedup.removals(corpus.odd()), *COLUMNS) == brute(rows, 200)
    assert suffix_dedup.removals(corpus.none()).count() == 0


def test_texts_keep_whole_characters(corpus):
    shared = "é" * 40  # 80 bytes; the windows cover bytes, the texts lose characters
    docs = corpus.documents(["a" + shared + "bé", "c" + shared + "d", None, ""])
    cleaned = suffix_dedup.remove(docs, LENGTH)
    assert cleaned.columns == docs.columns
    assert by_id(cleaned, "text", "n_chars") == [(0, "abé", 3), (1, "cd", 2), (2, None, None), (3, "", 0)]
    odd = suffix_dedup.remove(corpus.odd())
    assert odd.columns == corpus.odd().columns and odd.count() == corpus.odd().count()
    assert suffix_dedup.remove(corpus.none()).count() == 0


def test_a_shared_passage_goes_and_the_rest_stays(corpus):
    passage = " ".join(words(60, 5))
    texts = [" ".join(words(40, 10 + i, 3000)) + "\n" + passage + "\n" + " ".join(words(30, 50 + i, 3000)) for i in range(5)]
    cleaned = {r.doc_id: r.text for r in suffix_dedup.remove(corpus.documents(texts)).collect()}
    for i, text in enumerate(texts):
        assert passage not in cleaned[i]
        assert cleaned[i].startswith(" ".join(words(40, 10 + i, 3000))[:-5])
