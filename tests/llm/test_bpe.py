import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorloom.llm import bpe

from .conftest import by_id, words

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeréln' \n\t\r0!.-=  ́はい😀"), max_size=60))
def test_equals_the_library_on_any_text(library, text):
    codec = bpe.codec(PATH, PATTERN)
    (ids,) = codec.encode([text])
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_periodic_pieces_merge_leftmost_first(library):
    codec = bpe.codec(PATH, PATTERN)
    texts = [unit * n + tail for unit in ("a", "er", "ana", "-", "!", " ", "=-", "ere") for n in range(1, 40) for tail in ("", "x", " e")]
    assert codec.encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_a_very_long_piece(library):
    text = "ere" * 20_000
    assert bpe.codec(PATH, PATTERN).encode([text])[0] == library.encode_ordinary(text)


def test_offsets_cover_the_text():
    codec = bpe.codec(PATH, PATTERN)
    text = "naïve 😀 はい ok"
    ids = codec.encode([text])[0]
    ranges = codec.offsets(text, ids)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
    for token, (low, high) in zip(ids, ranges):
        assert codec.token_bytes[token] in text[low:high].encode()


def test_query_form(corpus, library):
    texts = [" ".join(words(300, seed)) for seed in range(20)]
    frame = bpe.encode_checked(corpus.documents(texts), PATH, PATTERN)
    expected = [
        (i, len(ids), digest(ids), hashlib.sha256(t.encode()).hexdigest(), ids)
        for i, t in enumerate(texts)
        for ids in [library.encode_ordinary(t)]
    ]
    assert by_id(frame, "n_tokens", "ids_sha256", "decoded_sha256", "ids") == sorted(expected, key=str)


def test_odd_rows(corpus, library):
    rows = corpus.odd().collect()
    expected = [(r.doc_id, len(library.encode_ordinary(r.text or ""))) for r in rows]
    assert by_id(bpe.encode_checked(corpus.odd(), PATH, PATTERN), "n_tokens") == sorted(expected, key=str)
    assert bpe.encode_checked(corpus.none(), PATH, PATTERN).count() == 0


def test_encode_and_decode_frames(corpus):
    coded = bpe.encode(corpus.odd(), PATH, PATTERN, with_offsets=True)
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in coded.collect())
    back = sorted((r.text for r in bpe.decode(coded, PATH, PATTERN).collect()))
    assert back == sorted(r.text or "" for r in corpus.odd().collect())


def test_ids_that_split_a_character_decode_to_bytes(spark):
    codec = bpe.codec(PATH, PATTERN)
    half = [codec.ranks[bytes([b])] for b in "é".encode()][:1]
    frame = spark.createDataFrame([(1, half), (2, None)], "doc_id long, ids array<int>")
    rows = {r.doc_id: (bytes(r.data), r.text) for r in bpe.decode(frame, PATH, PATTERN).collect()}
    assert rows == {1: ("é".encode()[:1], None), 2: (b"", "")}


def test_a_codec_holds_few_known_words_and_no_merges():
    codec = bpe.Codec(PATH, PATTERN)
    for low in range(0, 120_000, 2_000):
        codec.encode_bytes(["a " + " ".join(f"w{i}" for i in range(low, low + 2_000))])
    assert (len(codec._young) + len(codec._old)) * bpe.ENTRY_BYTES < 18 << 20
    assert "_cuts" not in vars(codec)
