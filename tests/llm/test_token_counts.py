import public_tokenizers

from sensorloom.llm import bpe, token_counts

from .conftest import words

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def sums_of(frame, monkeypatch):
    monkeypatch.setattr(token_counts, "LENGTHS_PER_BLOCK", 16)
    return token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(frame, PATH, PATTERN)))


def lengths_of(texts):
    return [len(ids) for ids in bpe.codec(PATH, PATTERN).encode([t or "" for t in texts])]


def test_equals_brute_force(corpus, monkeypatch):
    texts = [" ".join(words(n % 37, n)) for n in range(80)] + [None, "", "a"]
    sizes = lengths_of(texts)
    rows = {r.n_tokens: r for r in sums_of(corpus.documents(texts), monkeypatch).collect()}
    assert set(rows) == set(sizes)
    for size, row in rows.items():
        assert row.n_docs == sizes.count(size)
        assert row.docs_at_least == sum(s >= size for s in sizes)
        assert row.tokens_at_least == sum(s for s in sizes if s >= size)
        assert (row.total_docs, row.total_tokens) == (len(sizes), sum(sizes))
        assert row.truncated_tokens == sum(min(s, size) for s in sizes)
        assert abs(row.docs_share - sum(s <= size for s in sizes) / len(sizes)) < 1e-12


def test_limits_and_quantiles(corpus, monkeypatch):
    texts = [" ".join(words(n, n)) for n in range(60)]
    sizes = sorted(lengths_of(texts))
    sums = sums_of(corpus.documents(texts), monkeypatch)
    limits = [0, 1, 7, 50, 10_000]
    found = {r.context_limit: tuple(r)[1:] for r in token_counts.at_limits(sums, limits).collect()}
    for limit in limits:
        kept = sum(min(s, limit) for s in sizes)
        assert found[limit] == (sum(s > limit for s in sizes), kept, sum(sizes) - kept)
    row = token_counts.quantiles(sums, [0.25, 0.5, 1.0]).first()
    assert tuple(row) == (sizes[14], sizes[29], sizes[59])


def test_odd_rows(corpus, monkeypatch):
    sizes = lengths_of([r.text for r in corpus.odd().collect()])
    assert sum(r.n_docs for r in sums_of(corpus.odd(), monkeypatch).collect()) == len(sizes)
    empty = sums_of(corpus.none(), monkeypatch)
    assert empty.count() == 0
    assert token_counts.at_limits(empty, [5]).count() == 0
    assert tuple(token_counts.quantiles(empty, [0.5]).first()) == (None,)
