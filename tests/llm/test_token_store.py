import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sensorloom.llm import token_store

from .conftest import words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def expected(rows, library):
    start, made = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library(text), 1]
        made.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return made


def stored(frame, folder):
    token_store.write(frame, PATH, folder)
    rows = token_store.digests(token_store.read(frame.sparkSession, folder)).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBéÉΣs'.,!—1²は\xa0\x1ćİ \n<|>")), max_size=40))
def test_equals_the_library_on_any_text(library, text):
    texts = [text, "", text + " end.", text]
    assert coded(token_store.encoder(PATH), texts) == [library(t) for t in texts]


def coded(tools, texts):
    raw = [text.encode() for text in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, ends = tools.encode(data, np.cumsum([0] + [len(text) for text in raw]))
    assert len(ids) == ends[-1]
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_words_pass_through_generations(library, monkeypatch):
    monkeypatch.setattr(token_store, "GENERATION_WORDS", 40)
    tools = token_store.WordEncoder(PATH)
    for k in range(12):
        texts = [" ".join(words(30, k // 2 + i, 90)) + ", then (some) more!?" for i in range(3)]
        assert coded(tools, texts) == [library(t) for t in texts]
        assert len(tools._young) <= 40
    tools.forget()
    assert not tools._young and not tools._old


def test_files_read_back(corpus, library, tmp_path):
    rows = [(i * 7 % 101, " ".join(words(50 + i, i)).capitalize() + ".") for i in range(101)]
    assert stored(corpus.documents(rows), f"{tmp_path}/ids") == expected(rows, library)


def test_odd_rows(corpus, library, tmp_path):
    rows = [(r.doc_id, r.text) for r in corpus.odd().collect()]
    assert stored(corpus.odd(), f"{tmp_path}/odd") == expected(rows, library)
    assert stored(corpus.none(), f"{tmp_path}/none") == []


def test_file_layout(corpus, tmp_path):
    token_store.write(corpus.documents([" ".join(words(400, i)) for i in range(300)]), PATH, f"{tmp_path}/ids")
    for path in glob.glob(f"{tmp_path}/ids/*.parquet"):
        group = pq.ParquetFile(path).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        ids = next(c for name, c in columns.items() if name.startswith("ids"))
        assert "RLE_DICTIONARY" in ids.encodings
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_reading_metadata_leaves_the_ids_alone(corpus, spark, tmp_path):
    token_store.write(corpus.documents(["a b c", "d"]), PATH, f"{tmp_path}/ids")
    plan = token_store.read(spark, f"{tmp_path}/ids").select("doc_id", "start")._jdf.queryExecution().toString()
    assert "ids:array" not in plan.split("== Physical Plan ==")[1]
