import base64
import hashlib
import random

import pytest
import zstandard

from sensorloom.llm import warc

SCHEMA = "page_id long, url string, html string, extra int, sha1 int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*row, 0, 1, "x") for row in rows], SCHEMA)


def expected(rows, least_bytes=0):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    made = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        leader = first.get(html or "")
        again = len(payload) >= least_bytes and page_id != leader
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        made.append((page_id, len(payload), digest, "revisit" if again else "response", leader if again else None))
    return sorted(made, key=str)


def read(frame):
    return sorted((tuple(r) for r in frame.drop("url", "payload").collect()), key=str)


def some_pages():
    rng = random.Random(3)
    bodies = ["", None, "é" * 50, "<html>\r\n\r\n</html>", "WARC/1.1\r\n", "x" * 700_000] + [f"<p>{i}</p>" * i for i in range(40)]
    return [(i * 3, f"http://a/{i}", rng.choice(bodies)) for i in range(200)]


@pytest.mark.parametrize("least_bytes", [0, 30])
def test_archives_read_back(spark, tmp_path, least_bytes):
    rows = some_pages()
    frame = warc.archive(spark, pages(spark, rows), f"{tmp_path}/a", least_bytes)
    assert read(frame) == expected(rows, least_bytes)


def test_one_record_by_its_id(spark, tmp_path):
    rows = some_pages()
    index = warc.write(pages(spark, rows), f"{tmp_path}/a")
    record = index.where("page_id = 9")
    (found,) = warc.read(record, f"{tmp_path}/a", with_payload=True).collect()
    assert found.page_id == 9 and found.url == "http://a/3"
    if found.record_type == "response":
        assert bytes(found.payload) == (rows[3][2] or "").encode()


def test_bundles_are_plain_zstandard_with_a_seek_table(monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3_000)
    writer, records = warc.BundleWriter(str(tmp_path)), []
    rng = random.Random(1)
    for i in range(120):
        records.append(warc.render(i, "u", rng.randbytes(rng.randint(0, 300)), "D", None, False))
        writer.add(i, records[-1])
    writer.close()
    places = writer.taken()
    assert len({p[2] for p in places}) > 3
    for (_, _, name, frame, offset, length), record in zip(places, records):
        assert warc.BundleReader(str(tmp_path), name).frame(frame)[offset : offset + length] == record
    whole = b"".join(
        zstandard.ZstdDecompressor().stream_reader(open(tmp_path / name, "rb"), read_across_frames=True).read()
        for name in dict.fromkeys(p[2] for p in places)
    )
    assert whole == b"".join(records)


def test_a_changed_payload_is_noticed(spark, tmp_path):
    record = warc.render(1, "u", b"abc", "A" * 32, None, False)
    with pytest.raises(ValueError, match="digest"):
        warc._record(*warc.parse(record))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "a\r\nb: c", ""), (None, "u", "body"), (5, "u", "body"), (5, "u", "body"), (5, "u", "other"), (None, None, None), (None, "u", "only here")]
    frame = warc.archive(spark, pages(spark, rows), f"{tmp_path}/odd")
    assert read(frame) == expected(rows)
    assert warc.archive(spark, pages(spark, []), f"{tmp_path}/none").count() == 0
