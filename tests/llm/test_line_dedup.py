import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from sensorloom.llm import line_dedup

from .conftest import by_id, words

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars=20, least_docs=3):
    """Rows of (doc_id, text); each row is a document."""
    keys = [[x.strip(SPACE).translate(UPPER) for x in (t or "").split("\n")] for _, t in rows]
    held = defaultdict(list)
    for (doc_id, _), own in zip(rows, keys):
        for key in set(own):
            held[key].append(doc_id)
    result = []
    for (doc_id, text), own in zip(rows, keys):
        lines = (text or "").split("\n")
        kept = []
        for key, line in zip(own, lines):
            known = [i for i in held[key] if i is not None]
            keeper = max(known) if known else None
            if len(key) < least_chars or len(held[key]) < least_docs or doc_id == keeper:
                kept.append(line)
        text = "\n".join(kept)
        result.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(result, key=str)


def shared_lines(seed, count=120):
    rng = random.Random(seed)
    common = [" ".join(words(rng.randint(1, 9), 900 + i)) for i in range(25)] + ["é" * 19, "é" * 20, "x" * 19 + "\x00"]
    rows = []
    for i in range(count):
        lines = [" ".join(words(rng.randint(0, 8), i * 50 + k)) for k in range(rng.randint(0, 5))]
        for line in rng.choices(common, k=rng.randint(0, 6)):
            line = rng.choice(["", " ", "\t\x0b"]) + rng.choice([line, line.upper() if line.isascii() else line]) + rng.choice(["", "\r", " \x0c"])
            lines.insert(rng.randint(0, len(lines)), line)
        rows.append((i * 7 % 1_000, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_equals_brute_force(corpus, batches):
    rows = shared_lines(3)
    found = line_dedup.digests(line_dedup.dedup(corpus.documents(rows), batches=batches))
    assert by_id(found, "n_lines", "n_dropped", "kept_sha256") == brute(rows)
    assert sum(row[2] for row in brute(rows)) > 100


def test_equals_its_sql(corpus):
    rows = shared_lines(5)
    frame = corpus.documents(rows)
    with duckdb.connect() as con:
        con.register("documents", frame.toArrow())
        stated = sorted(con.sql(line_dedup.SQL).fetchall(), key=str)
    assert by_id(line_dedup.digests(line_dedup.dedup(frame)), "n_lines", "n_dropped", "kept_sha256") == stated


def test_lines_in_a_third_of_all_documents(corpus, monkeypatch):
    """Both ways to meet the verdict give the same: looked up by broadcast, or merged."""
    rows = [(i, f"a line that very many documents share\nown line of document {i:06d}" if i % 3 else "short") for i in range(3_000)]
    for heavy in (1_000, 1):
        monkeypatch.setattr(line_dedup, "HEAVY_LINES", heavy)
        found = {r.doc_id: r for r in line_dedup.dedup(corpus.documents(rows)).collect()}
        assert len(found) == 3_000
        for i, text in rows:
            cut = i % 3 and i != 2_999
            assert found[i].n_dropped == bool(cut)
            assert found[i].text == (text.split("\n")[1] if cut else text)


def counts(spark, rows):
    return spark.createDataFrame(rows, "head long, tail long, n_docs long, keeper long")


def test_runs_are_compacted_and_settle_lines(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    sizes = []
    for batch in range(7):
        own = counts(spark, [(1, 1, 1, 100 - batch), (2, batch, 3, 100 - batch)])
        fresh = runs.unsettled(own, 3)
        # the first line is in three documents once a compacted run says so
        assert fresh.where("head = 1").count() == (0 if batch >= 4 else 1)
        runs.add(fresh)
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]]
    merged = {(r.head, r.tail): (r.n_docs, r.keeper) for r in runs.merged().collect()}
    assert merged[1, 1] == (4, 100)
    assert all(merged[2, batch] == (3, 100 - batch) for batch in range(7))
    known = counts(spark, [(2, 5, 1, 1), (2, 9, 1, 1)])
    assert [r.tail for r in runs.unsettled(known, 3).collect()] == [9]
    runs.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_a_batch_meets_the_runs_without_shuffling_them(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = line_dedup.LineRuns(spark, fanout=8)
        for k in range(3):
            runs.add(counts(spark, [(k, i, 3, i) for i in range(50)]))
        entries = spark.createDataFrame([(i, i, i % 4, i) for i in range(100)], "doc_id long, row_key long, head long, tail long")
        own = runs.unsettled(runs.counted(entries), 3)
        own.explain()
        plan = capsys.readouterr().out
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1
        assert {(r.head, r.tail) for r in own.collect()} == {(i % 4, i) for i in range(100) if i % 4 == 3 or i >= 50}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        runs.forget()


def test_odd_rows(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.odd().collect()]
    found = line_dedup.digests(line_dedup.dedup(corpus.odd()))
    assert by_id(found, "n_lines", "n_dropped", "kept_sha256") == brute(rows)
    assert line_dedup.dedup(corpus.none()).count() == 0
    assert line_dedup.drop_lines(corpus.none()).columns == corpus.none().columns


def test_repeated_rows_and_null_ids_are_documents(corpus):
    line = "the very same line in all of these"
    rows = [(1, line + "\na"), (1, line + "\na"), (1, line + "\nb"), (None, line), (0, f"{line}\n{line}\nc"), (None, "another line without any id at all")]
    rows += [(None, "another line without any id at all")] * 2
    found = line_dedup.digests(line_dedup.dedup(corpus.documents(rows)))
    assert by_id(found, "n_lines", "n_dropped", "kept_sha256") == brute(rows)


def test_drop_lines_keeps_the_other_columns(corpus):
    line = "a line of some length that repeats"
    docs = corpus.odd().unionByName(corpus.documents([(20 + i, f"{line}\n{i}\n{line}") for i in range(4)]), allowMissingColumns=True)
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    texts = {r.doc_id: r.text for r in kept.where("doc_id >= 20").collect()}
    assert texts == {20: "0", 21: "1", 22: "2", 23: f"{line}\n3\n{line}"}
    assert kept.where("doc_id = 1").first().text is None
