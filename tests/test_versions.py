"""Versioned tables: several writers, broken writes, repeats, compaction."""
import threading

import pytest
from pyspark.sql import functions as F

from quiremill.operators import search as S
from quiremill.operators import versions as VS
from quiremill.sources import folders


@pytest.fixture
def rows(spark):
    return lambda *r: spark.createDataFrame(list(r), "file_id long, x string")


@pytest.fixture
def ids(spark):
    return lambda *i: spark.createDataFrame([(x,) for x in i], "file_id long")


def read(spark, table, part="a"):
    return sorted(tuple(r) for r in VS.read(spark, table, part).select("file_id", "x").collect())


def at_once(*tasks):
    errors = []

    def run(task):
        try:
            task()
        except Exception as e:  # noqa: BLE001  shown below
            errors.append(e)

    threads = [threading.Thread(target=run, args=(t,)) for t in tasks]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors


def test_claims_differ(spark, tmp_path):
    table, got = str(tmp_path), []
    at_once(*[lambda: got.extend(VS.claim(spark, table) for _ in range(10))] * 4)
    assert sorted(got) == list(range(1, 41))
    assert VS.claim(spark, table, "x") == 41 and VS.claim(spark, table, "x") == 41 and VS.claim(spark, table) == 42
    assert folders.create_new(spark, f"{table}/m", "1") and not folders.create_new(spark, f"{table}/m", "2")
    assert folders.read_text(spark, f"{table}/m") == "1"


def test_two_writers_lose_nothing(spark, tmp_path, rows):
    table = str(tmp_path)
    chunks = lambda w, n: spark.createDataFrame([(f, 0, f"{w}{n}") for f in (w * 10 + n, 99)], "file_id long, chunk_index int, chunk_text string")
    writer = lambda w: [S.replace_chunks(spark, table, chunks(w, n)) for n in range(4)]
    at_once(lambda: writer(1), lambda: writer(2))
    got = {r.file_id: r.chunk_text for r in S.read_chunks(spark, table).collect()}
    assert {k: v for k, v in got.items() if k != 99} == {w * 10 + n: f"{w}{n}" for w in (1, 2) for n in range(4)}
    assert got[99] in ("13", "23") and S.read_chunks(spark, table).count() == 9
    assert VS.committed(spark, table) == list(range(1, 9))


def test_all_parts_or_none(spark, tmp_path, rows, ids):
    table = str(tmp_path)
    VS.replace(spark, table, {"a": rows((1, "old"), (2, "old")), "b": rows((1, "old"))}, ids(1, 2), "t-0")
    broken = rows((1, "lost")).withColumn("x", F.raise_error(F.lit("broken")))
    for parts in ({"a": broken, "b": rows((1, "new"))}, {"a": rows((1, "new")), "b": broken}):
        with pytest.raises(Exception, match="broken"):
            VS.replace(spark, table, parts, ids(1), "t-1")
        assert read(spark, table) == [(1, "old"), (2, "old")] and read(spark, table, "b") == [(1, "old")]
    assert VS.replace(spark, table, {"a": rows((1, "new")), "b": rows()}, ids(1), "t-1") == 2      # the version it had begun
    assert VS.replace(spark, table, {"a": rows((1, "twice")), "b": rows()}, ids(1), "t-1") == 2    # it counts already
    assert read(spark, table) == [(1, "new"), (2, "old")] and read(spark, table, "b") == []


def test_a_write_that_ends_after_compaction_wins(spark, tmp_path, rows, ids, monkeypatch):
    table = str(tmp_path)
    VS.replace(spark, table, {"a": rows((1, "old"), (2, "old"), (3, "old"))}, ids(1, 2, 3))
    VS.replace(spark, table, {}, ids(3))
    slow = VS.claim(spark, table, "slow")                 # begun before, ends after
    assert VS.compact(spark, table) == slow + 1
    assert VS.replace(spark, table, {"a": rows((1, "late"))}, ids(1), "slow") == slow
    assert read(spark, table) == [(1, "late"), (2, "old")]
    assert VS.compact(spark, table) and read(spark, table) == [(1, "late"), (2, "old")]
    assert len(VS.committed(spark, table)) == 1
    gone = VS.vacuum(spark, table)
    assert len(gone) == 4 and read(spark, table) == [(1, "late"), (2, "old")]
    assert folders.names(spark, f"{table}/a") == [f"version={VS.committed(spark, table)[0]}"]
    assert VS.replace(spark, table, {"a": rows((1, "slow again"))}, ids(1), "slow") == slow and read(spark, table)[0] == (1, "late")


def test_deletes_are_carried(spark, tmp_path, rows, ids):
    """A part of the versions is put together: the delete among them still hides rows of the others."""
    table = str(tmp_path)
    first = VS.replace(spark, table, {"a": rows((1, "x"), (2, "x"))}, ids(1, 2))
    second = VS.replace(spark, table, {}, ids(1))
    third = VS.replace(spark, table, {"a": rows((3, "x"))}, ids(3))
    VS.compact(spark, table, [second, third])
    assert read(spark, table) == [(2, "x"), (3, "x")] and first in VS.committed(spark, table)


def test_small_versions_are_put_together(spark, tmp_path, rows, ids):
    table = str(tmp_path)
    for n in range(12):
        VS.replace(spark, table, {"a": rows((n % 5, str(n)))}, ids(n % 5), compact_after=4)
    assert len(VS.committed(spark, table)) <= 5
    assert read(spark, table) == [(0, "10"), (1, "11"), (2, "7"), (3, "8"), (4, "9")]
