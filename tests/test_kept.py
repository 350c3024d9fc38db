"""Kept tables: retries, writers at once, earlier versions, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from tracklens.sources import kept

SCHEMA = "k int, v string, at int"


@pytest.fixture
def table(spark, tmp_path):
    return kept.KeptTable(spark, f"file://{tmp_path}/t", ("k",), "at")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table, version=None):
    found = table.read(version)
    return None if found is None else {(r.k, r.v) for r in found.collect()}


def test_upserts_retries_and_restarts(spark, table):
    assert held(table) is None
    table.upsert(rows(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 1)), "s", 0)
    assert held(table) == {(1, "b"), (2, "c"), (None, "n")}
    for _ in range(2):  # the second time it's a retry
        v = table.upsert(rows(spark, (2, "d", 0)), "s", 1)
        assert v.number == 2 and held(table) == {(1, "b"), (2, "d"), (None, "n")}
    table.upsert(rows(spark, (9, "late retry", 0)), "s", 0)
    assert held(table) == {(1, "b"), (2, "d"), (None, "n")}
    table.upsert(rows(spark, (3, "e", 0)), "a new checkpoint", 0)  # batch 0 of another run replaces nothing
    assert held(table) == {(1, "b"), (2, "d"), (3, "e"), (None, "n")}
    assert held(table, 1) == {(1, "b"), (2, "c"), (None, "n")} and held(table, 0) is None
    assert {r.k for r in table.read(having=spark.createDataFrame([(2,), (7,)], "k int")).collect()} == {2}
    assert table.rows_of("s", 1).count() == 1 and table.rows_of("s", 7) is None


def test_failed_write_leaves_the_table(spark, table):
    table.upsert(rows(spark, (1, "a", 1)), "s", 0)
    with pytest.raises(Exception):
        table.upsert(rows(spark, (1, "x", 1)).withColumn("v", F.raise_error(F.lit("no"))), "s", 1)
    assert held(table) == {(1, "a")}
    table.upsert(rows(spark, (1, "b", 1)), "s", 1)
    assert held(table) == {(1, "b")}


def test_writers_at_once(spark, table):
    failed = []

    def write(n):
        try:
            for b in range(3):
                table.upsert(rows(spark, (100 * n + b, str(n), b), (0, f"{n}-{b}", b)), f"w{n}", b)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and table.version().number == 12 == len(table.versions())
    assert {k for k, _ in held(table)} == {0} | {100 * n + b for n in range(1, 5) for b in range(3)}


def test_the_second_of_two_commits_retries(spark, table, monkeypatch):
    other = kept.KeptTable(spark, table.root, ("k",), "at")
    commit, seen = table._commit, []

    def overtaken(v):
        if not seen:
            other.upsert(rows(spark, (5, "other", 0)), "o", 0)
        seen.append(v.number)
        return commit(v)

    monkeypatch.setattr(table, "_commit", overtaken)
    assert table.upsert(rows(spark, (6, "own", 0)), "s", 0).number == 2
    assert seen == [1, 2] and held(table) == {(5, "other"), (6, "own")}
    monkeypatch.setattr(table, "_commit", lambda v: False)
    with pytest.raises(kept.Overtaken):
        table.upsert(rows(spark, (7, "never", 0)), "s", 1)
    assert held(other) == {(5, "other"), (6, "own")}


def test_compaction_loses_nothing(spark, table, monkeypatch):
    for b in range(3):
        table.upsert(rows(spark, (b, "x", b), (9, str(b), b)), "s", b)
    other = kept.KeptTable(spark, table.root, ("k",), "at")
    commit = table._commit

    def late(v):
        monkeypatch.setattr(table, "_commit", commit)
        other.upsert(rows(spark, (9, "meanwhile", 0)), "s", 3)
        return commit(v)

    monkeypatch.setattr(table, "_commit", late)
    v = table.compact()
    assert len(v.parts) == 2 and held(table) == {(0, "x"), (1, "x"), (2, "x"), (9, "meanwhile")}
    table.upsert(rows(spark, (9, "again", 0)), "s", 1)  # a batch that was compacted isn't written again
    assert (9, "meanwhile") in held(table)
    table.upsert(rows(spark, (9, "later", 0)), "s", 4)
    assert (9, "later") in held(table) and held(table, 3) == {(0, "x"), (1, "x"), (2, "x"), (9, "2")}
    table.forget(1)
    assert table.versions() == [table.version().number] and (9, "later") in held(table) and len(table._names("parts")) == 3
