"""Loads of one key at once, claims of the dead, and holders that were thought dead."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from sedimenta.plans import claims, records


def test_one_of_many_creates_a_file(spark, tmp_path):
    folder, won = claims.Folder(spark, str(tmp_path / "f")), []
    start = threading.Barrier(8)

    def attempt():
        start.wait()
        won.append(folder.create("x"))

    threads = [threading.Thread(target=attempt) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True]


def test_two_sessions_loads_of_one_key_store_rows_once(spark, tmp_path):
    target, ledger, results, start = str(tmp_path / "t"), str(tmp_path / "l"), [], threading.Barrier(2)

    def load(session):
        rows = session.range(1000).select(F.col("id").cast("string").alias("uid"))
        start.wait()
        results.append(records.load_once(session, rows, target, ledger, "k", "b", wait=60))

    threads = [threading.Thread(target=load, args=(s,)) for s in (spark, spark.newSession())]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["replayed"] for r in results) == [False, True] and {r["rows"] for r in results} == {1000}
    assert spark.read.parquet(target).count() == 1000


def test_a_live_claim_is_respected_and_a_dead_one_taken_over(spark, tmp_path):
    at = str(tmp_path / "c")
    with claims.claimed(spark, at, "k", lease=30) as first:
        with pytest.raises(claims.LoadBusy):
            with claims.claimed(spark, at, "k", lease=30):
                pass
        first.folder.touch(first.name, time.time() - 100)  # as if its holder had died
        with claims.claimed(spark, at, "k", lease=30) as second:
            second.check()
            with pytest.raises(claims.ClaimLost):
                first.check()
    with claims.claimed(spark, at, "k", lease=30) as third:  # let go
        assert third.generation == 2


def test_a_load_that_lost_its_claim_stores_nothing(spark, tmp_path, monkeypatch):
    target, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    rows = spark.range(5).select(F.col("id").cast("string").alias("uid"))
    monkeypatch.setattr(claims.Claim, "check", lambda self: (_ for _ in ()).throw(claims.ClaimLost("x")))
    with pytest.raises(claims.ClaimLost):
        records.load_once(spark, rows, target, ledger, "k", "b")
    monkeypatch.undo()
    assert records.load_once(spark, rows, target, ledger, "k", "b")["rows"] == 5
    assert spark.read.parquet(target).count() == 5 and spark.read.parquet(ledger).count() == 1
