"""The ledger's unique key: what is shuffled, two writers at once, and writes that stop half way."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.ledger_store import KEY, Ledger, held

ROWS = "user_id long, fingerprint string, id long"


def rows(spark, ids, keys=None):
    return spark.createDataFrame([(i % 7, f"f{(keys or (lambda x: x))(i)}", i) for i in ids], ROWS)


def test_the_ledger_is_not_shuffled(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l", ["user_id", "fingerprint"], 4)
    ledger.append(rows(spark, range(50)), "id")
    ledger.append(rows(spark, range(40, 90)), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ledger.fresh(rows(spark, range(80, 100)), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    # one exchange, on the side of the new rows; the grouping by key stays in place
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in scan and f"ReadSchema: struct<{KEY}:string>" in scan
    assert held(spark, f"{tmp_path}/l", ["user_id", "fingerprint"]).count() == 90


def test_two_imports_at_once_add_each_row_once(spark, tmp_path):
    ledgers = [Ledger(spark, f"{tmp_path}/l", ["user_id", "fingerprint"], 4) for _ in range(4)]
    added = []

    def run(k):
        added.append({r.id for r in ledgers[k].append(rows(spark, range(10 * k, 10 * k + 40)), "id").collect()})

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = [r.id for r in ledgers[0].table().collect()]
    assert sorted(got) == list(range(70)) and sum(map(len, added)) == 70
    assert ledgers[0].batches() == list(range(1, len(ledgers[0].batches()) + 1))


def test_the_loser_of_a_race_compares_again(spark, tmp_path, monkeypatch):
    ledger, other = (Ledger(spark, f"{tmp_path}/l", ["user_id", "fingerprint"], 4) for _ in range(2))
    stage, raced = Ledger._stage, []

    def slow(self, rows_):
        folder = stage(self, rows_)
        if self is ledger and not raced:
            raced.append(other.append(rows(spark, range(5, 15)), "id").count())
        return folder

    monkeypatch.setattr(Ledger, "_stage", slow)
    assert {r.id for r in ledger.append(rows(spark, range(10)), "id").collect()} == set(range(5)) and raced == [10]
    assert sorted(r.id for r in ledger.table().collect()) == list(range(15))


def test_a_write_that_stops_half_way_leaves_no_row(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l", ["user_id", "fingerprint"], 4)
    ledger.append(rows(spark, range(10)), "id")
    broken = rows(spark, range(10, 500)).withColumn("id", F.when(F.col("id") == 499, F.raise_error("stop").cast("long")).otherwise(F.col("id"))).repartition(4)
    with pytest.raises(Exception, match="stop"):
        ledger.append(broken, "id")
    assert sorted(r.id for r in ledger.table().collect()) == list(range(10)) and ledger.batches() == [1]
    # the same rows, whole, come in
    assert ledger.append(rows(spark, range(500)), "id").count() == 490 and ledger.table().count() == 500


def test_staged_and_not_registered_is_not_read(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l", ["user_id", "fingerprint"], 4)
    assert ledger.table() is None
    ledger._stage(ledger.fresh(rows(spark, range(10)), "id"))
    assert ledger.table() is None and ledger.batches() == []
    with pytest.raises(ValueError):
        held(spark, f"{tmp_path}/l", ["user_id"])


def test_nulls_and_repeats(spark, tmp_path):
    some = spark.createDataFrame([(1, None, 1), (1, None, 2), (None, "a", 3), (1, "a", None), (1, "null", 5), (1, "", 6)], ROWS)
    ledger = Ledger(spark, f"{tmp_path}/l", ["user_id", "fingerprint"], 3)
    for _ in range(2):
        ledger.append(some, "id")
    assert {(r.user_id, r.fingerprint, r.id) for r in ledger.table().collect()} == {(1, None, 1), (None, "a", 3), (1, "a", None), (1, "null", 5), (1, "", 6)}
    assert ledger.batches() == [1]
    # a ledger keeps its number of buckets
    assert Ledger(spark, f"{tmp_path}/l", ["user_id", "fingerprint"]).buckets == 3
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("staged_")]
