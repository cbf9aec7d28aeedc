"""The record store: what is read, what is rewritten, what a killed batch leaves."""

import os
import re

import pytest
from pyspark.sql import functions as F

from docreg.operators import registry as r
from docreg.sources.commits import version_path
from docreg.sources.record_store import BASE, CHANGES, PENDING, UNKNOWN, RecordStore
from docreg.streaming.record_stream import stream_to_store

N = 20_000


def records(spark, low=0, high=N):
    return spark.range(low, high).selectExpr("id", "'2026-01-01T08:00:00' AS created_at", "map('Surname', concat('S', id)) AS fields")


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    store = RecordStore(spark, str(tmp_path_factory.mktemp("store") / "s"), slice_ids=1000, group_rows=50)
    store.create(records(spark).repartition(7))
    return store


def fresh(spark, tmp_path, **options):
    store = RecordStore(spark, str(tmp_path / "s"), slice_ids=1000, **options)
    store.create(records(spark))
    return store


def changes(spark, *rows):
    return spark.createDataFrame([(i, v, None, {"Surname": s}) for i, v, s in rows], CHANGES)


def surnames(df, *ids):
    found = {x.id: x.fields["Surname"] for x in df.collect()}
    return [found.get(i) for i in ids] if ids else found


def scanned(df):
    """Files and rows that the scan of the payloads read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    files = rows = 0
    leaves = plan.collectLeaves()
    todo = [leaves.apply(k) for k in range(leaves.size())]
    while todo:
        leaf = todo.pop()
        if "QueryStage" in leaf.getClass().getSimpleName() or leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            inner = (leaf.plan() if "QueryStage" in leaf.getClass().getSimpleName() else leaf.executedPlan()).collectLeaves()
            todo += [inner.apply(k) for k in range(inner.size())]
        elif "payload" in leaf.simpleString(1000) and leaf.metrics().contains("numFiles"):
            files += leaf.metrics().apply("numFiles").value()
            rows += leaf.metrics().apply("numOutputRows").value()
    return files, rows


def test_a_lookup_reads_few_row_groups(filled):
    rng = __import__("random").Random(4)
    ids = [5, 17, 999, 1000, 19_999, 30_000, -4] + [rng.randrange(2000, 3000) for _ in range(5)]
    found = filled.lookup(ids)
    want = sorted(i for i in set(ids) if 0 <= i < N)
    assert sorted(surnames(found)) == want and surnames(found, 17) == ["S17"]
    files, rows = scanned(filled.lookup(ids))
    assert files == 4 and rows <= 50 * len(want) < N * 0.05
    # a hundred ids in one neighbourhood
    files, rows = scanned(filled.lookup(range(4000, 4100)))
    assert files == 1 and rows <= 150


def test_bloom_filters_rule_out_absent_ids(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "s"), slice_ids=100_000, group_rows=1000)
    store.create(records(spark).where("id % 2 = 0"))
    files, rows = scanned(store.lookup([i for i in range(1, 4000, 400)]))
    assert files == 1 and rows <= 1000  # odd ids lie inside the statistics of their groups


def test_ranges_and_tables_of_ids(spark, filled):
    assert sorted(surnames(filled.between(990, 1010))) == list(range(990, 1011))
    assert scanned(filled.between(990, 1010))[0] == 2
    ids = spark.createDataFrame([(3,), (3,), (15_500,), (99_999,)], "id long")
    assert sorted(surnames(filled.lookup_all(ids))) == [3, 15_500] and scanned(filled.lookup_all(ids))[0] == 2
    assert filled.lookup([]).count() == 0 and sorted(surnames(filled.lookup(range(1000)))) == list(range(1000))


def test_a_change_leaves_other_files_alone(spark, tmp_path):
    store = fresh(spark, tmp_path)
    before = {x.slice: x.path for x in store.manifest().collect()}
    wanted, _ = r.upsert_records(records(spark), records(spark, 3000, 3200).selectExpr("id", "map('Surname', 'new') AS fields"))
    rejected = store.upsert(records(spark, 3000, 3200).selectExpr("id", "map('Surname', 'new') AS fields").union(changes(spark, (77_777, 1, "x")).select("id", "fields")))
    after = {x.slice: x.path for x in store.manifest().collect()}
    assert [s for s in before if before[s] != after[s]] == [3] and len(before) == 20
    assert [x.id for x in rejected.collect()] == [77_777]
    assert surnames(store.records()) == surnames(wanted) and store.records().where("created_at IS NULL").count() == 0
    # a reader that took the old manifest still finds its files
    assert spark.read.parquet(before[3]).count() == 1000


def test_repeated_changes_and_versions(spark, tmp_path):
    store = fresh(spark, tmp_path)
    twice = spark.createDataFrame([(1, {"Surname": "a"}), (1, {"Surname": "b"}), (2, {"Surname": "c"})], "id long, fields map<string, string>")
    assert store.upsert(twice).count() == 2 and surnames(store.records(), 1, 2) == ["S1", "c"]
    store.upsert(changes(spark, (1, 5, "v5"), (1, 4, "v4")))
    store.upsert(changes(spark, (1, 3, "late")))
    assert surnames(store.records(), 1) == ["v5"]


def test_batches_wait_beside_the_base_and_are_merged(spark, tmp_path):
    store = fresh(spark, tmp_path, most_pending=3)
    kinds = lambda: {k: store.manifest().where(F.col("kind") == k).count() for k in (BASE, PENDING, UNKNOWN)}
    first = {x.path for x in store.manifest().collect()}
    assert store.apply_batch("s", 0, changes(spark, (1, 2, "two"), (1, 1, "one"), (50_000, 1, "unknown")))
    assert not store.apply_batch("s", 0, changes(spark, (1, 9, "again")))
    assert kinds() == {BASE: 20, PENDING: 1, UNKNOWN: 0} and surnames(store.records(), 1, 2) == ["two", "S2"]
    assert surnames(store.lookup([1])) == {1: "two"} and [x.id for x in store.rejected().collect()] == [50_000]
    plan = store.records()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan
    assert store.apply_batch("s", 1, changes(spark, (1001, 1, "b"), (2, 1, "c")))
    now = {x.path for x in store.manifest().where("kind = 'base'").collect()}
    assert kinds() == {BASE: 20, PENDING: 0, UNKNOWN: 1} and len(now - first) == 2
    assert surnames(store.records(), 1, 2, 1001) == ["two", "c", "b"] and [x.id for x in store.rejected().collect()] == [50_000]
    # an older version that comes late does not count, also after the merge
    store.apply_batch("t", 0, changes(spark, (1, 1, "late")))
    assert surnames(store.records(), 1) == ["two"]
    store.insert(records(spark, 50_000, 50_002))
    assert surnames(store.records(), 50_000, 50_001) == ["unknown", "S50001"] and store.rejected().count() == 0


def test_many_pending_changes_are_not_sent(spark, tmp_path):
    store = fresh(spark, tmp_path, most_pending=10**6)
    listing = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    many = spark.range(200_001).selectExpr("id % 100000 AS id", "id AS version", "CAST(NULL AS timestamp) AS ts", "map('Surname', concat('v', id)) AS fields")
    store.apply_batch("s", 0, many)
    sent = lambda df: re.search(r"BroadcastHashJoin \[id#\d+L\], \[id#\d+L\], LeftOuter", df._jdf.queryExecution().executedPlan().toString())
    for found in (store.records(), store.between(0, 5), store.lookup_all(spark.range(3))):
        assert not sent(found) and surnames(found, 0, 2) == ["v200000", "v100002"]
    assert sent(store.lookup([2]))
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == listing


def test_a_killed_batch_is_repeated(spark, tmp_path):
    store = fresh(spark, tmp_path, most_pending=1)
    store.apply_batch("s", 0, changes(spark, (1, 1, "a"), (2, 1, "b")))
    os.remove(f"{version_path(store.root + '/manifest', 1)}/_SUCCESS")
    assert surnames(store.records(), 1, 2) == ["S1", "S2"]
    assert store.apply_batch("s", 0, changes(spark, (1, 1, "a"), (2, 1, "b")))
    assert surnames(store.records(), 1, 2) == ["a", "b"]


def test_a_stream_into_an_encrypted_store(spark, tmp_path):
    store = fresh(spark, tmp_path, most_pending=10, key="0123456789abcdef")
    for k in range(3):
        changes(spark, *[(i, k + 1, f"v{k}") for i in range(k, 30, 3 + k)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_to_store(store, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination()
    log = spark.read.schema(CHANGES).parquet(str(tmp_path / "in"))
    latest = {x.id: x.fields["Surname"] for x in r.latest_records(log).collect()}
    got = surnames(store.records())
    assert {i: got[i] for i in latest} == latest and sum(got[i] != f"S{i}" for i in got) == len(latest)


def test_equal_versions_are_settled_alike(spark):
    rows = [(1, 1, 5, {"a": "x"}), (1, 1, 5, {"a": "y"}), (1, 1, 4, {"a": "z"})]
    for order in (rows, rows[::-1]):
        log = spark.createDataFrame([(i, v, None, f) for i, v, _, f in order], CHANGES).repartition(3)
        assert r.latest_records(log).first().fields == {"a": "z"}
        settled, _ = r.one_per_id(log.select("id", "version", "fields"))
        assert settled.first().fields == {"a": "z"}
