"""Snapshot changes and orphan references: defined results for nulls, repeats, ties, empty tables and clashing columns."""

from datetime import datetime, timedelta

from quern.operators.references import key_runs, orphan_references, orphan_report
from quern.operators.snapshots import listing_changes, snapshot_changes
from tests.conftest import rows

T0 = datetime(2025, 1, 1)
SNAP = "snapshot_no int, source_id string, item_key string, content_hash string, delivered_at timestamp, generation string, k1 int"


def snap(no, source, key, digest, hours=0):
    return (no, source, key, digest, T0 + timedelta(hours=hours), "clash", 7)


def test_snapshots(spark):
    data = [
        snap(1, "a", "K1/", "sha256:AA"), snap(2, "a", " k1 ", "aa"),  # the same record, the same digest
        snap(1, "a", "k2", "x"), snap(2, "a", "k2", "y", 1), snap(2, "a", "k2", "x", 0),  # late row holds
        snap(1, "a", "k3", None), snap(2, "a", "k3", "z"),  # a missing hash is no change
        snap(1, "a", "k4", "x"),  # removed
        snap(2, "a", "k5", "x"), snap(2, "a", "k5", "x"),  # added, twice the same
        snap(2, "b", "k1", "x"), snap(3, "b", "k1", "q"),  # a source that starts late
        snap(1, "c", "k1", "x"), snap(3, "c", "k1", "y"),  # absent from snapshot 2
        snap(1, None, "k1", "x"), snap(1, "a", None, "x"), snap(None, "a", "k9", "x"),
    ]
    got = rows(snapshot_changes(spark.createDataFrame(data, SNAP)), "snapshot_no", "source_id", "item_key", "change_type")
    assert got == [(2, "a", "k2", "changed"), (2, "a", "k4", "removed"), (2, "a", "k5", "added"), (3, "b", "k1", "changed"), (3, "c", "k1", "changed")]


def test_snapshots_empty_and_single(spark):
    empty = spark.createDataFrame([], SNAP)
    assert snapshot_changes(empty).count() == 0
    assert snapshot_changes(spark.createDataFrame([snap(1, "a", "k", "x")], SNAP)).count() == 0


def test_hot_source_against_brute_force(spark):
    import random

    g = random.Random(3)
    data = [snap(n, "hot" if g.random() < 0.7 else f"s{g.randrange(4)}", f"k{g.randrange(60)}", g.choice("abc"), g.randrange(9)) for n in (1, 2, 4, 7) for _ in range(150)]
    held, present = {}, {}
    for n, s, k, h, at, *_ in data:
        present.setdefault(s, set()).add(n)
        key = (n, s, k)
        held[key] = max(held.get(key, (at, h)), (at, h))
    want = set()
    for s, numbers in present.items():
        order = sorted(numbers)
        for a, b in zip(order, order[1:]):
            old = {k: v[1] for (n, x, k), v in held.items() if (n, x) == (a, s)}
            new = {k: v[1] for (n, x, k), v in held.items() if (n, x) == (b, s)}
            want |= {(b, s, k, "added") for k in new.keys() - old.keys()} | {(b, s, k, "removed") for k in old.keys() - new.keys()}
            want |= {(b, s, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    got = snapshot_changes(spark.createDataFrame(data, SNAP)).drop("old_value", "new_value")
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_listings(spark):
    schema = "source_id string, item_key string, id string, n int"
    before = [("a", "K1", "i1", 1), ("a", "k1", "i1", 2), ("a", "k2", "i2", 1), ("a", "k3", "i3", 1), ("a", None, "i9", 1)]
    after = [("a", "k1/", "i1", 1), ("a", "k2", "i2", 1), ("a", "k2", "i22", 1), ("a", "k4", "i4", 1)]
    got = rows(listing_changes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), 5))
    assert got == [(5, "a", "k2", "changed"), (5, "a", "k3", "removed"), (5, "a", "k4", "added")]
    empty = spark.createDataFrame([], schema)
    assert {r["change_type"] for r in listing_changes(empty, spark.createDataFrame(after, schema), 5).collect()} == {"added"}
    assert listing_changes(empty, empty, 5).count() == 0


REFS = "snapshot_no int, snapshot_at timestamp, chunk_ids array<string>, created_at string, grp int"


def test_orphans(spark):
    parents = spark.createDataFrame(
        [("s::p::1::a", T0), ("s::p::2::b", T0), ("s::p::2::b", T0 + timedelta(days=9)), ("s::p::4::d", T0 + timedelta(days=5)), ("plain", None), (None, T0)], "id string, created_at timestamp"
    )
    refs = spark.createDataFrame(
        [
            (1, T0 + timedelta(days=1), ["s::p::1::a", "s::p::2::b", "s::p::2::B", "s::p::3::c", "s::p::4::d", None, "s::p::4::d"], "x", 1),
            (2, T0 + timedelta(days=7), ["s::p::4::d", "plain", "Plain", "", "s::q::1::a", "s::p::01::a"], "x", 1),
            (3, T0, [], "x", 1), (3, T0, None, "x", 1), (None, T0, ["s::p::9::z"], "x", 1), (4, None, ["s::p::4::d", "nope"], "x", 1),
        ],
        REFS,
    )
    got = rows(orphan_references(refs, parents), "snapshot_no", "chunk_id", "reason")
    assert got == sorted([
        (1, "s::p::2::B", "missing"), (1, "s::p::3::c", "missing"), (1, "s::p::4::d", "later"),
        (2, "Plain", "missing"), (2, "", "missing"), (2, "s::q::1::a", "missing"), (2, "s::p::01::a", "missing"), (4, "nope", "missing"),
    ], key=repr)
    report = {r["snapshot_no"]: (r["n_references"], r["n_missing"], r["n_later"]) for r in orphan_report(refs, parents, "t").collect()}
    assert report == {1: (5, 2, 1), 2: (6, 4, 0), 4: (2, 1, 0)}
    none = spark.createDataFrame([], parents.schema)
    assert orphan_references(refs, none).where("reason <> 'missing'").count() == 0
    assert orphan_references(spark.createDataFrame([], REFS), parents).count() == 0


def test_runs_are_contiguous(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 2, 2, 3, 5, 6, 9)] + [(2, 1)], "grp long, ord int")
    assert rows(key_runs(df)) == [(1, 1, 3), (1, 5, 6), (1, 9, 9), (2, 1, 1)]


def test_runs_settle_what_lies_beyond_them(spark, monkeypatch):
    """The as-of match decides: with every run cut down to its start, parents inside runs count as missing."""
    from quern.operators import references

    parents = spark.createDataFrame([(f"s::p::{i}::a", T0) for i in range(1, 6)], "id string, created_at timestamp")
    refs = spark.createDataFrame([(1, T0, [f"s::p::{i}::a" for i in (1, 3, 5, 6)], "x", 1)], REFS)
    assert rows(orphan_references(refs, parents), "chunk_id") == [("s::p::6::a",)]
    whole = references.key_runs
    monkeypatch.setattr(references, "key_runs", lambda held: whole(held).withColumn("end", references.F.col("start")))
    assert len(rows(orphan_references(refs, parents), "chunk_id")) == 3


def test_the_index_outlives_the_run(spark, tmp_path):
    """A new store on the same folder goes on where the last one stopped; a repeated delivery changes nothing."""
    from quern.operators.snapshots import SnapshotStore, latest_rows

    deliveries = {
        1: [snap(1, "a", "k1", "x"), snap(1, "a", "k2", "x"), snap(1, "b", "k1", "x")],
        2: [snap(2, "a", "k1", "y"), snap(2, "a", "k3", "x")],  # nothing of source b
        3: [snap(3, "a", "k1", "y"), snap(3, "b", "k1", "z"), snap(3, "b", "k2", "x")],
    }
    want = {1: [], 2: [("k1", "changed", "x", "y"), ("k2", "removed", "x", None), ("k3", "added", None, "x")], 3: [("k1", "changed", "x", "z"), ("k2", "added", None, "x"), ("k3", "removed", "x", None)]}
    for n, data in deliveries.items():
        for _ in range(2):
            store = SnapshotStore(spark, str(tmp_path / "s"))  # nothing is kept in memory
            found = store.deliver(latest_rows(spark.createDataFrame(data, SNAP)), n)
            assert rows(found, "item_key", "change_type", "old_value", "new_value") == sorted(want[n], key=repr)
            assert store.current() == (n, 12, {1: [1], 2: [1, 2], 3: [3]}[n])
    names = {p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")}
    assert {x for x in names if not x.startswith("changes")} == {"index-3", "records-3", "current-3-12-3"}
    plan = SnapshotStore(spark, str(tmp_path / "s"))
    table = plan._read("index-3", "k1 bigint, k2 bigint, source_hash bigint, value_hash bigint, generation int", 12)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in table.join(plan._read("records-3", "k1 bigint, k2 bigint", 12), ["k1", "k2"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
