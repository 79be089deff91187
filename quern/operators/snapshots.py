"""What changed between full snapshots of a table.

A delivery is compared with a *bucketed key-to-hash index* of the previous one: rows of
``(bucket, k1, k2, source hash, value hash, generation)`` and nothing else. Probing the index with the new rows
needs no strings; old keys and values are fetched for records that changed or went away, from the generation that last
held them, and for those records alone. Then the indexes are swapped: the new rows take the place of the old ones, and
sources that the delivery didn't cover keep their entries.

The index outlives the run: ``SnapshotStore`` keeps it in a folder, and each delivery reads the index and itself only. A
delivery that is repeated gives the changes it gave before and moves nothing.

Both sides are bucketed by the record's hash, so that a probe joins bucket with bucket and shuffles nothing; what
is shuffled is each delivery, once, when it is written. Buckets are hashes of the record, not
of the source, so that a source holding a third of the rows is spread like any other.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.keys import hex_digest, written_key
from quern.session import materialise, scratch_path

#: Least number of buckets of a new index, and records of a bucket, about.
BUCKETS, BUCKET_ROWS = 12, 250_000

CHANGES_SCHEMA = "snapshot_no int, source_id string, item_key string, change_type string, old_value string, new_value string"
_INDEX_SCHEMA = "k1 bigint, k2 bigint, source_hash bigint, value_hash bigint, generation int"
_RECORDS_SCHEMA = "k1 bigint, k2 bigint, source_hash bigint, value_hash bigint, source_id string, item_key string, value string"


def record_hashes(source: str = "source_id", key: str = "item_key") -> list:
    """Two independent 64-bit hashes of the record and one of its source."""
    return [
        F.xxhash64(F.col(source), F.col(key)).alias("k1"),
        F.xxhash64(F.lit("second"), F.col(key), F.col(source)).alias("k2"),
        F.xxhash64(F.col(source)).alias("source_hash"),
    ]


class SnapshotStore:
    """The key-to-hash index of the last state of every source, in a folder.

    ``records-N``: what delivery N held, ``index-N``: the index after it, ``changes-N``: what it changed; ``current-N-B-G.G``
    points to the newest complete one, of B buckets, and names the deliveries whose rows it holds. A delivery that fails
    half-way leaves the pointer, and is done again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._tables: dict[str, str] = {}
        self._fs = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._place(""))] if self._fs.exists(self._place("")) else []

    def current(self) -> tuple[int, int, list[int]] | None:
        """Number of the newest delivery, buckets of the index, and deliveries it holds rows of; None if there was none."""
        parts = [n.split("-")[1:] for n in self._names() if n.startswith("current-")]
        return max(((int(n), int(b), [int(g) for g in held.split(".")]) for n, b, held in parts), default=None)

    def _write(self, rows: DataFrame, name: str, buckets: int) -> DataFrame:
        # As many tasks as buckets, by the same hash: each writes one file.
        self._forget(name)
        table = f"snapshots_{uuid.uuid4().hex}"
        rows.repartition(buckets, "k1", "k2").write.mode("overwrite").format("parquet").option("path", f"{self.path}/{name}").bucketBy(buckets, "k1", "k2").saveAsTable(table)
        self._tables[name] = table
        return self.spark.table(table)

    def _read(self, name: str, schema: str, buckets: int) -> DataFrame:
        if name not in self._tables:  # written by an earlier run: the files' names hold their buckets
            table = f"snapshots_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY (k1, k2) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def _forget(self, name: str) -> None:
        if name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(name)}")
        self._fs.delete(self._place(name), True)

    def changes(self, n: int) -> DataFrame:
        return self.spark.read.schema(CHANGES_SCHEMA).parquet(f"{self.path}/changes-{n}")

    def deliver(self, records: DataFrame, n: int, per_source: bool = True) -> DataFrame:
        """What delivery ``n`` changes: ``snapshot_no, source_id, item_key, change_type, old_value, new_value``.

        ``records``: ``source_id, item_key, value, value_hash``, one row for each record. The first delivery of a source gives no
        changes, and a source that the delivery lacks altogether gives none either – unless ``per_source`` is false, when
        only the first delivery of all gives none.
        """
        now = self.current()
        if now is not None and n <= now[0]:
            if f"changes-{n}" not in self._names():
                raise ValueError(f"delivery {n} comes after delivery {now[0]}")
            return self.changes(n)
        buckets = now[1] if now else max(BUCKETS, -(-records.count() // BUCKET_ROWS))
        new = self._write(records.select(*record_hashes(), "value_hash", "source_id", "item_key", "value"), f"records-{n}", buckets)
        entries = new.select("k1", "k2", "source_hash", "value_hash", F.lit(n).alias("generation"))
        if now is None:
            self.spark.createDataFrame([], CHANGES_SCHEMA).write.mode("overwrite").parquet(f"{self.path}/changes-{n}")
            self._write(entries, f"index-{n}", buckets)
            held = [n]
        else:
            old = self._read(f"index-{now[0]}", _INDEX_SCHEMA, buckets)
            held = now[2]
            covered = new.select("source_hash").distinct()
            marked = materialise(self._probe(old, entries, covered if per_source else None), "marked")
            found = [marked.where("change_type = 'added'").join(new, ["k1", "k2"]).select("source_id", "item_key", "change_type", F.lit(None).cast("string").alias("old_value"), F.col("value").alias("new_value"))]
            for g in held:  # each from its own generation, bucket by bucket
                records_g = self._read(f"records-{g}", _RECORDS_SCHEMA, buckets)
                gone = marked.where((F.col("old_generation") == g) & (F.col("change_type") != "added")).join(records_g, ["k1", "k2"])
                fetched = gone.select("k1", "k2", "source_id", "item_key", "change_type", F.col("value").alias("old_value"))
                found.append(fetched.where("change_type = 'removed'").select("source_id", "item_key", "change_type", "old_value", F.lit(None).cast("string").alias("new_value")))
                there = new.select("k1", "k2", F.col("value").alias("new_value"))
                found.append(fetched.where("change_type = 'changed'").join(there, ["k1", "k2"]).select("source_id", "item_key", "change_type", "old_value", "new_value"))
            changes = reduce(DataFrame.unionByName, found).select(F.lit(n).cast("int").alias("snapshot_no"), "*")
            changes.write.mode("overwrite").parquet(f"{self.path}/changes-{n}")
            kept = old.join(covered, "source_hash", "left_anti")
            index = self._write(entries.unionByName(kept.select(*entries.columns)), f"index-{n}", buckets)
            # Deliveries whose rows still count: the sources that this one lacks.
            held = sorted([n, *(r[0] for r in index.where(F.col("generation") != n).select("generation").distinct().collect())])
        pointer = f"current-{n}-{buckets}-{'.'.join(map(str, held))}"
        self._fs.create(self._place(pointer), True).close()
        for name in self._names():  # what the new index has taken the place of
            kind, _, number = name.partition("-")
            if kind == "current" and name != pointer or kind == "index" and number != str(n) or kind == "records" and int(number) not in held:
                self._forget(name)
        return self.changes(n)

    @staticmethod
    def _probe(old: DataFrame, new: DataFrame, covered: DataFrame | None) -> DataFrame:
        """``k1, k2, change_type, old_generation`` of the records in which index and delivery differ."""
        before = old.select("k1", "k2", *(F.col(c).alias(f"old_{c}") for c in ("source_hash", "value_hash", "generation")))
        kind = (
            F.when(F.col("old_generation").isNull(), "added")
            .when(F.col("generation").isNull(), "removed")
            .when(F.col("value_hash") != F.col("old_value_hash"), "changed")
        )
        both = new.join(before, ["k1", "k2"], "full_outer").withColumn("change_type", kind).where("change_type is not null")
        if covered is not None:
            both = both.withColumn("source_hash", F.coalesce("source_hash", "old_source_hash")).join(old.select("source_hash").distinct().join(covered, "source_hash", "left_semi"), "source_hash", "left_semi")
        return both.select("k1", "k2", "change_type", "old_generation")


def latest_rows(snapshots: DataFrame) -> DataFrame:
    """One row for each (snapshot, source, written key): the one delivered last.

    Rows without a source, a key or a snapshot number are no records. Of rows with the same delivery time the
    greatest digest holds, so that the result doesn't depend on the order of rows. A hash that is null or
    blank counts as missing.
    """
    rows = snapshots.select(
        F.col("snapshot_no").cast("int").alias("generation"),
        "source_id",
        written_key(F.col("item_key")).alias("item_key"),
        F.col("delivered_at"),
        hex_digest(F.col("content_hash")).alias("digest"),
    ).where("generation is not null and source_id is not null and item_key is not null")
    return (
        rows.groupBy("generation", "source_id", "item_key")
        .agg(F.max(F.struct(F.col("delivered_at").isNotNull(), "delivered_at", F.col("digest").isNotNull(), "digest")).alias("held"))
        .select("generation", "source_id", "item_key", F.col("held.digest").alias("value"), F.when(F.col("held.digest").isNotNull(), F.xxhash64("held.digest")).alias("value_hash"))
    )


def set_rows(listing: DataFrame) -> DataFrame:
    """One row for each (source, written key) of a listing, with a hash of its *set* of ids.

    Repeated rows of an id count once. The set is hashed without being gathered: a count and two exclusive-ors
    of the members' hashes, so that a record of any number of ids costs one row in each map task.
    """
    members = listing.select("source_id", written_key(F.col("item_key")).alias("item_key"), "id").where(
        "source_id is not null and item_key is not null and id is not null"
    )
    return (
        members.distinct()
        .groupBy("source_id", "item_key")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("y"))
        .select("source_id", "item_key", F.lit(None).cast("string").alias("value"), F.xxhash64("n", "x", "y").alias("value_hash"))
    )


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Records added, removed or changed in each full snapshot against the previous one of its source.

    Needs ``snapshot_no, source_id, item_key, content_hash, delivered_at``; other columns are ignored. A record
    whose hash is missing on either side is never *changed*. Late, repeated and outdated rows are settled by
    the latest ``delivered_at``. Returns ``snapshot_no, source_id, item_key, change_type, old_value, new_value``, the values
    being digests; an empty table gives an empty result.
    """
    spark = snapshots.sparkSession
    numbers = sorted(r[0] for r in snapshots.select(F.col("snapshot_no").cast("int")).where("snapshot_no is not null").distinct().collect())
    store = SnapshotStore(spark, scratch_path(spark, "snapshots"))
    found = [store.deliver(latest_rows(snapshots.where(F.col("snapshot_no").cast("int") == n)), n) for n in numbers]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], CHANGES_SCHEMA)


def listing_changes(before: DataFrame, after: DataFrame, snapshot_no: int) -> DataFrame:
    """Records added, removed or changed between two listings of (source_id, item_key, id).

    Changed means that the record's set of ids differs. Every record of ``after`` that ``before`` lacks is
    added, and the other way round, whatever sources either covers.
    """
    store = SnapshotStore(before.sparkSession, scratch_path(before.sparkSession, "listings"))
    store.deliver(set_rows(before), snapshot_no - 1)
    return store.deliver(set_rows(after), snapshot_no, per_source=False).select("snapshot_no", "source_id", "item_key", "change_type")
