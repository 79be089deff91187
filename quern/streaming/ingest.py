"""Incremental runs and sessions as streams.

A daily run is a stream read to its end (``availableNow``): what is new since the last run, and nothing twice.
State across runs – registry and store – lives in versioned tables that ``foreachBatch`` moves forward. A table keeps
the number of the last batch with its version, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quern.operators.chunking import chunk_rows
from quern.functions.text import content_hash, dedupe_key, fingerprint, stripped
from quern.operators.delta import KEY, decide, registry_record
from quern.operators.embedding import Embedder, embed_documents
from quern.operators.sessions import IDLE_SECONDS, KEEP, last_messages
from quern.operators.store import VersionedStore, unique_chunks
from quern.plans.slices import SLICE_CHUNKS, affordable, commit_slices, first_misses
from quern.session import materialise

#: Half the hours without a message after which a user's state is dropped: long after their session has ended.
STATE_HOURS = 48


class DeltaIngest:
    """Pages to the vector store, only what changed: hash, decide, chunk, plan, and then slice by slice embed, append, record.

    A slice is committed before the next begins: its chunks are appended and then its items recorded. A run that fails in
    the middle so keeps the slices that were done, and the next one goes on with the rest; chunks that were appended but not
    recorded are live and aren't appended again. Slices that the token budget doesn't pay for wait for another run.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, mode: str = "append_only", method: str = "recursive", slice_chunks: int = SLICE_CHUNKS, most_chunks: int = 0):
        self.spark, self.embedder, self.mode, self.method = spark, embedder, mode, method
        self.slice_chunks, self.most_chunks = slice_chunks, most_chunks
        self.chunks = VersionedStore(spark, f"{path}/chunks")
        self.registry = VersionedStore(spark, f"{path}/registry")

    def run(self, pages: DataFrame, now: Column | None = None, budget: int = 0, spent: int = 0) -> dict[str, int]:
        """Takes ``source_id, source_name, source_type, item_key, text`` in; returns counts by reason, and as ``deferred`` the
        items left for another run, if there are any. ``budget``: tokens of the day, 0 for no limit; ``spent``: those used."""
        now = F.current_timestamp() if now is None else now
        fresh = (
            pages.where("source_id is not null and item_key is not null")
            .withColumn("text", stripped(F.coalesce("text", F.lit(""))))
            .where("text <> ''")
            .dropDuplicates(KEY)
            .withColumn("content_hash", content_hash(F.col("text")))
        )
        registry = self.registry.read()
        known = registry if registry is not None else self._empty_registry()
        decided = materialise(decide(fresh, known, self.embedder.space), "decided")
        counts = {r["reason"]: r["n"] for r in decided.groupBy("reason").agg(F.count("*").alias("n")).collect()}
        if not any(n for reason, n in counts.items() if reason != "unchanged"):
            return counts
        work = materialise(fresh.join(decided.where("reason <> 'unchanged'").select(*KEY), KEY, "left_semi"), "work")
        made = materialise(chunk_rows(work, self.method), "made")
        items, chunks, there, last = self._planned(work, made, budget, spent)
        for n in range(last + 1):
            self._commit(chunks.where(F.col("slice") == n).drop("slice"), items.where(F.col("slice") == n).drop("slice"), there, known, now)
        if waiting := items.where(F.col("slice").isNull() | (F.col("slice") > last)).count():
            counts["deferred"] = waiting
        return counts

    def _planned(self, work: DataFrame, made: DataFrame, budget: int, spent: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """Items with their slice, new chunks with theirs, chunks of the items that are live, and the last slice to be done now.
        The store is read here, once for all slices."""
        key = F.to_json(F.struct(*KEY)).alias("item")
        sizes = work.select(*KEY).join(made.groupBy(*KEY).agg(F.count("*").cast("int").alias("n")), KEY, "left").select(key.alias("item_key"), F.coalesce("n", F.lit(0)).alias("n_chunks"))
        plan = commit_slices(sizes, self.slice_chunks, self.most_chunks).select(F.col("item_key").alias("item"), F.when(F.col("state") == "empty", 0).otherwise(F.col("slice")).alias("slice"))
        items = materialise(work.withColumn("item", key).join(plan, "item").drop("item"), "items")
        # What is live already, or comes in an earlier slice, isn't appended again.
        unique = unique_chunks(made, [F.col("ordinal")]).join(items.select(*KEY, "slice").where("slice is not null"), KEY).withColumn("_digest", dedupe_key(F.col("text")))
        live = self.chunks.read()
        there = made.select(*KEY, "id", "tokens").limit(0)
        if live is not None:
            if self.mode == "replace":
                live = live.join(work.select(*KEY), KEY, "left_anti")
            there = materialise(made.select(*KEY, "id", "tokens").distinct().join(live.select(*KEY, "id").distinct(), [*KEY, "id"], "left_semi"), "live-chunks")
            unique = unique.join(live.select("id").distinct(), "id", "left_anti").join(live.select(dedupe_key(F.col("text")).alias("_digest")).distinct(), "_digest", "left_anti")
        for c in ("_digest", "id"):
            unique = unique.withColumn("_first", F.min("slice").over(Window.partitionBy(c))).where("slice = _first")
        chunks = materialise(unique.drop("_digest", "_first"), "new-chunks")
        last = items.agg(F.max("slice")).first()[0]
        last = -1 if last is None else last
        if budget:
            slices = items.select("slice").distinct().where("slice is not null")
            misses = first_misses(chunks.select("slice", fingerprint(F.col("text")).alias("fp"), F.col("tokens").alias("n_tokens")), self.spark.createDataFrame([], "fp string"))
            paid = affordable(slices.join(misses, "slice", "left").select("slice", F.coalesce("miss_tokens", F.lit(0)).alias("miss_tokens")), budget, spent)
            first_not = paid.where("not affordable").agg(F.min("slice")).first()[0]
            last = last if first_not is None else first_not - 1
        return items, chunks, there, last

    def _commit(self, chunks: DataFrame, items: DataFrame, there: DataFrame, known: DataFrame, now: Column) -> None:
        """One slice: vectors, chunks, and then the record of its items."""
        vectors = materialise(embed_documents(chunks, self.embedder), "vectors")
        if self.mode == "replace":
            self.chunks.upsert(vectors, KEY, replaced=items)
        else:
            self.chunks.append(vectors)
        held = chunks.select(*KEY, "id", "tokens").unionByName(there.join(items.select(*KEY), KEY, "left_semi"))
        sums = held.groupBy(*KEY).agg(F.array_sort(F.collect_set("id")).alias("chunk_ids"), F.sum("tokens").alias("token_count"))
        rows = items.join(sums, KEY, "left").select(
            *KEY, F.col("source_name").alias("title"), "content_hash", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
            F.coalesce("token_count", F.lit(0)).cast("bigint").alias("token_count"), F.lit(self.embedder.space).alias("embed_provider"),
        )
        self.registry.upsert(registry_record(known, rows, now), KEY)

    def _empty_registry(self) -> DataFrame:
        return self.spark.createDataFrame(
            [],
            "source_id string, item_key string, title string, content_hash string, chunk_ids array<string>, chunk_count int, token_count bigint, embed_provider string, "
            "status string, first_seen timestamp, last_embedded timestamp, revision int",
        )


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Reads a stream to its end in micro-batches, each handed to ``step``; a later call goes on from there."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """A stream without repeated keys; state is kept for ``delay`` behind the latest time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts in tumbling windows; what comes later than ``delay`` is dropped."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


class SessionWindow:
    """Sessions of a stream of ``user_id, event_id, ts``: a number for each message and how many its session then holds.

    ``rows`` has a row for every message. ``state`` keeps the last messages of each user's latest session, from which the next
    batch goes on; that of a user who is idle for longer than ``2 * STATE_HOURS`` of the stream's own time is dropped. Both keep
    the number of their last batch. What comes late is counted to the session under way, and so is what has no time; messages
    without user are those of one user.
    """

    SCHEMA = "user_id long, event_id long, session_no long, held long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.rows, self.state = VersionedStore(spark, f"{path}/rows"), VersionedStore(spark, f"{path}/state")

    def step(self, batch: DataFrame, number: int) -> None:
        kept = self._kept()
        self.rows.append(self._numbered(batch, kept).withColumn("batch", F.lit(number).cast("long")), number)
        # From the rows that were written, so that state that is written by a further attempt is of the same rows.
        held = self.rows.read().where(F.col("batch") == number).drop("batch", "held")
        held = last_messages(held if kept is None else held.unionByName(kept), KEEP, "user_id", [F.desc("place")])
        user = Window.partitionBy("user_id")
        current = held.withColumn("_latest", F.max("session_no").over(user)).withColumn("last", F.max("last").over(user))
        self.state.write(current.where("session_no = _latest").drop("_latest"), number)

    def read(self) -> DataFrame:
        rows = self.rows.read()
        return self.spark.createDataFrame([], self.SCHEMA) if rows is None else rows.select("user_id", "event_id", "session_no", "held")

    def _kept(self) -> DataFrame | None:
        """Messages of users who aren't idle for too long."""
        held = self.state.read()
        if held is None:
            return None
        newest = held.agg(F.max("last").alias("_newest"))
        idle = F.col("last") <= F.col("_newest") - F.expr(f"interval {2 * STATE_HOURS} hours")
        return held.crossJoin(F.broadcast(newest)).where(~F.coalesce(idle, F.lit(False))).drop("_newest")

    @staticmethod
    def _numbered(batch: DataFrame, kept: DataFrame | None) -> DataFrame:
        """The batch with ``session_no, held``, the latest time so far as ``last``, and its place among the user's messages. What is
        kept of a user is one row before those of the batch."""
        none = F.lit(None).cast("long")
        rows = batch.select("user_id", "event_id", "ts", none.alias("was"), none.alias("had"), none.alias("place"))
        if kept is not None:
            known = kept.groupBy("user_id").agg(F.max("last").alias("ts"), F.max("session_no").alias("was"), F.count("*").alias("had"), F.max("place").alias("place"))
            rows = rows.unionByName(known.withColumn("event_id", none))
        order = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("was"), F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
        before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
        gap = F.col("ts").cast("double") - F.max("ts").over(before).cast("double")
        placed = (
            rows.withColumn("new", F.coalesce("was", F.when(gap > IDLE_SECONDS, 1).otherwise(0)))
            .withColumn("session_no", F.sum("new").over(so_far))
            .withColumn("place", F.sum(F.coalesce("place", F.lit(1))).over(so_far))
            .withColumn("last", F.max("ts").over(so_far))
        )
        start = F.when(F.col("was").isNotNull(), F.col("place") - F.col("had")).when(F.col("new") == 1, F.col("place") - 1)
        held = F.col("place") - F.coalesce(F.max(start).over(so_far), F.lit(0))
        return placed.withColumn("held", F.least(held, F.lit(KEEP).cast("long"))).where("was is null").select("user_id", "event_id", "session_no", "held", "last", "place")
