"""Planning of embedding work: commit slices, request batches, and what the budget pays for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks of a commit slice, texts and tokens of a request, tokens of an input.
SLICE_CHUNKS, BATCH_TEXTS, BATCH_TOKENS, INPUT_TOKENS = 150, 100, 20_000, 2_048


def commit_slices(items: DataFrame, target: int = SLICE_CHUNKS, cap: int = 0) -> DataFrame:
    """``item_key, n_chunks, slice, state``: items, the largest first, in slices that close at ``target`` chunks.

    ``state`` is ``planned``, ``deferred`` (it would pass ``cap`` chunks in all; the first item is always taken)
    or ``empty``. The counter starts again after each slice, which no window function can do; it is a fold over
    the ordered sizes. Items of one size are alike but for their order, so what is folded is a row for each
    *distinct* size: its items take up what is left of the open slice, then as many each as a slice needs, and
    the cap lets the first ones of them pass. The state goes on from size to size, through all items.
    """
    target = max(1, target)
    sized = items.where("item_key is not null").select("item_key", F.coalesce("n_chunks", F.lit(0)).cast("int").alias("n_chunks"))
    numbered = sized.withColumn("nth", F.row_number().over(Window.partitionBy("n_chunks").orderBy("item_key")))
    # Of the numbered items, so that both sides of the join read one shuffle.
    sizes = numbered.groupBy("n_chunks").agg(F.max("nth").alias("n")).where("n_chunks > 0")
    gathered = sizes.agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("n_chunks").cast("long").alias("c"), F.col("n").cast("long").alias("n"))))).alias("xs"))
    # Of each size: items the cap lets pass, the slice and the chunks in it before them, items that close that slice, items of each further slice.
    state = "struct<slice:long,held:long,used:long,out:array<struct<n_chunks:int,passed:long,slice:long,head:long,each:long>>>"
    passed = f"CASE WHEN {cap} > 0 THEN least(x.n, greatest(if(a.used = 0, 1L, 0L), ({cap} - a.used) div x.c)) ELSE x.n END"
    fold = f"""
      aggregate(xs, cast(named_struct('slice', 0L, 'held', 0L, 'used', 0L, 'out', array()) as {state}), (a, x) ->
        transform(array(named_struct('a', a, 'x', x, 'k', {passed}, 'head', ({target} - a.held + x.c - 1) div x.c, 'each', ({target} + x.c - 1) div x.c)), y ->
          named_struct('slice', CASE WHEN y.k < y.head THEN y.a.slice ELSE y.a.slice + 1 + (y.k - y.head) div y.each END,
                       'held', CASE WHEN y.k < y.head THEN y.a.held + y.k * y.x.c ELSE (y.k - y.head) % y.each * y.x.c END,
                       'used', y.a.used + y.k * y.x.c,
                       'out', concat(y.a.out, array(named_struct('n_chunks', cast(y.x.c as int), 'passed', y.k, 'slice', y.a.slice, 'head', y.head, 'each', y.each)))))[0])"""
    starts = gathered.select(F.explode(F.expr(fold)["out"]).alias("o")).select("o.*")
    nth = F.col("nth") - 1
    slice_no = F.when(nth < F.col("passed"), F.col("slice") + F.when(nth < F.col("head"), 0).otherwise(1 + F.floor((nth - F.col("head")) / F.col("each"))))
    state_of = F.when(F.col("n_chunks") <= 0, "empty").when(nth < F.col("passed"), "planned").otherwise("deferred")
    return numbered.join(F.broadcast(starts), "n_chunks", "left").select("item_key", "n_chunks", slice_no.cast("int").alias("slice"), state_of.alias("state"))


def request_batches(inputs: DataFrame, max_texts: int = BATCH_TEXTS, max_tokens: int = BATCH_TOKENS, max_input: int = INPUT_TOKENS, lane: str | None = None) -> DataFrame:
    """``pos, n_tokens, batch``: inputs in order of ``pos``, a new batch where either ceiling would be passed.

    In each ``lane`` (a column of ``inputs``) by itself; a lane is what one slice embeds. Inputs count for at most
    ``max_input`` tokens. Where a batch begins depends on all before it in its lane, so a lane is one pass; it streams
    through its task in order, sorted on disk if need be, and only the open batch is held.
    """
    name = lane or "lane"
    rows = inputs.select(F.col(lane).alias(name) if lane else F.lit(0).alias(name), F.col("pos").cast("long").alias("pos"), F.least(F.coalesce("n_tokens", F.lit(0)), F.lit(max_input)).cast("long").alias("n_tokens"))
    kind = rows.schema[name].dataType.simpleString()

    def run(batches):
        at: object = run  # no lane is this
        batch = texts = held = 0
        for b in batches:
            out = np.empty(b.num_rows, np.int32)
            for i, (key, n) in enumerate(zip(b.column(name).to_pylist(), b.column("n_tokens").to_pylist())):
                if key != at:
                    at, batch, texts, held = key, 0, 0, 0
                elif texts >= max_texts or held + n > max_tokens:
                    batch, texts, held = batch + 1, 0, 0
                texts, held = texts + 1, held + n
                out[i] = batch
            yield pa.RecordBatch.from_arrays([b.column(name), b.column("pos"), b.column("n_tokens"), pa.array(out)], names=[name, "pos", "n_tokens", "batch"])

    out = rows.repartition(name).sortWithinPartitions(name, "pos").mapInArrow(run, f"{name} {kind}, pos long, n_tokens long, batch int")
    return out if lane else out.drop("lane")


def affordable(slices: DataFrame, budget: int, spent: int = 0) -> DataFrame:
    """``slice, miss_tokens, running, affordable``: slices run in order until one would pass what is left of the
    day's budget; it and all later ones wait. A budget of 0 is unlimited."""
    order = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("miss_tokens").over(order)
    return slices.select("slice", "miss_tokens", running.alias("running"), (F.lit(budget == 0) | (running <= max(0, budget - spent))).alias("affordable"))


def first_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``slice, miss_tokens``: tokens each slice must pay for. A text is a miss if the cache lacks it and no earlier
    slice embeds it; copies within its first slice all count, as they are looked up before any is stored.

    ``texts``: ``slice, fp, n_tokens``; ``cache``: ``fp``.
    """
    missing = texts.join(cache.select("fp").distinct(), "fp", "left_anti")
    first = Window.partitionBy("fp")
    paid = missing.withColumn("first", F.min("slice").over(first)).where("slice = first")
    return texts.select("slice").distinct().join(paid.groupBy("slice").agg(F.sum("n_tokens").alias("m")), "slice", "left").select("slice", F.coalesce("m", F.lit(0)).cast("bigint").alias("miss_tokens"))
