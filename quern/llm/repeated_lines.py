"""Lines repeated across the documents of one source.

Texts are cut into *content-defined chunks*: a rolling hash runs over the normalised text (lower case; white
space, ASCII digits and ASCII punctuation dropped) and a chunk ends where its low bits are zero. Equal passages
are so cut alike wherever they stand, with no regard to how the text was wrapped. The end of a line ends a
chunk too, so that a line is a whole number of chunks and short lines – menus, bylines – are one.

1. one pass over the texts writes the table of lines: source, document, line number, key of the whole line, and
   the keys of its chunks;
2. distinct documents are counted for each (source, chunk), and with them the least and greatest key of the lines
   that hold the chunk. A chunk that stands in one line only counts for that line: its documents are the line's;
3. a line that has no chunk of its own is repeated only if all its chunks are; such lines, and no others, are then
   counted whole, which is exact.

Keys are fixed-width hashes and documents are counted after partial sums for each (chunk, document), so neither a
hot line nor a hot source meets in one task. Lines that hold a large share of all occurrences – there can't be more
than ``HOT_PARTS`` of them – are looked up by broadcast, the rest by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

#: A line is repeated excessively in at least so many distinct ids, and in at least this share of its source's ids.
MIN_DOCUMENTS, MIN_SHARE = 5, 0.02
#: Bytes of normalised text that the rolling hash sees, and the average and least length of a chunk.
WINDOW, AVERAGE, LEAST = 16, 64, 16
#: A line is hot from this part of all line occurrences on; so there are at most so many hot lines.
HOT_PARTS = 10_000

#: What normalisation drops: white space, ASCII digits, ASCII punctuation. (Arrow's RE2 syntax.)
_DROPPED = r"[\s\x0b\x1c-\x1f\x{85}\pZ0-9!-/:-@\[-`{-~]+"

_GEAR = np.random.Generator(np.random.PCG64(20240)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the ``WINDOW`` bytes that end there: sum of gear[byte] << age. By doubling."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint64(width)
        h = h + shifted
        width *= 2
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class SpanHash:
    """Hashes of any byte spans of a buffer, from running sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        power[1:] = _BASE
        inverse = np.empty(n + 1, np.uint64)
        inverse[0] = 1
        inverse[1:] = _INVERSE
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(_GEAR[data]) * power[:-1], out=self.sums[1:])
        self.inverse = inverse

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mix(h ^ _mix((end - start).astype(np.uint64)))


def normalised_lines(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``(index of the text, normalised line)`` of every line; a text ends in a line even where that is empty."""
    lines = pc.split_pattern(texts, "\n")
    flat = pc.replace_substring_regex(pc.utf8_lower(pc.list_flatten(lines)), _DROPPED, "")
    return pc.list_parent_indices(lines), flat


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the spans ``starts..ends``: (span of the chunk, its start, its end), in order.

    A cut needs ``LEAST`` bytes of the span before it – hence a window that lies within the span – and is taken
    by content alone. A cut less than ``LEAST`` bytes behind the last *candidate* is dropped, which again
    depends on nothing but the content near by.
    """
    h = rolling_hash(data)
    at = np.flatnonzero((h >> np.uint64(40)) & np.uint64(AVERAGE - 1) == 0).astype(np.int64) + 1
    span = np.searchsorted(ends, at, side="left")
    inside = (span < len(ends)) & (at - starts[np.minimum(span, len(ends) - 1)] >= LEAST) & (at < ends[np.minimum(span, len(ends) - 1)])
    at, span = at[inside], span[inside]
    if len(at):
        near = np.zeros(len(at), bool)
        near[1:] = (span[1:] == span[:-1]) & (at[1:] - at[:-1] < LEAST)
        at, span = at[~near], span[~near]
    spans = np.concatenate([np.arange(len(starts)), span])
    begins = np.concatenate([starts, at])
    order = np.lexsort((begins, spans))
    spans, begins = spans[order], begins[order]
    last = np.append(spans[1:] != spans[:-1], True)
    chunk_ends = np.where(last, ends[spans], np.append(begins[1:], 0))
    return spans, begins, chunk_ends


_LINES_SCHEMA = "source_id string, id string, document long, line_no int, line long, chunks array<long>"


def _line_rows(batches):
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        parents, lines = normalised_lines(texts)
        parents = parents.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.searchsorted(parents, np.arange(len(texts)))
        number = np.arange(len(parents)) - first[parents] + 1
        if isinstance(lines, pa.ChunkedArray):
            lines = lines.combine_chunks()
        lines = lines.cast(pa.large_string())
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        keep = np.flatnonzero(offsets[1:] > offsets[:-1])
        if not len(keep):
            continue
        starts, ends = offsets[:-1][keep], offsets[1:][keep]
        hashes = SpanHash(data)
        line = hashes(starts, ends).view(np.int64)
        spans, begins, chunk_ends = cut_points(data, starts, ends)
        chunk = hashes(begins, chunk_ends).view(np.int64)
        counts = np.bincount(spans, minlength=len(keep))
        list_offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        chunks = pa.ListArray.from_arrays(pa.array(list_offsets), pa.array(chunk, pa.int64()))
        rows = pa.array(parents[keep])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("source_id").take(rows),
                batch.column("id").take(rows),
                batch.column("document").take(rows),
                pa.array(number[keep].astype(np.int32)),
                pa.array(line),
                chunks,
            ],
            names=["source_id", "id", "document", "line_no", "line", "chunks"],
        )


def line_table(rows: DataFrame) -> DataFrame:
    """``source_id, id, document, line_no, line, chunks`` for every line that isn't empty once normalised."""
    texts = rows.select("source_id", "id", F.xxhash64("id").alias("document"), "text").where("id is not null and source_id is not null and text is not null")
    return texts.mapInArrow(_line_rows, _LINES_SCHEMA)


def _excessive(counted: DataFrame, sizes: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """Of rows ``source, n_documents, ...`` those that reach both bounds. Sizes are spread by salt, as one source may
    hold most of the rows."""
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = sizes.select("source", "n_ids", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"))
    enough = counted.where(F.col("n_documents") >= min_documents).withColumn("salt", F.pmod("key", F.lit(n)).cast("int"))
    return enough.join(copies, ["source", "salt"]).where(F.col("n_documents") >= F.col("n_ids") * min_share).drop("salt", "n_ids")


def frequent_chunks(lines: DataFrame, sizes: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """``source, key, n_documents, least, greatest``: the chunks in enough distinct documents of their source, and the
    least and greatest key of the lines in which they stand."""
    each = lines.select("source", F.explode("chunks").alias("key"), "document", "line")
    held = each.groupBy("source", "key", "document").agg(F.min("line").alias("least"), F.max("line").alias("greatest"))
    counted = held.groupBy("source", "key").agg(F.count("*").alias("n_documents"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return _excessive(counted, sizes, min_documents, min_share)


def repeated_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """Every occurrence of a line that is repeated excessively within its source.

    ``rows``: ``source_id, id, text``; other columns are ignored. Returns ``source_id, id, line_no, n_documents``,
    distinct; lines count from 1 after splitting at line feeds. Rows with a null id, source or text give
    nothing and count nowhere; an id that occurs several times counts once. Two lines are the same if they are
    equal once lower-cased and without white space, ASCII digits and ASCII punctuation; lines that are then
    empty don't count.
    """
    known = rows.where("id is not null and source_id is not null and text is not null")
    sizes = (
        known.select(F.xxhash64("source_id").alias("source"), F.xxhash64("id").alias("document"))
        .distinct()
        .groupBy("source")
        .agg(F.count("*").alias("n_ids"))
    )
    lines = materialise(line_table(rows), "lines").withColumn("source", F.xxhash64("source_id"))
    chunks = materialise(frequent_chunks(lines, sizes, min_documents, min_share), "chunks")
    # A chunk of one line alone settles it.
    settled = chunks.where("least = greatest").groupBy("source", F.col("least").alias("line")).agg(F.max("n_documents").alias("n_documents"))
    # The others: lines all of whose chunks are frequent and shared with other lines.
    shared = chunks.where("least <> greatest").select("source", F.col("key").alias("chunk"))
    own = F.array_distinct("chunks")
    pieces = lines.select("source", "line", F.explode(own).alias("chunk"), F.size(own).alias("n")).join(shared, ["source", "chunk"], "left_semi").distinct()
    candidates = pieces.groupBy("source", "line", "n").agg(F.count("*").alias("m")).where("m = n").select("source", "line")
    documents = lines.join(candidates, ["source", "line"], "left_semi").select("source", F.col("line").alias("key"), "document").distinct()
    counted = _excessive(documents.groupBy("source", "key").agg(F.count("*").alias("n_documents")), sizes, min_documents, min_share)
    repeated = materialise(settled.unionByName(counted.select("source", F.col("key").alias("line"), "n_documents")), "repeated")

    least_hot = max(1, lines.count() // HOT_PARTS)
    hot = F.broadcast(repeated.where(F.col("n_documents") > least_hot))
    out = ["source_id", "id", "line_no", "n_documents"]
    often = lines.join(hot, ["source", "line"]).select(*out)
    seldom = lines.join(hot, ["source", "line"], "left_anti").join(repeated.where(F.col("n_documents") <= least_hot), ["source", "line"]).select(*out)
    return often.unionByName(seldom).distinct()


def without_repeated_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``rows`` with ``clean_text``: the text without its repeated lines, and ``n_cut``: how many went.

    Every row comes out once, repeated ids included; a null text stays null. All columns of ``rows`` are kept
    – but one named ``clean_text`` or ``n_cut``, which is replaced.
    """
    cut = (
        repeated_lines(rows, min_documents, min_share)
        .groupBy(F.col("source_id").alias("_source"), F.col("id").alias("_id"))
        .agg(F.collect_set("line_no").alias("_cut"))  # bounded by the lines of one text
    )
    base = rows.drop("clean_text", "n_cut")
    joined = base.join(cut, (base["source_id"] == cut["_source"]) & (base["id"] == cut["_id"]), "left")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (l, i) -> _cut is null or not array_contains(_cut, i + 1)), '\\n')")
    return joined.withColumn("clean_text", kept).withColumn("n_cut", F.coalesce(F.size("_cut"), F.lit(0))).withColumn("n_cut", F.greatest("n_cut", F.lit(0))).drop("_source", "_id", "_cut")
