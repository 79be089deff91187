"""Splitting oversized items at natural boundaries.

Items are cut into *ranges* – of ``RANGE`` characters of a text, or as many bytes of a file – each read with a halo on
both sides. In its range a worker finds the boundaries – paragraph, line, sentence, word – and the *anchor*: the best
boundary near the range's end, which the next worker finds too, in its left halo. Between two anchors pieces are laid
out greedily, each as long as the limit allows and ending at the best boundary in its last part; a piece starts
``overlap`` tokens before the last one's end. The boundary tables, a row for each range, are stitched by prefix sums over
the ranges: of lengths, to know what is oversized; of pieces, to number them. Pieces are emitted by offset.

The ranges of a text are cut where it is read, in one pass over it; those of files are tasks of their own, read by
offset from the file system that the path names, and no worker ever holds more than a range of a file.

Tokens of a text: ``floor(max(chars / 4, words * 1.3)) + 1`` for the text stripped of surrounding white space,
0 for a blank text; words are runs without white space.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limit and overlap in tokens (fixed by the data's description).
LIMIT, OVERLAP = 750, 110
#: Characters of a range and of the halo on either side. The halo holds the longest piece and its overlap.
RANGE, HALO = 1 << 16, 8192
#: A piece ends in its last part, from this share of the limit on, if there is a natural boundary there.
FILL = 0.5
#: Characters of the parts into which a long word is cut, and tokens of the overlap given up to begin at a word.
PART, SPARE = 16, 20

_PARAGRAPH, _LINE, _SENTENCE, _WORD = 4, 3, 2, 1
_SPACES = re.compile(r"\s+")
_ENDS = ".!?…।。！？"
_CLOSERS = "\"'”’»)]"


def token_count(chars: int, words: int) -> int:
    return int(max(chars / 4, words * 1.3)) + 1 if chars else 0


def tokens_of(text: str | None) -> int:
    """Tokens of a text; null counts as empty."""
    bare = (text or "").strip()
    return token_count(len(bare), len(bare.split()))


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``text``, and the rank of the boundary before each word's start."""
    starts, ends, ranks = [], [], []
    at = 0
    rank = _PARAGRAPH
    for gap in _SPACES.finditer(text):
        if gap.start() > at:
            starts.append(at)
            ends.append(gap.start())
            ranks.append(rank)
        space = gap[0]
        feeds = space.count("\n") + space.count("\r") - space.count("\r\n")
        if feeds > 1:
            rank = _PARAGRAPH
        elif feeds == 1:
            rank = _LINE
        else:
            word = text[max(at, gap.start() - 4) : gap.start()].rstrip(_CLOSERS)
            rank = _SENTENCE if word and word[-1] in _ENDS else _WORD
        at = gap.end()
    if at < len(text):
        starts.append(at)
        ends.append(len(text))
        ranks.append(rank)
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(ranks, np.int8)


def _units(text: str, back: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ``back`` and ``hi``; one of over four parts is cut into parts, and one around ``lo`` there. A part that begins no word has rank 0."""
    starts, ends, ranks = boundaries(text[back:hi])
    starts, ends = starts + back, ends + back
    if len(starts) and ((ends - starts > 4 * PART) | ((starts < lo) & (lo < ends))).any():
        s, e, r = [], [], []
        for a, b, k in zip(starts.tolist(), ends.tolist(), ranks.tolist()):
            cuts = [*range(a, b, PART), b] if b - a > 4 * PART else [a, b]
            if a < lo < b and lo not in cuts:
                cuts = sorted([*cuts, lo])
            s += cuts[:-1]
            e += cuts[1:]
            r += [k] + [0] * (len(cuts) - 2)
        starts, ends, ranks = np.array(s, np.int64), np.array(e, np.int64), np.array(r, np.int8)
    return starts, ends, ranks


def lay_out(text: str, lo: int, hi: int, back: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Offsets of the pieces that cover ``lo..hi``; the first may reach back to ``back`` for its overlap.

    Each piece has at most ``limit`` tokens and each but the last ends at the best boundary that leaves it at
    least ``FILL`` of them; of equal ones the last. The overlap with the piece before is as near to ``overlap``
    tokens as a word allows, from below, so that a piece never grows past the limit by it; where that would leave
    out more than ``SPARE`` of them, it begins inside the word.
    """
    starts, ends, ranks = _units(text, back, lo, hi)
    n = len(starts)
    if not n:
        return []
    word = np.cumsum(ranks > 0)

    def tokens(i: int, j: int) -> int:
        return token_count(int(ends[j - 1] - starts[i]), int(word[j - 1] - word[i]) + 1)

    def furthest(i: int) -> int:
        by_chars = int(np.searchsorted(ends, starts[i] + 4 * limit, side="left"))
        by_words = i + int(limit / 1.3)
        j = max(i + 1, min(by_chars, by_words, n))
        while j < n and tokens(i, j + 1) <= limit:
            j += 1
        while j > i + 1 and tokens(i, j) > limit:
            j -= 1
        return j

    def start_of_overlap(j: int, low: int) -> int:
        i = j
        while i - 1 >= low and tokens(i - 1, j) <= overlap:
            i -= 1
        whole = i
        while whole < j and not ranks[whole]:
            whole += 1
        return whole if whole < j and tokens(whole, j) >= overlap - SPARE else i

    fresh = int(np.searchsorted(starts, lo))  # the first word that no piece holds yet
    if fresh >= n:
        return []
    pieces: list[tuple[int, int]] = []
    begin = start_of_overlap(fresh, 0) if overlap and fresh else fresh
    while fresh < n:
        end = furthest(begin)
        if end <= fresh:  # the overlap leaves no room for a new word
            begin = min(begin + 1, fresh)
            continue
        if end < n:
            least = fresh + 1
            while least < end and tokens(begin, least) < FILL * limit:
                least += 1
            window = ranks[least : end + 1]
            if len(window):
                end = least + int(len(window) - 1 - np.argmax(window[::-1]))
        pieces.append((int(starts[begin]), int(ends[end - 1])))
        if end >= n:
            break
        fresh = end
        begin = max(start_of_overlap(end, begin + 1), begin + 1) if overlap else end
    return pieces


def anchor(text: str, lo: int, hi: int) -> int:
    """The best word start in ``text[lo:hi]``, of equal ones the last; ``hi`` where there is none."""
    starts, _, ranks = boundaries(text[lo:hi])
    if len(starts) < 2:
        return hi
    best = 1 + int(len(starts) - 2 - np.argmax(ranks[1:][::-1]))
    return lo + int(starts[best])


def range_pieces(segment: str, left: int, core: int, first: bool, last: bool, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of one range, as offsets into ``segment``: ``left`` characters of halo, ``core`` of the range, halo.

    A range owns what lies between the anchor in the end of the range before and the anchor in its own end.
    """
    quarter = HALO // 4
    lo = 0 if first else anchor(segment, max(0, left - quarter), left)
    hi = len(segment) if last else anchor(segment, max(left, left + core - quarter), left + core)
    back = 0 if first else max(0, lo - HALO // 2)
    return lay_out(segment, lo, hi, back, limit, overlap)


def _range_stats(segment: str, left: int, core: int, first: bool) -> tuple[int, int, int]:
    """Words that start in the range; offsets of its first and last character that isn't white space (-1: none)."""
    own = segment[left : left + core]
    words = len(own.split())
    if words and not first and not own[0].isspace() and not segment[left - 1].isspace():
        words -= 1  # its first word began in the range before
    bare = own.lstrip()
    return words, (len(own) - len(bare) if bare else -1), (len(own.rstrip()) - 1 if bare else -1)


#: Ranges between two partial sums of a prefix sum.
SUM_BLOCK = 4096

_TABLE_SCHEMA = "key string, digest long, n_ranges int, range_no int, words long, first_char long, last_char long, starts array<long>, ends array<long>, tokens array<int>"


def _may_exceed(text: Column, limit: int) -> Column:
    """False only for texts that can't have more than ``limit`` tokens, by their length alone, as at most every
    other character begins a word. Spares short items the way through Python and loses none."""
    return F.length(text) > F.lit(min(int(2 * (limit - 1) / 1.3) - 2, 4 * (limit - 1)))


def _emit(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


_TABLE_TYPES = [
    ("key", pa.string()), ("digest", pa.int64()), ("n_ranges", pa.int32()), ("range_no", pa.int32()), ("words", pa.int64()), ("first_char", pa.int64()), ("last_char", pa.int64()),
    ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int32())), ("pieces", pa.list_(pa.string())),
]


def range_table(text: str, limit: int, overlap: int):
    """The boundary table of a text, a row for each range: its words, first and last character, and pieces by offset. The
    lengths are summed up first: a text within the limit has no table, as no piece of it is needed."""
    ranges, words, first, last = [], 0, None, None
    for at in range(0, len(text), RANGE):
        left, core = HALO if at else 0, min(RANGE, len(text) - at)
        segment = text[at - left : at + core + HALO]
        n, a, z = _range_stats(segment, left, core, at == 0)
        words, first, last = words + n, at + a if a >= 0 and first is None else first, at + z if z >= 0 else last
        ranges.append((segment, left, core, n, at + a if a >= 0 else None, at + z if z >= 0 else None))
    if first is None or token_count(last - first + 1, words) <= limit:
        return
    for k, (segment, left, core, n, a, z) in enumerate(ranges):
        base = k * RANGE - left
        pieces = range_pieces(segment, left, core, k == 0, k == len(ranges) - 1, limit, overlap)
        yield len(ranges), k, n, a, z, [base + s for s, _ in pieces], [base + e for _, e in pieces]


def _tables_of(limit: int, overlap: int, with_text: bool):
    types = _TABLE_TYPES if with_text else _TABLE_TYPES[:-1]

    def run(batches):
        for b in batches:
            rows = []
            for key, digest, text in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "text"))):
                for n, k, words, a, z, starts, ends in range_table(text, limit, overlap):
                    pieces = [text[s:e] for s, e in zip(starts, ends)]
                    rows.append((key, digest, n, k, words, a, z, starts, ends, [tokens_of(x) for x in pieces], *([pieces] if with_text else [])))
            yield _emit(rows, types)

    return run


def boundary_tables(rows: DataFrame, key: str, text: str, limit: int, overlap: int, with_text: bool = False) -> DataFrame:
    """The boundary tables of all items that may be oversized, a row for each range, each once.

    An item is a (key, text): ``digest`` tells apart different texts under one key.
    """
    known = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull() & _may_exceed(F.col("text"), limit))
    schema = _TABLE_SCHEMA + (", pieces array<string>" if with_text else "")
    return known.select("key", F.xxhash64("text").alias("digest"), "text").mapInArrow(_tables_of(limit, overlap, with_text), schema).dropDuplicates(["key", "digest", "range_no"])


def sums_before(counts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys, order, before``: the sum of ``value`` in the rows before, in two steps, so that no window holds more than the
    rows of a block or the blocks of a key."""
    blocks = counts.withColumn("_block", F.expr(f"{order} div {SUM_BLOCK}"))
    whole = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy(*keys, "_block").agg(F.sum(value).alias("_n")).select(*keys, "_block", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(base, [*keys, "_block"]).select(*keys, order, (F.col("_base") + F.col("_own")).cast("int").alias("before"))


def _stitched(tables: DataFrame, limit: int) -> DataFrame:
    """Items over the limit, from the sums over the tables of their ranges: ``key, digest, n_tokens, n_pieces``."""
    sums = tables.groupBy("key", "digest").agg(
        F.sum("words").alias("words"), (F.max("last_char") - F.min("first_char") + 1).alias("chars"), F.sum(F.size("starts")).alias("n_pieces")
    )
    n = F.floor(F.greatest(F.col("chars") / F.lit(4.0), F.col("words") * F.lit(1.3).cast("double"))) + 1
    return sums.where("chars > 0").select("key", "digest", n.cast("int").alias("n_tokens"), "n_pieces").where(F.col("n_tokens") > limit)


def oversized(rows: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key, n_tokens, n_pieces`` of the items of more than ``limit`` tokens, which come out in more than one piece; distinct.

    Stored token counts aren't looked at, and all other columns are ignored. Rows with a null key or text are no
    items; a text repeated under its key counts once, different texts under one key count each.
    """
    found = _stitched(boundary_tables(rows, key, text, limit, overlap), limit).where("n_pieces > 1")
    return found.select(F.col("key").alias(key), "n_tokens", "n_pieces").distinct()


def split_items(rows: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of every item of more than ``limit`` tokens: ``key, piece_no, start_at, end_at, n_tokens, piece``.

    Offsets count characters of the text from 0, the end exclusive; ``piece_no`` counts from 1. Every piece has
    at most ``limit`` tokens – given that a run without white space is cut where no word begins in the last part
    of a piece – and every word lies in a piece; the next one shares about ``overlap`` tokens with it, also inside
    such a run. Null keys and texts give nothing; repeated rows give their pieces once.
    """
    tables = boundary_tables(rows, key, text, limit, overlap, with_text=True)
    one = tables.where("n_ranges = 1").withColumn("before", F.lit(0))
    many = tables.where("n_ranges > 1")
    before = sums_before(many.select("key", "digest", "range_no", F.size("starts").alias("n")), ["key", "digest"], "range_no", "n")
    many = many.join(before, ["key", "digest", "range_no"])
    zipped = F.posexplode(F.arrays_zip("starts", "ends", "tokens", "pieces")).alias("at", "p")
    exploded = one.unionByName(many.select(*one.columns)).select("key", "before", zipped)
    return exploded.select(
        F.col("key").alias(key), (F.col("before") + F.col("at") + 1).alias("piece_no"), F.col("p.starts").alias("start_at"), F.col("p.ends").alias("end_at"), F.col("p.tokens").alias("n_tokens"), F.col("p.pieces").alias("piece")
    )


def _file_segment(data: bytes, lo: int, start: int, core: int) -> tuple[str, int, int, int]:
    """The text of a byte range with its halos, cut to whole characters: segment, left, core (characters), its first byte."""

    def whole(at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    a = 0
    while lo and a < len(data) and data[a] & 0xC0 == 0x80:
        a += 1
    b, c = whole(start - lo), whole(start + core - lo)
    left, own, right = (x.decode("utf-8", "replace") for x in (data[a:b], data[b:c], data[c:]))
    return left + own + right, len(left), len(own), lo + a


def split_files(spark: SparkSession, paths: str | list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of UTF-8 files of any size: ``path, piece_no, start_byte, n_tokens, piece``.

    ``paths``: files, folders or patterns on any file system that Spark lists and Arrow opens – mounted, HDFS, object
    stores. Each task reads one range of ``RANGE`` bytes with its halos by offset; no file is loaded whole. A file within
    the limit comes out as one piece, an empty or blank one as none.
    """
    # Of the files only names and lengths are read here: their contents are columns that nobody asks for.
    table = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size")).where("size > 0")
    ranges = table.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"cast((size - 1) div {RANGE} as long)"))).alias("k"))
    ranges = ranges.repartition("path", "k")

    def read(batches):
        for b in batches:
            for path, size, k in zip(*(b.column(c).to_pylist() for c in ("path", "size", "k"))):
                start, core = k * RANGE, min(RANGE, size - k * RANGE)
                lo, hi = max(0, start - HALO), min(size, start + core + HALO)
                system, place = pafs.FileSystem.from_uri(path)
                with system.open_input_file(place) as f:
                    data = f.read_at(hi - lo, lo)
                segment, left, own, first_byte = _file_segment(data, lo, start, core)
                last = k == (size - 1) // RANGE
                rows, at_byte, at_char = [], first_byte, 0
                for at, (s, e) in enumerate(range_pieces(segment, left, own, k == 0, last, limit, overlap)):
                    at_byte, at_char = at_byte + len(segment[at_char:s].encode()), s
                    rows.append((path, k, at, at_byte, tokens_of(segment[s:e]), segment[s:e]))
                yield _emit(rows, [("path", pa.string()), ("k", pa.int64()), ("at", pa.int32()), ("start_byte", pa.int64()), ("n_tokens", pa.int32()), ("piece", pa.string())])

    pieces = ranges.mapInArrow(read, "path string, k long, at int, start_byte long, n_tokens int, piece string")
    counts = pieces.groupBy("path", "k").agg(F.count("*").alias("n"))
    before = sums_before(counts, ["path"], "k", "n")
    return pieces.join(before, ["path", "k"]).select("path", (F.col("before") + F.col("at") + 1).alias("piece_no"), "start_byte", "n_tokens", "piece")
