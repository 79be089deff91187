"""Evaluation passages inside training documents.

The training words of a shard form a *suffix array*; every suffix of every evaluation item is searched in it by
bisection. An item leaks into a document that holds ``MIN_WORDS`` or more consecutive words of it. Words are maximal
runs of Unicode letters and digits, in lower case; what stands between them is ignored.

The longest match of a document and an item stands between neighbours: where the suffixes of both are merged in order,
the longest common beginning is that of some suffix of the one and the suffix of the other next to it. So what is
compared grows with the suffixes, not with their pairs, however often a text repeats itself. Order and common beginnings
come from the ranks of all runs of 1, 2, 4, 8, … words of the documents and items concerned.

A suffix that starts with ``MIN_WORDS`` words of which one occurs in no item can match nothing, so only the
others enter the array. This loses no match, and makes the arrays small wherever a corpus is mostly clean.

The documents are read once and aren't shuffled: what goes to the tasks are the items, in blocks of at most
``BLOCK_CHARS`` characters – evaluation sets are small, and a larger one costs another pass for each block. Blocks pass
one after the other, each written before the next is fetched, so the driver never holds more than one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

#: Consecutive words that make a leak (fixed by the data's description).
MIN_WORDS = 13
#: Characters of items that one pass takes to the tasks, and of documents that make a shard.
BLOCK_CHARS, SHARD_CHARS = 16_000_000, 8_000_000

_NO_WORD = r"[^\p{L}\p{N}]+"


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(index of the text, word)`` for the words of all texts, in order; null texts have none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), _NO_WORD)
    owner, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    there = pc.not_equal(words, "")
    return owner.filter(there).to_numpy(zero_copy_only=False).astype(np.int64), words.filter(there)


class Items:
    """The evaluation side: vocabulary, word numbers of all items in one array, and the suffixes to search."""

    def __init__(self, item_ids: list, texts: list[str], min_words: int = MIN_WORDS):
        owner, words = split_words(pa.array(texts, pa.string()))
        self.vocabulary = pc.unique(words)
        self.words = pc.index_in(words, value_set=self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.owner, self.ids, self.min_words = owner, np.array(item_ids, np.int64), min_words
        n = len(self.words)
        self.suffixes = np.flatnonzero(owner[: n - min_words + 1] == owner[min_words - 1 :]) if n >= min_words else np.empty(0, np.int64)
        self.first = np.searchsorted(owner, np.arange(len(texts)))
        # Equal beginnings are searched once.
        keys = suffix_keys(self.words, self.suffixes, min_words)
        order = np.argsort(keys, kind="stable")
        self.suffixes, keys = self.suffixes[order], keys[order]
        self.patterns, self.at = np.unique(keys, return_index=True)
        self.until = np.append(self.at[1:], len(keys)).astype(np.int64)


def suffix_keys(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words from each start as one byte string whose order is that of the words."""
    padded = np.concatenate([words, np.zeros(depth, np.int64)]).astype(">u4")
    if not len(starts):
        return np.empty(0, f"S{4 * depth}")
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[starts]
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").reshape(-1)


def run_ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each ``j`` the rank, among all, of the run of ``2**j`` words that starts at each place; runs over the end count as
    ended there. Until all ranks differ or runs are as long as ``longest``."""
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    n, width = len(words), 1
    while width < longest and ranks[-1].max(initial=0) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = ranks[-1][width:] + 1 if width < n else 0
        ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return ranks


def common_words(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal words from places ``x`` and ``y`` on."""
    n = len(ranks[0])
    x, y = x.copy(), y.copy()
    start = x.copy()
    for j in reversed(range(len(ranks))):
        repeat = j == len(ranks) - 1  # the longest runs known may follow each other
        while True:
            inside = (x < n) & (y < n)
            same = np.zeros(len(x), bool)
            same[inside] = ranks[j][x[inside]] == ranks[j][y[inside]]
            x, y = x + (same << j), y + (same << j)
            if not repeat or not same.any():
                break
    return x - start


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index of the interval, place)`` for every place of the intervals ``low..high``."""
    n = high - low
    return np.repeat(np.arange(len(low)), n), np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _with_ends(words: np.ndarray, owner: np.ndarray, wanted: np.ndarray, first_mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts ``wanted``, each text closed by a mark of its own; and where each word now stands."""
    kept = np.flatnonzero(np.isin(owner, wanted))
    texts = np.cumsum(np.append(False, owner[kept][1:] != owner[kept][:-1]))
    at = np.arange(len(kept)) + texts
    out = np.empty(len(kept) + len(wanted), np.int64)
    out[at] = words[kept]
    out[np.append(at[1:][texts[1:] != texts[:-1]] - 1, len(out) - 1)] = -(first_mark + np.arange(len(wanted)))
    where = np.full(len(words), -1, np.int64)
    where[kept] = at
    return out, where


def longest_matches(items: Items, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """All (document, item) matches of a shard: document, item, words, word of the document, word of the item.

    ``words`` are vocabulary numbers, 0 for a word of no item. For each document and item the longest match; of equally
    long ones the first of those that stand next to each other in the merged array.
    """
    k = items.min_words
    none = (np.empty(0, np.int64),) * 5
    n = len(words)
    if n < k or not len(items.suffixes):
        return none
    unknown = np.concatenate([[0], np.cumsum(words == 0)])
    may = np.flatnonzero((unknown[k:] == unknown[:-k]) & (owner[: n - k + 1] == owner[k - 1 :]))
    if not len(may):
        return none
    keys = suffix_keys(words, may, k)
    order = np.argsort(keys, kind="stable")
    array, keys = may[order], keys[order]  # the suffix array, sorted as far as a match must reach
    low, high = np.searchsorted(keys, items.patterns, side="left"), np.searchsorted(keys, items.patterns, side="right")
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return none
    # Suffixes of the documents and of the items, by the beginning they share.
    at_d, place = _spread(low[hit], high[hit])
    d = array[place]
    at_i, place = _spread(items.at[hit], items.until[hit])
    i = items.suffixes[place]
    docs, doc = np.unique(owner[d], return_inverse=True)
    named, item = np.unique(items.owner[i], return_inverse=True)

    left, where_d = _with_ends(words, owner, docs, 1)
    right, where_i = _with_ends(items.words, items.owner, named, 1 + len(docs))
    both = np.concatenate([left, right])
    longest = max(np.bincount(items.owner[np.isin(items.owner, named)]).max(), 1)
    ranks = run_ranks(both, int(longest))

    # For each document and item that share a beginning, the suffixes of both.
    share_d = np.unique(np.stack([at_d, doc], 1), axis=0)
    share_i = np.unique(np.stack([at_i, item], 1), axis=0)

    def beside(at, share):
        lo, hi = np.searchsorted(share[:, 0], at, side="left"), np.searchsorted(share[:, 0], at, side="right")
        row, place = _spread(lo, hi)
        return row, share[place, 1]

    row_d, item_d = beside(at_d, share_i)
    row_i, doc_i = beside(at_i, share_d)
    pair = np.concatenate([doc[row_d] * len(named) + item_d, doc_i * len(named) + item[row_i]])
    spot = np.concatenate([where_d[d[row_d]], where_i[i[row_i]] + len(left)])
    order = np.lexsort((ranks[-1][spot], pair))
    pair, spot = pair[order], spot[order]
    of_item = spot >= len(left)
    next_to = np.flatnonzero((pair[1:] == pair[:-1]) & (of_item[1:] != of_item[:-1]))
    x, y = spot[next_to], spot[next_to + 1]
    x, y = np.minimum(x, y), np.maximum(x, y)  # documents stand before items
    length = common_words(ranks, x, y)
    pair = pair[next_to]
    order = np.lexsort((y, x, -length, pair))
    best = order[np.append(True, pair[order][1:] != pair[order][:-1])]
    best = best[length[best] >= k]
    back_d, back_i = np.full(len(left), -1, np.int64), np.full(len(right), -1, np.int64)
    back_d[where_d[where_d >= 0]], back_i[where_i[where_i >= 0]] = np.flatnonzero(where_d >= 0), np.flatnonzero(where_i >= 0)
    d, i = back_d[x[best]], back_i[y[best] - len(left)]
    doc, item = owner[d], items.owner[i]
    return doc, items.ids[item], length[best], d - np.searchsorted(owner, doc), i - items.first[item]


_SCHEMA = "doc_id long, item_id long, n_words int, doc_word int, item_word int"


def _search(items: Items):
    def shard(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        owner, words = split_words(texts)
        numbers = pc.fill_null(pc.index_in(words, value_set=items.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        doc, item, n, d, i = longest_matches(items, owner, numbers)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(doc)), pa.array(item), pa.array(n.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(i.astype(np.int32))],
            names=["doc_id", "item_id", "n_words", "doc_word", "item_word"],
        )

    def run(batches):
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                base = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, base + SHARD_CHARS, side="right")))
                yield shard(ids.slice(at, end - at), texts.slice(at, end - at))
                at = end

    return run


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The items leaked into each document: ``doc_id, item_id, n_words, doc_word, item_word``.

    ``n_words`` is the length of the longest common run of words; ``doc_word`` and ``item_word`` say where it
    starts, counted from 0. Rows with a null id or text give nothing; items of fewer than ``min_words`` words
    match nothing; rows that repeat an id give the longest of their matches. Other columns are ignored.
    """
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    total = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CHARS))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = []
    for k in range(blocks):
        rows = (known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else known).collect()
        matches = texts.mapInArrow(_search(Items([r[0] for r in rows], [r[1] for r in rows], min_words)), _SCHEMA)
        found.append(materialise(matches, f"leaks-{k}") if blocks > 1 else matches)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("best")
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "best.n_words", (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))
    )


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` without those that hold a passage of an item. Rows with a null id are kept."""
    leaked = leaked_items(documents, items, min_words).select(F.col("doc_id").alias("_leaked")).distinct()
    return documents.join(leaked, documents["doc_id"] == leaked["_leaked"], "left_anti")
