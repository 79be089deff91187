"""Mixing sources to target shares.

Every document gets a *rate*, the number of times it is to occur. A naive Bayes classifier, fitted on documents
labelled by their source, gives each document the evidence of its words for each target domain; biases are calibrated so that
over all documents the expected tokens of a domain are those that its source has. Rates are then fitted by
projected-gradient least squares, distributed over the documents, with two sets of residuals: the tokens of each
source against its target, and the *expected* tokens of each domain – by soft membership – against the same.
The first decide the shares; the second decide which documents of a source carry them: those that look like
what the mixture lacks. Steps go on until the squares hardly fall any more; one that raises them is taken back and halved.
Rates stay between 0 and the source's cap, and become whole numbers by error diffusion over tokens, so that the rounding of
one document is made up for by the next.

The state between two steps is one number for each source and domain; rates are functions of these, written to the table
from time to time. No document, label or rate is sent to the driver.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialise

#: The public tokenizer whose tokens are counted: a file of ranks. The path is a parameter.
TOKENIZER = os.environ.get("QUERN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Labelled rows on which the classifier is fitted at most (a sample by hash where there are more).
SAMPLE_ROWS = 200_000
#: Hashed features of the classifier; weight of the expected totals.
FEATURES, SOFT_WEIGHT = 8192, 0.3
#: The descent ends when a step lowers the squares by less than this part, or by ``STEPS`` trials; rates are written
#: every so many steps. Calibration ends when all expected totals are within ``CALIBRATED`` of the real ones, or by ``ROUNDS``.
TOLERANCE, STEPS, WRITTEN = 0.01, 40, 8
CALIBRATED, ROUNDS = 0.05, 6
#: Documents in a group of the rounding.
ROUNDING_ROWS = 4096
#: Name of the class of all documents whose source has no target.
OTHER = "\x00other"

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def _features(path: str) -> np.ndarray:
    """The feature of each token number."""
    n = tokenizer(path).max_token_value + 1
    return ((np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FEATURES


def clean_targets(targets: DataFrame) -> list[tuple[str, float, int | None]]:
    """``(source, share, cap)`` for each source with a positive share, in order of name.

    Repeated lines count once. Of different lines of a source the greatest share and the least cap hold; a null
    cap is none, and one below 1 counts as 1. Shares needn't sum to 1.
    """
    rows = (
        targets.where("source is not null and target_share > 0")
        .groupBy("source")
        .agg(F.max(F.col("target_share").cast("double")).alias("s"), F.min(F.col("max_repeats").cast("int")).alias("c"))
        .collect()
    )
    return sorted((r[0], r[1], None if r[2] is None else max(1, r[2])) for r in rows)


def _count_features(path: str):
    def run(batches):
        feature, enc = _features(path), tokenizer(path)
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                ids = enc.encode_ordinary(text)
                if ids:
                    c = counts.setdefault(label, np.zeros(FEATURES, np.int64))
                    c += np.bincount(feature[ids], minlength=FEATURES)
        for label, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), label, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["label", "feature", "n"]
            )

    return run


def fit_classifier(labelled: DataFrame, classes: int, path: str) -> np.ndarray:
    """Log-probabilities ``(FEATURES, classes)`` of a multinomial naive Bayes; no documents give a uniform one.

    ``labelled``: ``label, text``. What comes to the driver is a table of ``classes`` times ``FEATURES`` sums.
    """
    sums = labelled.mapInArrow(_count_features(path), "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    counts = np.zeros((FEATURES, classes))
    counts[table["feature"].to_numpy(), table["label"].to_numpy()] = table["n"].to_numpy()
    # Smoothed towards what all sources share.
    base = (counts.sum(1) + 0.5) / (counts.sum() + 0.5 * FEATURES)
    smooth = counts + 2000 * base[:, None]
    return np.log(smooth / smooth.sum(0)).astype(np.float32)


def _memberships(path: str, weights: np.ndarray):
    def run(batches):
        enc, by_token = tokenizer(path), weights[_features(path)]
        for b in batches:
            tokens, post = [], []
            for text in b.column("text").to_pylist():
                ids = enc.encode_ordinary(text or "")
                tokens.append(len(ids))
                # The evidence of a text grows with the root of its length, as its words aren't independent.
                z = by_token[ids].sum(0) / np.sqrt(len(ids)) if ids else np.zeros(weights.shape[1], np.float32)
                post.append(z - z.max())
            flat = pa.array(np.concatenate(post).astype(np.float32)) if post else pa.array([], pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(post) + 1, dtype=np.int32) * weights.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("label"), pa.array(tokens, pa.int64()), lists], names=["doc_id", "source", "label", "n_tokens", "evidence"])

    return run


class Fit:
    """The fitted rates: a function of a document's label, tokens and evidence.

    ``bias`` turns evidence into memberships. ``start`` holds the rate of each source at the outset; ``steps`` the
    multipliers of source and domain totals of every step of the descent since rates were written. At last a source with too
    many tokens is scaled down by ``scale``, and one with too few moved by ``lift`` of the way to its cap: either meets the
    target exactly and keeps within the cap.
    """

    def __init__(self, start: np.ndarray, caps: np.ndarray, bias: np.ndarray | None = None):
        self.start, self.caps, self.steps = start, caps, []
        self.bias = np.zeros(len(start)) if bias is None else bias
        self.scale, self.lift = np.ones(len(start)), np.zeros(len(start))

    def memberships(self, evidence: np.ndarray) -> np.ndarray:
        z = evidence + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def rates(self, label: np.ndarray, membership: np.ndarray, written: np.ndarray | None = None) -> np.ndarray:
        rate, cap = self.start[label].copy() if written is None else written.copy(), self.caps[label]
        for u, v in self.steps:
            rate = np.clip(rate - (u[label] + membership @ v) * self.start[label], 0, cap)
        room = np.where(np.isfinite(cap), cap - rate, 0.0)
        return np.clip(rate * self.scale[label] + self.lift[label] * room, 0, cap)


def _batch_arrays(b: pa.RecordBatch, fit: Fit):
    """Labels, tokens, memberships and rates of a batch."""
    label = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64)
    membership = fit.memberships(b.column("evidence").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(fit.start)).astype(np.float64))
    written = b.column("rate").to_numpy(zero_copy_only=False) if "rate" in b.schema.names else None
    return label, tokens, membership, fit.rates(label, membership, written)


def _totals(fit: Fit):
    classes = len(fit.start)

    def run(batches):
        hard, soft = np.zeros(classes), np.zeros(classes)
        for b in batches:
            label, tokens, membership, rate = _batch_arrays(b, fit)
            hard += np.bincount(label, rate * tokens, classes)
            soft += (rate * tokens) @ membership
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes, dtype=np.int32)), pa.array(hard), pa.array(soft)], names=["k", "hard", "soft"])

    return run


def _sum_totals(table: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each source and expected tokens of each domain."""
    hard, soft = np.zeros(len(fit.start)), np.zeros(len(fit.start))
    for k, h, s in table.mapInArrow(_totals(fit), "k int, hard double, soft double").groupBy("k").agg(F.sum("hard"), F.sum("soft")).collect():
        hard[k], soft[k] = h, s
    return hard, soft


def _written_rates(fit: Fit):
    def run(batches):
        for b in batches:
            rate = pa.array(_batch_arrays(b, fit)[3])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "label", "n_tokens", "evidence")), rate], names=["doc_id", "source", "label", "n_tokens", "evidence", "rate"])

    return run


def calibrated(table: DataFrame, available: np.ndarray) -> np.ndarray:
    """Biases at which the expected tokens of each domain, over all documents, are those of its source."""
    bias = np.zeros(len(available))
    there = available > 0
    for _ in range(ROUNDS if there.any() else 0):
        _, soft = _sum_totals(table, Fit(np.ones(len(available)), np.full(len(available), np.inf), bias))
        off = np.log(available[there] / np.maximum(soft[there], 1e-9))
        if np.abs(off).max() < CALIBRATED:
            break
        bias = bias.copy()
        bias[there] += off
        bias[~there] = -30.0  # no document stands for a domain that has none
    return bias


def fit_rates(table: DataFrame, targets: np.ndarray, available: np.ndarray, caps: np.ndarray) -> tuple[DataFrame, Fit]:
    """Projected-gradient least squares over the documents of ``table``; ``targets`` are tokens for each class.

    The descent starts from the rates that meet the sources' targets evenly – they are feasible, as the total is
    chosen so. A squared residual is divided by its target, and a step by the tokens of a document and its first rate, which makes
    steps alike for large and small sources and texts. Returns the table, with the rates written last, and the fit.
    """
    classes = len(targets)
    start = np.divide(targets, available, out=np.zeros(classes), where=available > 0)
    fit = Fit(start, caps, calibrated(table, available))
    aims = targets > 0
    wanted = np.where(aims, targets, np.inf)

    def squares(hard, soft):
        u, v = (hard - targets) / wanted, (soft - targets) / wanted
        return u, v, float((wanted[aims] * (u[aims] ** 2 + SOFT_WEIGHT * v[aims] ** 2)).sum())

    if not aims.any():
        return table, fit
    u, v, height = squares(*_sum_totals(table, fit))
    pace = 0.5
    for _ in range(STEPS):
        fit.steps.append((pace * u, pace * SOFT_WEIGHT * v))
        new_u, new_v, new_height = squares(*_sum_totals(table, fit))
        if new_height >= height:
            fit.steps.pop()
            pace /= 2
            if pace < 1e-3:
                break
            continue
        done = height - new_height < TOLERANCE * height
        u, v, height = new_u, new_v, new_height
        if done:
            break
        if len(fit.steps) >= WRITTEN:
            columns = "doc_id long, source string, label int, n_tokens long, evidence array<float>, rate double"
            table = materialise(table.mapInArrow(_written_rates(fit), columns), "rates")
            fit.steps = []
    # The sources' totals hold exactly, whatever the soft residuals ask for.
    hard, _ = _sum_totals(table, fit)
    for k in range(classes):
        room = caps[k] * available[k] - hard[k] if available[k] else 0.0
        if hard[k] < targets[k] and np.isfinite(room) and room > 0:
            fit.lift[k] = min(1.0, (targets[k] - hard[k]) / room)
        elif hard[k] > 0:
            fit.scale[k] = targets[k] / hard[k]
    return table, fit


def _round_rates(fit: Fit):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        b = table.combine_chunks().to_batches()[0] if table.num_rows else None
        if b is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "source": pa.array([], pa.string()), "n_tokens": pa.array([], pa.int64()), "repeats": pa.array([], pa.int32())})
        label, tokens, _, rate = _batch_arrays(b, fit)
        cap = fit.caps[label]
        whole = np.floor(rate + 1e-9)
        repeats = whole.astype(np.int64)
        error = 0.0
        for i, (part, t) in enumerate(zip((rate - whole).tolist(), tokens.tolist())):
            error += part * t
            if t and error >= t / 2 and repeats[i] + 1 <= cap[i]:
                repeats[i] += 1
                error -= t
        out = pa.table({"doc_id": b.column("doc_id"), "source": b.column("source"), "n_tokens": b.column("n_tokens"), "repeats": pa.array(repeats.astype(np.int32))})
        return out.filter(pa.array(repeats > 0))

    return run


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer_path: str = TOKENIZER) -> tuple[DataFrame, list[tuple]]:
    """``(rows, plan)``: how often each document occurs, and what was aimed at.

    ``rows``: ``doc_id, source, n_tokens, repeats`` of the documents taken at least once. ``plan``: for each target
    ``(source, target_share, share, cap, tokens available, tokens wanted, expected share)``, where ``expected`` is by soft
    membership and ``share`` is the target among the sources that have tokens: a source without documents can't contribute, and the others share its part.
    The total is ``total_tokens`` or, by default, the tokens of all targeted sources, and never more than the
    caps allow: then every share is reached. Documents with a null id, source or text, and those of sources
    without a target, are left out; an empty text has no tokens and isn't taken. Repeated ids are documents of
    their own. No targets or no documents give an empty mixture.
    """
    spark: SparkSession = documents.sparkSession
    goals = clean_targets(targets)
    numbers = {s: i for i, (s, _, _) in enumerate(goals)}
    classes = len(goals) + 1  # the last is for all other sources
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").where(
        "doc_id is not null and source is not null and text is not null"
    )
    lookup = spark.createDataFrame([(s, i) for s, i in numbers.items()] or [(OTHER, 0)], "source string, label int")
    labelled = known.join(F.broadcast(lookup), "source", "left").withColumn("label", F.coalesce("label", F.lit(classes - 1)))

    n = known.count()
    sample = labelled if n <= SAMPLE_ROWS else labelled.where(F.pmod(F.xxhash64("doc_id", "source"), F.lit(1 << 20)) < F.lit(int((1 << 20) * SAMPLE_ROWS / n)))
    weights = fit_classifier(sample.select("label", "text"), classes, tokenizer_path)

    listed = labelled.where(F.col("label") < classes - 1).select("doc_id", "source", "label", "text")
    table = materialise(listed.mapInArrow(_memberships(tokenizer_path, weights), "doc_id long, source string, label int, n_tokens long, evidence array<float>"), "memberships").where("n_tokens > 0")

    available, rows = np.zeros(classes), np.zeros(classes, np.int64)
    for k, t, m in table.groupBy("label").agg(F.sum("n_tokens"), F.count("*")).collect():
        available[k], rows[k] = t, m
    share = np.array([s for _, s, _ in goals] + [0.0]) * (available > 0)
    share = share / share.sum() if share.sum() else share
    caps = np.array([np.inf if c is None else float(c) for _, _, c in goals] + [0.0])
    most = min((available[k] * caps[k] / share[k] for k in range(classes) if share[k] > 0), default=0.0)
    total = min(most, float(available[:-1].sum() if total_tokens is None else total_tokens))
    wanted = share * total
    table, fit = fit_rates(table, wanted, available, caps)
    _, soft = _sum_totals(table, fit)

    groups = F.array(*[F.lit(int(max(1, -(-m // ROUNDING_ROWS)))) for m in rows])
    placed = table.withColumn("place", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.col("place"), F.element_at(groups, F.col("label") + 1)))
    mixed = placed.groupBy("label", "part").applyInArrow(_round_rates(fit), "doc_id long, source string, n_tokens long, repeats int")
    plan = [(s, t, float(share[k]), c, int(available[k]), float(wanted[k]), float(soft[k] / max(soft.sum(), 1e-9))) for k, (s, t, c) in enumerate(goals)]
    return mixed, plan


def mixture_report(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The shares really reached, a row for each target: ``source, target_share, share_aimed_at, max_repeats,
    tokens_available, tokens_mixed, share_reached, share_expected, most_repeats``; the share expected is that of the domain by
    soft membership, before rates are made whole."""
    mixed, plan = mixture(documents, targets, **options)
    spark = documents.sparkSession
    aims = spark.createDataFrame(plan, "source string, target_share double, share_aimed_at double, max_repeats int, tokens_available long, tokens_wanted double, share_expected double")
    sums = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_mixed"), F.max("repeats").alias("most_repeats"))
    total = sums.agg(F.sum("tokens_mixed").alias("total"))
    return aims.join(sums, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "share_aimed_at", "max_repeats", "tokens_available",
        F.coalesce("tokens_mixed", F.lit(0)).alias("tokens_mixed"),
        F.coalesce(F.col("tokens_mixed") / F.col("total"), F.lit(0.0)).alias("share_reached"),
        "share_expected",
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
