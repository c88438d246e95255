"""Toxicity of whole texts: maximum-scoring segments of token log-odds, with extreme-value calibration.

Fitting, on at most about ``FIT_ROWS`` labelled documents (those of the smallest hashes if there are more; a classifier, so its
sample is bounded): each word's log-odds between toxic and other documents with a Dirichlet prior that follows the words'
overall frequencies. Words whose log-odds are ``LEAST_Z`` standard errors above nothing carry them, less ``TAKEN_OFF`` standard
errors, as positive scores, so that a word needs evidence for a high score; every other word costs the drift, which is ``DRIFT`` or as much more as makes a clean word's mean score negative. One linear scan
finds all maximal segments of a text. The extreme-value law of such scores under the clean words' distribution (Karlin and
Altschul) gives lambda and K, so that a segment of score S in n words has lambda * S - ln(K * n) as its calibrated strength;
segments of positive strength are the text's toxic passages. The strengths of all of them together go through a logistic curve.
The curve is cross-fitted: the sample is halved by a hash of the text, and each half is scored with the log-odds of the other,
so that it sees words as a new document has them. The final log-odds come from the whole sample.

Null or empty texts have no passages and the score of a text without any. Rows with a null doc_id are scored, held_out is
null there. Labels that contradict each other for one doc_id: any toxic one counts. Extra columns are ignored; an empty
table gives no rows. Without labelled rows of both kinds nothing can be told apart: the model has no words and all scores are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm.shared import annotate, batches, drop, stored

FIT_ROWS = 60_000
HELD_OUT_MOD, HELD_OUT_REST = 5, 0
#: Total pseudo-count of the prior, as a share of all counts.
PRIOR_SHARE = 0.1
#: Standard errors that a word's log-odds must be above 0, and that are taken off them as its score.
LEAST_Z, TAKEN_OFF = 2.6, 1.0
LEAST_COUNT = 3
DRIFT = 0.25
#: A clean word costs at least this on average.
MEAN_COST = 0.05
#: Scores are laid on a lattice of this width to work out K, by the first terms of its series.
LATTICE, TERMS = 0.05, 40


def held_out(doc_id: Column, mod: int = HELD_OUT_MOD, rest: int = HELD_OUT_REST) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod == rest


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    scores: np.ndarray
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = -math.inf


def _bounded(labels: DataFrame, most: int) -> DataFrame:
    """Rows of the smallest hashes of doc_id, about ``most`` at most."""
    n = labels.count()
    if n <= most:
        return labels
    top = int(-(2**63) + 2**64 * 0.98 * most / n)
    return labels.where(F.xxhash64("doc_id") < F.lit(top))


def _contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label, half) to the distinct (word, context, kind) of each slice; a context is the words before and after, in one hash of 32 bits."""
    for batch in it:
        label, half = (np.asarray(batch.column(k)) for k in (1, 2))
        for i, j in K.slices(batch.column(0)):
            w = K.words_of(batch.column(0).slice(i, j - i), K.ALNUM)
            h = K.word_hashes(w)
            before, after = np.zeros_like(h), np.zeros_like(h)
            inner = np.flatnonzero(w.row[1:] == w.row[:-1]) if len(h) else np.zeros(0, np.int64)
            before[inner + 1], after[inner] = h[inner], h[inner + 1]
            context = (K.mix(before * K.STEP + K.mix(after + np.uint64(1))) >> np.uint64(32)).astype(np.uint32)
            kind = label[i:j] + 2 * half[i:j]
            _, first = np.unique(K.mix(h * K.STEP + context.astype(np.uint64)) + kind[w.row].astype(np.uint64), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(context[first].view(np.int32)), pa.array(kind[w.row[first]].astype(np.int8))], names=["word", "context", "kind"])


def log_odds(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """(word, delta, z) of words by their counts (word, y1, y0) among n1 and n0 in all."""
    prior = (F.col("y1") + F.col("y0")) * PRIOR_SHARE
    total = (n1 + n0) * PRIOR_SHARE
    side = lambda y, n: F.log((y + prior) / (n + total - y - prior))
    delta = side(F.col("y1"), n1) - side(F.col("y0"), n0)
    error = F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
    return counts.select("word", "y1", "y0", delta.alias("delta"), (delta / error).alias("z"))


def _extreme_value(scores: np.ndarray, frequency: np.ndarray) -> tuple[float, float]:
    """lambda and K of a word's scores with these frequencies, whose mean is negative.

    lambda is the positive root of sum p * exp(lambda * s) = 1. K is
    lambda * d * exp(-2 * sum over k of (E[exp(lambda * S_k); S_k < 0] + P(S_k >= 0)) / k) / ((1 - exp(-lambda * d)) * E[s * exp(lambda * s)])
    with S_k the sum of k scores on the lattice of width d.
    """
    if not (scores > 0).any():
        return 1.0, 1.0
    lattice = np.round(scores / LATTICE).astype(np.int64)
    low, high = int(lattice.min()), int(lattice.max())
    step = np.bincount(lattice - low, weights=frequency) / frequency.sum()
    at = np.arange(low, high + 1) * LATTICE
    value = lambda x: float((step * np.exp(np.minimum(x * at, 500))).sum()) - 1
    lo, hi = 0.0, 1.0
    while value(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    while not lo and value(hi / 2) > 0 and hi > 1e-6:
        hi /= 2
    lo = lo or hi / 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    lam = (lo + hi) / 2
    series, sums = 0.0, np.ones(1)
    for k in range(1, TERMS + 1):
        sums = np.convolve(sums, step)
        s = (np.arange(len(sums)) + k * low) * LATTICE
        series += float((sums * np.exp(lam * np.minimum(s, 0.0))).sum()) / k
    tilted = float((step * at * np.exp(lam * at)).sum())
    k = lam * LATTICE * math.exp(-2 * series) / ((1 - math.exp(-lam * LATTICE)) * max(tilted, 1e-9))
    return lam, min(1.0, max(k, 1e-9))


def maximal_segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [i, j) with their scores, in one linear pass (Ruzzo and Tompa).

    Each segment links to the nearest earlier one with a smaller sum before it; a search jumps along the links, so the
    segments between are passed once only.
    """
    start: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    link: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        a, low = i, before
        at = len(start) - 1
        while True:
            while at >= 0 and left[at] >= low:
                at = link[at]
            if at < 0 or right[at] >= total:
                break
            a, low, at, n = start[at], left[at], link[at], at
            del start[n:], end[n:], left[n:], right[n:], link[n:]
        start.append(a)
        end.append(i + 1)
        left.append(low)
        right.append(total)
        link.append(at)
    return [(a, b, r - x) for a, b, x, r in zip(start, end, left, right, strict=True)]


def _occurrence(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """1 for the first time that a row has a word, 2 for the second, and so on: the n-th scores an n-th, so repetition alone makes no passage strong."""
    order = np.lexsort((np.arange(len(row)), word, row))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (word[order][1:] != word[order][:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(row), dtype=np.int64)
    out[order] = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
    return out


def _strengths(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, float]]]:
    """Of each text: the sum of its passages' strengths and their number; and the passages (row, first word, end, strength)."""
    w = K.words_of(column, K.ALNUM)
    hashes = K.word_hashes(w)
    n_rows = len(column)
    sums, passages = np.zeros(n_rows), []
    if not len(model.hashes) or not len(hashes):
        return sums, np.zeros(n_rows, dtype=np.int64), passages
    at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
    hit = np.flatnonzero(model.hashes[at] == hashes)
    scores = model.scores[at[hit]] / _occurrence(w.row[hit], at[hit])
    n_words = np.diff(w.first)
    cuts = np.searchsorted(w.row[hit], np.arange(n_rows + 1))
    number = np.zeros(n_rows, dtype=np.int64)
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        where, own = hit[cuts[r] : cuts[r + 1]], scores[cuts[r] : cuts[r + 1]]
        steps, starts = [], []
        last = None
        for x, s in zip(where.tolist(), own.tolist(), strict=True):
            if last is not None and x - last > 1:  # the words between cost alike: one step for all of them
                steps.append(-model.drift * (x - last - 1))
                starts.append(last + 1)
            steps.append(s)
            starts.append(x)
            last = x
        starts.append(last + 1)
        for a, b, score in maximal_segments(steps):
            strength = model.lam * score - math.log(model.k * n_words[r])
            if strength > 0:
                sums[r] += strength
                number[r] += 1
                passages.append((r, starts[a] - int(w.first[r]), starts[b] - int(w.first[r]), strength))
    return sums, number, passages


_KINDS = ["a0", "a1", "b0", "b1"]


def _words_model(counts: DataFrame, y1: str, y0: str, n1: int, n0: int) -> Model:
    """Words, scores and their extreme-value law from counts (word, y1, y0 as expressions) of n1 toxic and n0 other words."""
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    counts = counts.select("word", F.expr(y1).alias("y1"), F.expr(y0).alias("y0")).where("y1 + y0 > 0")
    odds = log_odds(counts, n1, n0).where((F.col("z") >= LEAST_Z) & (F.col("y1") >= LEAST_COUNT) & (F.col("delta") > 0))
    rows = odds.collect()  # words of at least LEAST_COUNT contexts of the bounded sample
    words = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    scores = np.array([r["delta"] * (1 - TAKEN_OFF / r["z"]) for r in rows], dtype=float)
    frequency = (np.array([r["y0"] for r in rows], dtype=float) + 0.5) / n0
    rest = max(1e-3, 1 - frequency.sum())
    drift = max(DRIFT, (float((frequency * scores).sum()) + MEAN_COST) / rest)
    lam, k = _extreme_value(np.append(scores, -drift), np.append(frequency, rest))
    order = np.argsort(words)
    return Model(words[order], scores[order], drift, lam, k)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); rows that are held out are not read."""
    batches(docs)
    doc_id = F.col("doc_id").cast("long")
    train = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    train = train.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most about FIT_ROWS rows of two numbers are broadcast
    labelled = stored(_bounded(train, most), "labels")
    text = F.col("text").cast("string")
    texts = docs.select(doc_id.alias("doc_id"), text.alias("text")).join(F.broadcast(labelled), "doc_id")
    texts = stored(texts.select("text", (F.col("toxic") > 0).cast("long").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")), "labelled")
    # a copy of a text adds no contexts, so groups of copies don't make words look frequent
    contexts = texts.mapInArrow(_contexts, "word long, context int, kind byte").distinct()
    counts = contexts.groupBy("word").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(c) for k, c in enumerate(_KINDS)])
    counts = stored(counts, "counts")
    n = {c: x or 0 for c, x in counts.agg(*[F.sum(c).alias(c) for c in _KINDS]).first().asDict().items()}
    documents = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    model = _words_model(counts, "a1 + b1", "a0 + b0", n["a1"] + n["b1"], n["a0"] + n["b0"])
    halves = [_words_model(counts, f"{o}1", f"{o}0", n[f"{o}1"], n[f"{o}0"]) for o in "ba"]  # of the other half

    def strengths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            half = np.asarray(batch.column(2))
            for i, j in K.slices(batch.column(0)):
                part = batch.slice(i, j - i)
                both = [_strengths(part.column(0), m)[0] for m in halves]
                yield pa.RecordBatch.from_arrays([pa.array(np.round(np.where(half[i:j] == 0, *both), 2)), part.column(1)], names=["x", "toxic"])

    if len(model.hashes):
        histogram = texts.mapInArrow(strengths, "x double, toxic long").groupBy("x", "toxic").count().collect()  # of the bounded sample
        x, y, m = (np.array([r[c] for r in histogram], dtype=float) for c in ("x", "toxic", "count"))
        model.slope, model.intercept = _logistic(_squeezed(x), y, m)
    elif len(documents) == 2:
        model.intercept = math.log(documents[1] / documents[0])
    drop(texts, counts, labelled)
    return model


def _squeezed(x: np.ndarray) -> np.ndarray:
    """What the logistic curve takes: strengths of one passage and of many are to be comparable."""
    return np.log1p(x)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a weighted logistic curve with a small ridge, by Newton steps."""
    b = np.zeros(2)
    ridge = np.diag([1e-2, 1e-2])
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (n * (y - p)) - ridge @ b
        step = np.linalg.solve(z.T @ (z * (n * p * (1 - p))[:, None]) + ridge, gradient)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(b[0])), float(b[1])


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text", prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with score, predicted, n_passages and passages (first word, end, strength)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample
    passage = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("strength", pa.float64())]))

    def scored(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        sums, number, found = _strengths(column, m)
        lists: list[list] = [[] for _ in range(len(column))]
        for r, a, b, s in found:
            lists[r].append({"first_word": a, "end_word": b, "strength": s})
        p = 1 / (1 + np.exp(-np.clip(m.slope * _squeezed(sums) + m.intercept, -50, 50))) if m.intercept > -math.inf else np.zeros(len(column))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(number), pa.array(lists, passage)]

    results = {"score": "double", "predicted": "int", "n_passages": "long", "passages": "array<struct<first_word:long,end_word:long,strength:double>>"}
    return annotate(docs, keep, text, results, scored, K.SLICE_BYTES, prefix)
