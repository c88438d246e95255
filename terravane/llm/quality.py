"""Quality rules on whole texts, and host-level verdicts from shrunken failure rates.

Each text fails or passes every rule of ``RULES``. Failures are counted by host (pre-aggregated, so a host with a third of all
rows is safe). Over the hosts, the mean m of a rule's failure rates and their variance, less what sampling adds to it, give a
beta prior by moments: its strength is m (1 - m) / variance - 1, nothing where the variance is as large as that of hosts which
always or never fail, and without bound where there is none beyond sampling. A host's rate is shrunk to (failures + m strength)
/ (documents + strength): small hosts stay near the mean. A host with a shrunken rate above ``HOST_RATE`` for any rule is
rejected, and the verdict is joined back to its documents. A document is kept if it passes the base rules and its host is not
rejected.

Null or empty texts have no words and so fail the base rules. A null host has no verdict. Repeated rows count each. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm.shared import batches, stored

# Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent
SYMBOLS = b"#*$%&|<>"
#: Per cent of symbols to characters in words, and of repeated lines, beyond which the further rules fail.
MOST_SYMBOLS, MOST_LINES = 10, 30
#: A host above this shrunken failure rate is rejected.
HOST_RATE = 0.5
#: Rejected hosts whose table may be broadcast; more are joined by a shuffle, with each host's documents spread over SALTS places.
BROADCAST_HOSTS, BROADCAST_BYTES, SALTS = 100_000, 16_000_000, 16
RULES = ["short", "repetitive", "symbols", "lines"]

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[first[1:]] - run[first[:-1]]


def _duplicates(row: np.ndarray, key: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row, how many of its keys equal an earlier one."""
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    r, k = row[order], key[order]
    again = np.zeros(len(r), dtype=bool)
    again[1:] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    return np.bincount(r[again], minlength=n_rows)


def _repeated_words(w: K.Words, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    row, key, at = K.shingles(w, hashes, 3, short=False)
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    r, k = row[order], key[order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    twice = np.zeros(len(r), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    start = at[order][twice]
    for d in range(3):
        covered[start + d] = True
    return np.bincount(w.row[covered[: len(hashes)]], minlength=n_rows)


def _measures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j in K.slices(batch.column(1)):
            part = batch.slice(i, j - i)
            n = j - i
            w = K.words_of(part.column(1), lower=False)
            hashes = K.word_hashes(w)
            ends = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte
            characters = _per_row(ends[w.end] - ends[w.start], w.first)
            newline = np.flatnonzero(w.data == 0x0A)
            starts = np.unique(np.concatenate([w.offsets[:-1], newline + 1]))
            starts = starts[starts < len(w.data)]
            stops = np.concatenate([starts[1:], [len(w.data)]]) if len(starts) else starts
            line_row = np.searchsorted(w.offsets, starts, side="right") - 1
            has_word = np.searchsorted(w.start, starts) < np.searchsorted(w.start, stops)
            stops = stops - (w.data[stops - 1] == 0x0A) if len(stops) else stops
            lines, line_row = K.range_hashes(w.data, starts[has_word], stops[has_word]), line_row[has_word]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(np.diff(w.first)),
                    pa.array(characters),
                    pa.array(_per_row(_SYMBOL[w.data], w.offsets)),
                    pa.array(_duplicates(line_row, lines, n)),
                    pa.array(_repeated_words(w, hashes, n)),
                    pa.array(np.bincount(line_row, minlength=n)),
                ],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
            )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the measures of each text and whether it fails each of RULES."""
    batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    rows = docs.mapInArrow(_measures, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    return rows.withColumns(
        {
            "short": F.col("n_words") < LEAST_WORDS,
            "repetitive": 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"),
            "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars"),
            "lines": 100 * F.col("n_dup_lines") > MOST_LINES * F.col("n_lines"),
        }
    )


def host_rates(rows: DataFrame) -> DataFrame:
    """host, documents, and for each rule the failure rate shrunk by the beta prior of all hosts."""
    counts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("documents"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    rate = {r: F.col(r) / F.col("documents") for r in RULES}
    counts = stored(counts, "hosts")
    moments = counts.agg(
        F.avg(1 / F.col("documents")).alias("noise"), *[F.avg(rate[r]).alias(f"{r}_mean") for r in RULES], *[F.var_samp(rate[r]).alias(f"{r}_var") for r in RULES]
    ).first()
    shrunk = []
    for r in RULES:
        mean, strength = moments[f"{r}_mean"] or 0.0, prior_strength(moments[f"{r}_mean"] or 0.0, moments[f"{r}_var"] or 0.0, moments["noise"] or 1.0)
        rate_r = F.lit(mean) if strength == float("inf") else (F.col(r) + mean * strength) / (F.col("documents") + strength)
        shrunk.append(rate_r.alias(f"{r}_rate"))
    return counts.select("host", "documents", *shrunk)


def prior_strength(mean: float, variance: float, noise: float) -> float:
    """The beta prior's a + b, from hosts' rates (mean, sample variance) and the mean of 1 / documents.

    A rate's variance is V + (m (1 - m) - V) / documents, with V that of the hosts' true rates.
    """
    spread = mean * (1 - mean)
    true = (variance - spread * noise) / (1 - noise) if noise < 1 else 0.0
    return float("inf") if true <= 0 else max(0.0, spread / true - 1)


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rejected of every row of ``docs`` (doc_id, text, host)."""
    rows = stored(measured(docs, host), "measures")
    hosts = stored(host_rates(rows).select("host", (F.greatest(*[F.col(f"{r}_rate") for r in RULES]) > HOST_RATE).alias("host_rejected")), "hosts")
    rejected = hosts.where("host_rejected")
    n, size = rejected.agg(F.count("*"), F.sum(F.octet_length("host").cast("long"))).first()
    if n <= BROADCAST_HOSTS and (size or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(rejected), "host", "left")
    else:
        salted = rejected.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).hint("merge").join(salted, ["host", "salt"], "left")
    base_failed = F.col("short") | F.col("repetitive")
    host_rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~host_rejected).alias("kept"), host_rejected.alias("host_rejected"))
