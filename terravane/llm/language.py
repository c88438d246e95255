"""Language of whole texts by segmentation-marginalised unigrams over the pieces of a fixed public vocabulary.

Each language has a probability for every piece. A word's probability is the sum over all ways to cut it into pieces, which
the forward algorithm adds up, in logarithms; a text's is the product over its words. The pieces' probabilities are fitted by
expectation maximisation: words are counted by language on about ``FIT_DOCS`` distinct documents a language, one at least (a classifier, so
its sample is bounded; it goes by id and text, and a repeated row counts once), tasks run forward and backward over the distinct words, and
expected piece counts are summed by Spark. What reaches the driver are the counts of the pieces that each language was seen with in
its sample. Languages are fitted and scored in blocks of ``BLOCK``, so that no table is the vocabulary times all languages.

The vocabulary is a SentencePiece model's; a word begins with its mark of a word's start. Words are runs of non-space bytes
with A-Z in lower case; any byte may also stand alone at the small cost ``BYTE``, so that every word has a segmentation. Words
are learned and scored whole, whatever their length.

``und`` stands for null texts and texts without a letter, with score 0. Rows with a null doc_id are answered, held_out is null
there. Ties go to the language that sorts first. Documents without a language are not learned from. Extra columns are
ignored; an empty table gives no rows. Without any labelled row nothing is learned, and every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm.shared import annotate, batches, drop, stored
from terravane.llm.toxicity import held_out

FIT_DOCS = 600
HELD_OUT_MOD, HELD_OUT_REST = 4, 2
ROUNDS = 3
#: Pseudo-count of each piece, and the probability of a byte by itself.
SMOOTH, BYTE = 0.05, 1e-7
#: Languages whose tables are held at a time.
BLOCK = 64
MARK = "▁"
#: Words that are scored together: so many, or fewer where words times places times languages would exceed CELLS.
GROUP, CELLS = 20_000, 8_000_000
#: Longer words are scored one by one.
LONG_WORD = 2048
SLICE_BYTES = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Table:
    """Numbers of byte strings by their rolling hash: open places in a table of 2^20, collisions in a sorted list."""

    BITS = 20

    def __init__(self, strings: list[bytes]):
        hashes = np.array([_string_hash(s) for s in strings], dtype=np.uint64)
        self.hash = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.number = np.full(1 << self.BITS, -1, dtype=np.int32)
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.hash[slot[first]] = hashes[first]
        self.number[slot[first]] = first
        rest = np.setdiff1d(np.arange(len(hashes)), first)
        order = rest[np.argsort(hashes[rest])]
        self.more, self.more_number = hashes[order], order.astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.hash[slot] == h, self.number[slot], -1)
        if len(self.more):
            miss = np.flatnonzero((out < 0) & (self.number[slot] >= 0))
            at = np.minimum(np.searchsorted(self.more, h[miss]), len(self.more) - 1)
            hit = self.more[at] == h[miss]
            out[miss[hit]] = self.more_number[at[hit]]
        return out


def _roll(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return h * K.STEP + K._BYTE_VALUES[byte]


def _string_hash(s: bytes) -> np.uint64:
    h = np.zeros(1, dtype=np.uint64)
    for b in s:
        h = _roll(h, np.array([b]))
    return K.mix(h)[0]


class Vocabulary:
    """Pieces as bytes: those that begin a word (without the mark) and those inside one, numbered together; then the bare mark and the lone byte."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        starts, inner = set(), set()
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k):
                continue
            piece = model.id_to_piece(k)
            into = starts if piece.startswith(MARK) else inner
            text = piece.removeprefix(MARK)
            if text and MARK not in text:
                into.add(bytes(c + 32 if 65 <= c < 91 else c for c in text.encode()))
        self.starts, self.inner = sorted(starts), sorted(inner)
        self.start_table, self.inner_table = _Table(self.starts), _Table(self.inner)
        self.bare = len(self.starts) + len(self.inner)
        self.lone = self.bare + 1
        self.size = self.bare + 2
        self.longest = max(map(len, starts | inner))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: i (-1: from the mark), j, and of the words that have a piece from i to j: their numbers and the piece's.
Edge = tuple[int, int, np.ndarray, np.ndarray]


def lattice(v: Vocabulary, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[Edge]:
    """The edges of words sorted by descending length, in ascending order of i."""
    edges = []
    longest = int(length[0]) if len(length) else 0
    for i in range(longest):
        live = int(np.searchsorted(-length, -i, side="left"))  # length > i
        h = np.zeros(live, dtype=np.uint64)
        for j in range(i + 1, min(longest, i + v.longest) + 1):
            live = int(np.searchsorted(-length, -(j - 1), side="left"))  # length >= j
            h = _roll(h[:live], data[start[:live] + j - 1])
            mixed = K.mix(h)
            number = v.inner_table.find(mixed)
            at = np.flatnonzero(number >= 0)
            if len(at):
                edges.append((i, j, at, number[at] + len(v.starts)))
            if i == 0:
                number = v.start_table.find(mixed)
                at = np.flatnonzero(number >= 0)
                if len(at):
                    edges.append((-1, j, at, number[at]))
            if j == i + 1:
                edges.append((i, j, np.arange(live), np.full(live, v.lone)))
    return edges


def _groups(length: np.ndarray, languages: int) -> Iterator[np.ndarray]:
    """Words by descending length, in groups of bounded memory."""
    order = np.argsort(-length, kind="stable")
    k = 0
    while k < len(order):
        n = max(1, min(GROUP, CELLS // (max(1, int(length[order[k]])) * languages)))
        yield order[k : k + n]
        k += n


def word_scores(v: Vocabulary, log_p: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """log P(word) of each word and language."""
    length = end - start
    out = np.zeros((len(start), log_p.shape[1]))
    for w in np.flatnonzero(length > LONG_WORD).tolist():
        out[w] = _long_word_score(v, log_p, data[start[w] : end[w]])
    rest = np.flatnonzero(length <= LONG_WORD)
    for group in _groups(length[rest], log_p.shape[1]):
        at = rest[group]
        n = length[at]
        alpha = np.full((int(n[0]) + 1, len(at), log_p.shape[1]), -np.inf)
        alpha[0] = log_p[v.bare]
        for i, j, words, piece in sorted(lattice(v, data, start[at], n), key=lambda e: e[1]):
            alpha[j, words] = np.logaddexp(alpha[j, words], (alpha[i, words] if i >= 0 else 0.0) + log_p[piece])
        out[at] = alpha[n, np.arange(len(at))]
    return out


def _long_edges(v: Vocabulary, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, begin, piece, from the mark) of all pieces in one word, in order of their ends."""
    n = len(word)
    ends, sizes, pieces, from_mark = [np.arange(1, n + 1)], [np.ones(n, np.int64)], [np.full(n, v.lone)], [np.zeros(n, bool)]
    h = np.zeros(n, dtype=np.uint64)
    for size in range(1, min(n, v.longest) + 1):
        h = _roll(h[: n - size + 1], word[size - 1 :])
        mixed = K.mix(h)
        number = v.inner_table.find(mixed)
        at = np.flatnonzero(number >= 0)
        first = v.start_table.find(mixed[:1])
        for where, piece, mark in ((at, number[at] + len(v.starts), False), (np.flatnonzero(first >= 0), first[first >= 0], True)):
            ends.append(where + size)
            sizes.append(np.full(len(where), size))
            pieces.append(piece)
            from_mark.append(np.full(len(where), mark))
    end, size, piece, mark = map(np.concatenate, (ends, sizes, pieces, from_mark))
    order = np.argsort(end, kind="stable")
    return end[order], (end - size)[order], piece[order], mark[order]


def _forward(v: Vocabulary, log_p: np.ndarray, n: int, edges: tuple) -> np.ndarray:
    """log of the ways to each place of one word, by language: the places are walked."""
    end, source, piece, mark = edges
    first = np.searchsorted(end, np.arange(1, n + 2))
    alpha = np.full((n + 1, log_p.shape[1]), -np.inf)
    alpha[0] = log_p[v.bare]
    for j in range(1, n + 1):
        own = slice(first[j - 1], first[j])
        before = alpha[source[own]]
        if mark[own].any():
            before[mark[own]] = 0.0
        alpha[j] = np.logaddexp.reduce(before + log_p[piece[own]], axis=0)
    return alpha


def _long_word_score(v: Vocabulary, log_p: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log P of one word by language: the pieces at all places are looked up at once."""
    return _forward(v, log_p, len(word), _long_edges(v, word))[-1]


def _long_word_counts(v: Vocabulary, log_p: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Expected counts of all pieces in one word of one language (``log_p``: a column), by the same walk forward and one back."""
    n, edges = len(word), _long_edges(v, word)
    end, source, piece, mark = edges
    alpha = _forward(v, log_p[:, None], n, edges)[:, 0]
    inner = np.flatnonzero(~mark)
    inner = inner[np.argsort(source[inner], kind="stable")]
    first = np.searchsorted(source[inner], np.arange(n + 1))
    beta = np.full(n + 1, -np.inf)
    beta[n] = 0.0
    for i in range(n - 1, -1, -1):
        own = inner[first[i] : first[i + 1]]
        beta[i] = np.logaddexp.reduce(log_p[piece[own]] + beta[end[own]])
    counts = np.zeros(len(log_p))
    np.add.at(counts, piece, np.exp(np.where(mark, 0.0, alpha[source]) + log_p[piece] + beta[end] - alpha[n]))
    counts[v.bare] += np.exp(log_p[v.bare] + beta[0] - alpha[n])
    return counts


def _expected(it: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows (word, language number, count), sorted by the languages' blocks: expected counts of pieces by language."""
    v = vocabulary(model.vocabulary)
    block, log_p, totals = None, None, None

    def counted() -> pa.RecordBatch:
        piece, lang = np.nonzero(totals)
        return pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array((lang + block * BLOCK).astype(np.int32)), pa.array(totals[piece, lang])], names=["piece", "language", "n"])

    for batch in it:
        data, offsets = K.text_bytes(batch.column(0))
        language, count, length = np.asarray(batch.column(1)), np.asarray(batch.column(2), dtype=float), np.diff(offsets)
        for b in np.unique(language // BLOCK).tolist():
            if b != block:
                if totals is not None:
                    yield counted()
                block, log_p = b, model.block(b)
                totals = np.zeros_like(log_p)
            own = np.flatnonzero(language // BLOCK == b)
            short = own[length[own] <= LONG_WORD]
            for group in _groups(length[short], 1):
                at = short[group]
                _accumulate(v, data, offsets[:-1][at], length[at], log_p, language[at] - b * BLOCK, count[at], totals)
            for w in own[length[own] > LONG_WORD].tolist():
                totals[:, language[w] - b * BLOCK] += count[w] * _long_word_counts(v, log_p[:, language[w] - b * BLOCK], data[offsets[w] : offsets[w + 1]])
    if totals is not None:
        yield counted()


def _accumulate(v: Vocabulary, data: np.ndarray, start: np.ndarray, length: np.ndarray, log_p: np.ndarray, language: np.ndarray, count: np.ndarray, totals: np.ndarray) -> None:
    """Adds the expected counts of words of descending length, each of one language: forward, then backward."""
    n, edges = len(length), lattice(v, data, start, length)
    alpha, beta = (np.full((int(length[0]) + 1, n), -np.inf) for _ in range(2))
    bare = log_p[v.bare, language]
    alpha[0] = bare
    weights = [log_p[piece, language[at]] for _, _, at, piece in edges]
    for e in sorted(range(len(edges)), key=lambda e: edges[e][1]):
        i, j, at, _ = edges[e]
        alpha[j, at] = np.logaddexp(alpha[j, at], (alpha[i, at] if i >= 0 else 0.0) + weights[e])
    beta[length, np.arange(n)] = 0.0
    for e in sorted(range(len(edges)), key=lambda e: -edges[e][0]):
        i, j, at, _ = edges[e]
        if i >= 0:
            beta[i, at] = np.logaddexp(beta[i, at], beta[j, at] + weights[e])
    whole = alpha[length, np.arange(n)]
    for (i, j, at, piece), x in zip(edges, weights, strict=True):
        np.add.at(totals, (piece, language[at]), count[at] * np.exp((alpha[i, at] if i >= 0 else 0.0) + x + beta[j, at] - whole[at]))
    np.add.at(totals, (np.full(n, v.bare), language), count * np.exp(bare + beta[0] - whole))


@dataclass
class Model:
    """log P of pieces by language: ``base`` of those that a language was not seen with, and the others one language after the other."""

    languages: list[str]
    base: np.ndarray
    first: np.ndarray  # languages + 1, into the next two
    piece: np.ndarray
    log: np.ndarray
    vocabulary: str

    def block(self, b: int) -> np.ndarray:
        """The pieces times the languages of one block."""
        v = vocabulary(self.vocabulary)
        lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.languages))
        out = np.tile(self.base[lo:hi], (v.size, 1))
        own = slice(self.first[lo], self.first[hi])
        out[self.piece[own], np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))] = self.log[own]
        out[v.lone] = np.log(BYTE)
        return out

    def blocks(self) -> range:
        return range(-(-len(self.languages) // BLOCK))

    @property
    def log_p(self) -> np.ndarray:
        """All of it, for a few languages."""
        return np.concatenate([self.block(b) for b in self.blocks()], axis=1)


def _uniform(languages: list[str], path: str) -> Model:
    return Model(languages, np.full(len(languages), -np.log(vocabulary(path).size)), np.zeros(len(languages) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0), path)


def _maximised(model: Model, counted: pa.Table) -> Model:
    """The model of expected counts (piece, language, n)."""
    v = vocabulary(model.vocabulary)
    piece, language, n = (np.asarray(counted[c].combine_chunks()) for c in ("piece", "language", "n"))
    own = piece != v.lone
    piece, language, n = piece[own], language[own], n[own]
    order = np.lexsort((piece, language))
    piece, language, n = piece[order], language[order], n[order]
    totals = SMOOTH * (v.size - 1) + np.bincount(language, n, minlength=len(model.languages))
    first = np.searchsorted(language, np.arange(len(model.languages) + 1))
    return Model(model.languages, np.log(SMOOTH / totals), first, piece, np.log((n + SMOOTH) / totals[language]), model.vocabulary)


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, language) to counted words of each slice."""
    for batch in it:
        language = np.asarray(batch.column(1))
        for i, j in K.slices(batch.column(0)):
            w = K.words_of(batch.column(0).slice(i, j - i))
            key = K.mix(K.word_hashes(w) + language[i:j][w.row].astype(np.uint64) * K.STEP)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            raw = w.data.tobytes()
            text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(language[i:j][w.row[first]]), pa.array(n)], names=["word", "language", "n"])


def fit(docs: DataFrame, vocabulary_path: str | None = None, most: int = FIT_DOCS) -> Model:
    """A model from the text and non-null lang of ``docs`` (doc_id, text, lang); rows that are held out are not read."""
    batches(docs)
    path = vocabulary_path or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = rows.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id"), HELD_OUT_MOD, HELD_OUT_REST))
    train = train.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = {r["lang"]: r for r in train.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0), path)
    # the smallest hashes of each language, about ``most``, and the smallest one at least
    tops = [(name, k, max(sizes[name]["least"], int(-(2**63) + 2**64 * min(1.0, most / sizes[name]["n"])) - 1)) for k, name in enumerate(languages)]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(tops, "lang string, language int, top long"))  # a row for each language
    sample = train.join(chosen, "lang").where(F.col("h") <= F.col("top")).dropDuplicates(["language", "h"])
    words = sample.select("text", "language").mapInArrow(_words, "word string, language int, n long").groupBy("word", "language").agg(F.sum("n").alias("n"))
    # the table is small but each of its rows is work: blocks of languages are spread over the tasks
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, part = F.floor(F.col("language") / BLOCK), F.pmod(F.xxhash64("word", "language"), F.lit(max(1, 4 * n // -(-len(languages) // BLOCK))))
    words = stored(words.repartition(n, block, part).sortWithinPartitions("language"), "words")
    model = _uniform(languages, path)
    for _ in range(ROUNDS):
        shared = words.sparkSession.sparkContext.broadcast(model)  # the pieces that each language was seen with
        counted = words.sortWithinPartitions("language").mapInArrow(lambda it, s=shared: _expected(it, s.value), "piece int, language int, n double")
        model = _maximised(model, counted.groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow())
    drop(words)
    return model


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _has_letter(column: pa.Array, w: K.Words) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(_ASCII_LETTER[w.data])])
    out = run[w.offsets[1:]] > run[w.offsets[:-1]]
    for r in np.flatnonzero(~out & (np.diff(w.offsets) > 0)).tolist():
        out[r] = any(c.isalpha() for c in column[r].as_py())
    return out


_LAST: list = [None, None, None]


def _dense(m: Model, b: int) -> np.ndarray:
    """A block of the model; a worker keeps the last one."""
    if _LAST[0] is not m or _LAST[1] != b:
        _LAST[:] = [m, b, m.block(b)]
    return _LAST[2]


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text", prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the pieces that each language was seen with

    def predicted(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        if not m.languages:
            return [pa.array(["und"] * len(column), pa.string()), pa.array(np.zeros(len(column)))]
        names = np.array(m.languages, dtype=object)
        w = K.words_of(column)
        _, first, inverse = np.unique(K.word_hashes(w), return_index=True, return_inverse=True)
        sums = np.empty((len(column), len(names)))
        for b in m.blocks():
            log_p = _dense(m, b)
            each = word_scores(vocabulary(m.vocabulary), log_p, w.data, w.start[first], w.end[first])
            for k in range(log_p.shape[1]):
                sums[:, b * BLOCK + k] = K.segment_reduce(np.add, each[inverse, k], w.first, 0.0)
        # the posterior, with words counted as if a text had the square root of their number
        scaled = (sums - sums.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(np.diff(w.first), 1))[:, None]
        posterior = 1 / np.exp(scaled).sum(axis=1)
        known = _has_letter(column, w)
        return [pa.array(np.where(known, names[sums.argmax(axis=1)], "und"), pa.string()), pa.array(np.where(known, posterior, 0.0))]

    return annotate(docs, keep, text, {"lang_pred": "string", "score": "double"}, predicted, SLICE_BYTES, prefix)
