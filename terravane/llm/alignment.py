"""Alignment of two tokenizers' tokens of the same texts, over Arrow tables.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model, which puts a space before each text; A gets that space
too. A token's end is the number of its text's bytes up to it. Where tokens of A and of B end at the same byte, both are cut into
groups; two tokens are linked if their bytes overlap. Every byte at which any token ends closes exactly one overlap, so the links of
a text are the distinct ends of its tokens.

A slice of whole texts is worked on at a time: its token lists are flattened beside their parents' indices, bytes are summed
up within each parent, and one Acero hash join of both sides on the key (document, end), full outer, gives the links; the side
that does not end there is the next token that does. ``Table.group_by`` counts the slice's pairs, and Spark adds the slices' counts.

The slices' rows are stored: what is known of each text, the number of each link's pair among the slice's pairs, and these pairs
with their counts. Counts go back to slices by a join on the pair: a slice asks once for a pair, so that no pair, however
frequent, has more than one row for each slice. Each slice then looks its links up.

Texts that are null or empty, or that one of the tokenizers doesn't give back byte for byte, have no tokens: zeros and an empty
digest. Rows with a null doc_id and repeated rows are texts like others, counted each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm.shared import batches, drop, stored
from terravane.llm.tokens import _byte_letters, default_tokenizer

#: Bytes of texts of a slice; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Distinct cuts of texts whose tokens a worker remembers: bounds its memory.
CUTS = 300_000
#: Cuts that are encoded in one call.
LEARNT = 5_000
#: A cut ends before a space behind another character: pieces of both vocabularies begin with spaces or have none (checked).
_CUT = re.compile(r"(?<=\S) ")
_CODEC = "zstd"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, and the tokens of the cuts that a worker knows."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self._a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        if bad := [p for p in pieces if re.search("[^▁]▁", p)]:
            raise ValueError(f"texts can't be cut at spaces: {bad[:3]}")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        a_most = max(self.a_bytes) + 1
        self.a_lengths = pa.array([len(self.a_bytes.get(i, b"")) for i in range(a_most)], pa.int64())
        self.b_lengths = pa.array([len(p) for p in self.b_bytes], pa.int64())
        # decimal numbers with each separator behind them, one array for each: "," inside a side, "|" between sides, ";" between groups
        self.most = max(a_most, len(pieces))
        self.written = pa.array([f"{i}{s}" for s in ",|;" for i in range(self.most)], pa.string())
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._ids, self._ends = (array("I"), array("I")), (array("q", [0]), array("q", [0]))
        self._same = array("b")

    def _learn(self, cuts: list[str]) -> None:
        for at in range(0, len(cuts), LEARNT):
            some = cuts[at : at + LEARNT]
            of_a = [e.ids for e in self._a.encode_batch_fast(some, add_special_tokens=False)]
            of_b = self._b.encode([c[1:] for c in some], num_threads=1)
            for k in [k for k, c in enumerate(some) if len(c) == 1]:
                of_b[k] = [self._b.piece_to_id("▁")]  # a last space
            raw, a_bytes, b_bytes = list(map(str.encode, some)), self.a_bytes.__getitem__, self.b_bytes.__getitem__
            self._same.extend([b"".join(map(b_bytes, b)) == r and b"".join(map(a_bytes, a)) == r for a, b, r in zip(of_a, of_b, raw, strict=True)])
            for side, lists in enumerate((of_a, of_b)):
                first = len(self._ids[side])
                self._ids[side].extend(chain.from_iterable(lists))
                self._ends[side].extend(islice(accumulate(map(len, lists), initial=first), 1, None))
            self._number.update(zip(some, range(len(self._number), len(self._number) + len(some))))

    @staticmethod
    def _cuts(text: str | None) -> list[str]:
        first, *rest = _CUT.split(f" {text}") if text else [None]
        return [first, *(" " + c for c in rest)] if text else []

    def lists(self, column: pa.Array) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """The ids of A and of B of each text, none where its bytes don't come back."""
        if len(self._number) > CUTS:
            self._forget()
        known, where, counts, of_texts = self._number, array("q"), [], []
        for text in column:
            text = text.as_py()
            of_texts.append([" " + c for c in _CUT.split(text)] if text and not text.startswith(" ") else self._cuts(text))
        self._learn(list({c: None for cuts in of_texts for c in cuts if c not in known}))
        for cuts in of_texts:
            own = [known[c] for c in cuts]
            if all(map(self._same.__getitem__, own)):
                where.extend(own)
                counts.append(len(own))
            else:
                counts.append(0)
        at, firsts = np.frombuffer(where, np.int64) if where else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        out = []
        for ids, ends in zip(self._ids, self._ends):
            ids_, ends_ = np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32), np.frombuffer(ends, np.int64)
            starts, lengths = ends_[at], ends_[at + 1] - ends_[at]
            run = np.concatenate([[0], np.cumsum(lengths)])
            values = ids_[np.repeat(starts - run[:-1], lengths) + np.arange(int(run[-1]))].astype(np.int32)
            out.append(pa.LargeListArray.from_arrays(pa.array(run[firsts], pa.int64()), pa.array(values)))
            del ids_, ends_  # else the arrays could not grow
        return out[0], out[1]


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def ends(tokens: pa.LargeListArray, lengths: pa.Array, name: str) -> pa.Table:
    """(document, end, ``name``: the id) of every token: its text's place in the slice, and the text's bytes up to its end."""
    ids, document = tokens.flatten(), pc.list_parent_indices(tokens)
    run = pc.cumulative_sum(lengths.take(ids))
    per_text = np.diff(np.asarray(tokens.offsets))
    before = np.concatenate([[0], np.asarray(run)])[np.asarray(tokens.offsets)[:-1]]  # of all texts before, taken off again
    end = pc.subtract(run, pa.array(np.repeat(before, per_text)))
    return pa.table({"document": document.cast(pa.int64()), "end": end, name: ids})


def links_of(a: pa.Table, b: pa.Table) -> pa.Table:
    """(document, end, a, b, both) of every link, in order; ``both``: tokens of both sides end there, so a group does."""
    joined = a.join(b, keys=["document", "end"], join_type="full outer").sort_by([("document", "ascending"), ("end", "ascending")])
    both = pc.and_(pc.is_valid(joined["a"]), pc.is_valid(joined["b"]))
    # the last end of a text is of both sides, so nothing is filled from the next text
    return pa.table({"document": joined["document"], "end": joined["end"], "a": pc.fill_null_backward(joined["a"]), "b": pc.fill_null_backward(joined["b"]), "both": both}).combine_chunks()


def _groups_digests(own: Pair, a: pa.Table, b: pa.Table, links: pa.Table, n: int) -> list[str]:
    """The SHA-256 of each text's groups as text: ids of A by commas, a bar, ids of B by commas, semicolons between groups."""
    closed = links.filter(links["both"])
    place = lambda t: np.asarray(t["document"]) << np.int64(40) | np.asarray(t["end"])
    borders = place(closed)
    group = [np.searchsorted(borders, place(t)) for t in (a, b)]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    side, number = np.repeat([0, 1], [len(a), len(b)])[order], np.concatenate(group)[order]
    ids, document = np.concatenate([np.asarray(a["a"]), np.asarray(b["b"])])[order], np.concatenate([np.asarray(a["document"]), np.asarray(b["document"])])[order]
    last = np.ones(len(ids), dtype=bool)
    last[:-1] = (number[1:] != number[:-1]) | (side[1:] != side[:-1])
    text = own.written.take(pa.array(np.where(last, 1 + side, 0) * own.most + ids))
    data, offsets = K.text_bytes(text)
    firsts = offsets[np.searchsorted(document, np.arange(n + 1))]
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(firsts.tolist(), firsts[1:].tolist())]  # no separator at the end


_SLICE = "slice long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, links binary, pairs array<struct<a: int, b: int, n: long>>"


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each slice: its texts' results, their links' pairs one after the other as numbers in ``pairs`` (unsigned 32-bit, compressed), and the pairs with their counts there."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        number = TaskContext.get().partitionId() << 33
        for batch in it:
            for i, j in K.slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(i, j - i)
                a_lists, b_lists = own.lists(part.column(1))
                a, b = ends(a_lists, own.a_lengths, "a"), ends(b_lists, own.b_lengths, "b")
                links = links_of(a, b)
                count = lambda t: np.bincount(np.asarray(t["document"]), minlength=len(part))
                key = pa.array(np.asarray(links["a"]).astype(np.int64) << 32 | np.asarray(links["b"])).dictionary_encode()
                counted = pa.table({"pair": key.indices}).group_by("pair").aggregate([([], "count_all")]).sort_by("pair")  # all numbers of the dictionary, in order
                pairs = np.asarray(key.dictionary)
                row = {
                    "slice": [number],
                    "doc_ids": [part.column(0).to_pylist()],
                    **{name: [count(t)] for name, t in (("n_a", a), ("n_b", b), ("n_groups", links.filter(links["both"])), ("n_links", links))},
                    "digests": [_groups_digests(own, a, b, links, len(part))],
                    "links": [pa.compress(np.asarray(key.indices).astype("<u4").tobytes(), codec=_CODEC, asbytes=True)],
                }
                struct = pa.StructArray.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), counted["count_all"].combine_chunks()], names=["a", "b", "n"])
                kinds = {"slice": pa.int64(), "doc_ids": pa.list_(pa.int64()), "digests": pa.list_(pa.string()), "links": pa.binary()} | {c: pa.list_(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
                columns = [pa.array(v, kinds[c]) for c, v in row.items()] + [pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)]
                yield pa.RecordBatch.from_arrays(columns, names=[*row, "pairs"])
                number += 1
        pa.default_memory_pool().release_unused()

    return batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SLICE)


def pair_counts(slices: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links of all texts hold the two ids linked, and whether no other a has more with this b."""
    counts = slices.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))  # at most A's vocabulary for each b


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Aligns the texts of ``docs``. Returns a row for each text (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the ``pair_counts``, stored."""
    slices = stored(_aligned(docs, a_path or default_tokenizer(), b_path or default_pieces()), "slices")
    counts = stored(pair_counts(slices), "pairs")
    asked = slices.select("slice", F.posexplode("pairs").alias("at", "p")).select("slice", "at", "p.a", "p.b")
    told = asked.hint("merge").join(counts.hint("merge"), ["a", "b"]).groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("told"))  # a slice's pairs: bounded by its bytes
    joined = slices.drop("pairs").hint("merge").join(told.hint("merge"), "slice", "left")

    def looked_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                flat = lambda name: row.column(name).flatten()  # noqa: E731, B023
                n_links = np.asarray(flat("n_links"))
                firsts = np.concatenate([[0], np.cumsum(n_links)])
                sums = {"n_best": np.zeros(len(firsts), np.int64), "count_sum": np.zeros(len(firsts), np.int64)}
                if firsts[-1]:
                    links = np.frombuffer(pa.decompress(row.column("links")[0].as_py(), decompressed_size=4 * int(firsts[-1]), codec=_CODEC, asbytes=True), "<u4")
                    told = flat("told")
                    for name, field in (("n_best", "best"), ("count_sum", "n")):
                        values = told.field(field).cast(pa.int64()).take(pa.array(links))
                        sums[name] = np.concatenate([[0], np.asarray(pc.cumulative_sum(values))])[firsts]
                    sums = {k: np.diff(v) for k, v in sums.items()}
                else:
                    sums = {k: v[1:] for k, v in sums.items()}
                yield pa.RecordBatch.from_arrays(
                    [flat("doc_ids"), flat("n_a"), flat("n_b"), flat("n_groups"), flat("n_links"), pa.array(sums["n_best"]), pa.array(sums["count_sum"]), flat("digests")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                )

    out = joined.mapInArrow(looked_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out, counts
