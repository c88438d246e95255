"""Ids of whole texts by a fixed byte-level BPE, a batch at a time.

The tokenizer's splitting rule never joins characters across a space that follows a character which is no white space: a
piece ends there, and the next one starts with that space. So a text is cut at these spaces, the tokenizer encodes each
distinct cut once, and the ids of a text are those of its cuts end to end. In natural text a few words make up most of it,
which saves most of the encoding; the ids are the same (a test holds them against encoding whole texts).
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Distinct cuts and pieces of cuts that a worker remembers: bounds its memory.
MEMORY, PIECES = 300_000, 800_000
#: White space of any kind before a space.
_SPACE_BEFORE_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] |^ "
_CUT = re.compile(r"(?<=\S) ")
#: Bytes of texts that are encoded at a time.
SLICE_BYTES = 8_000_000
#: In cuts of these characters alone the tokenizer's splitting rule needs no Unicode tables; other cuts are encoded whole.
_PLAIN = re.compile(r"[ -~\n\tÀ-ÖØ-öø-ɏ]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else the next from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes batches of texts; the string of a special token inside a text becomes its id, as the library does it, unless ``special`` is false."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        strings = []
        for token in self._tokenizer.get_added_tokens_decoder().values():
            if not token.special or special:
                if token.lstrip or token.rstrip or token.single_word or re.search(r"\s", token.content):
                    raise ValueError(f"texts can't be cut beside the token {token.content!r}")
                strings.append(re.escape(token.content))
        self._special = re.compile("|".join(strings) or "(?!)")
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._pieces: dict[str, bytes] = {}  # their ids, 32 bits each
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._ids = array("I")
        self._ends = array("q", [0])

    def _encode_piece(self, piece: str) -> bytes:
        found = array("I", [t.id for t in self._model.tokenize(piece.encode().decode("latin-1").translate(self._letters))]).tobytes()
        if len(self._pieces) >= PIECES:
            self._pieces.clear()
        self._pieces[piece] = found
        return found

    def _learn(self, cuts: list[str]) -> None:
        known, ids, ends = self._pieces, self._ids, self._ends
        for cut in cuts:
            if (found := known.get(cut)) is not None:  # the whole cut is one piece
                ids.frombytes(found)
            elif _PLAIN.fullmatch(cut) and not self._special.search(cut):
                for piece in _PIECE.findall(cut):
                    ids.frombytes(known.get(piece) or self._encode_piece(piece))
            else:
                ids.extend(self._tokenizer.encode(cut, add_special_tokens=False).ids)
            ends.append(len(ids))
            self._number[cut] = len(self._number)

    def _numbers(self, words: pa.Array, used: np.ndarray, prefix: str) -> np.ndarray:
        """For the ``used`` ones of the distinct ``words``, the number of prefix + word among the known cuts."""
        at = np.flatnonzero(used)
        cuts = [prefix + w for w in words.take(pa.array(at)).to_pylist()]
        self._learn([c for c in cuts if c not in self._number])
        out = np.zeros(len(words), dtype=np.int64)
        out[at] = np.fromiter(map(self._number.__getitem__, cuts), dtype=np.int64, count=len(cuts))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each followed by END_ID, and the n + 1 offsets; a null is empty."""
        if len(self._number) > MEMORY:
            self._forget()
        column = column.fill_null("").cast(pa.large_string())
        lists = pc.split_pattern(column, " ")
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(column, _SPACE_BEFORE_SPACE)))
        if len(odd):  # a cut before each of these spaces would be wrong
            split = lists.to_pylist()
            for k in odd:
                split[k] = _CUT.split(column[k].as_py())
            lists = pa.array(split, pa.large_list(pa.large_string()))
        counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        indices, words = np.asarray(coded.indices), coded.dictionary
        ends_of = np.cumsum(counts)
        leads = np.zeros(len(indices), dtype=bool)
        leads[(ends_of - counts)[counts > 0]] = True
        used = [np.zeros(len(words), dtype=bool) for _ in range(2)]
        used[0][indices[leads]] = used[1][indices[~leads]] = True
        where = np.where(leads, self._numbers(words, used[0], "")[indices], self._numbers(words, used[1], " ")[indices])

        known, ends = np.frombuffer(self._ids, dtype=np.uint32) if self._ids else np.zeros(0, np.uint32), np.frombuffer(self._ends, dtype=np.int64)
        starts, lengths = ends[where], ends[where + 1] - ends[where]
        run = np.concatenate([[0], np.cumsum(lengths)])
        per_text = run[ends_of] - run[ends_of - counts]
        offsets = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.empty(int(offsets[-1]), dtype=np.uint32)
        out[offsets[1:] - 1] = END_ID
        inside = np.ones(len(out), dtype=bool)
        inside[offsets[1:] - 1] = False
        out[inside] = known[np.repeat(starts - run[:-1], lengths) + np.arange(int(run[-1]))]
        del known, ends  # else the arrays could not grow
        return out, offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a worker and file."""
    return Encoder(path)


def id_bytes(path: str) -> int:
    """2 if all ids of the tokenizer's file fit in 16 bits, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(END_ID, *Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else 4
