"""Encoding and decoding by a tokenization automaton.

``compile_merges`` reads a vocabulary's merges in their order, and builds a deterministic automaton over tokens whose paths are
exactly the tokenizations that merging would leave. It begins with one state per symbol and an arc for every symbol out of every
state. The gadget of a merge (a, b) does three things at once:

- every state with an arc ``a`` to a state that has an arc ``b`` gets an arc ``ab``, to the state that the path a, b leads to;
- the state behind ``a`` is split: as reached by ``a`` it has no arc ``b`` from now on;
- the states behind longer tokens that were made of paths through it before keep their arc ``b``.

So the state behind a token is the state behind its right part as it was when the token was made, less the arcs that later gadgets
took away. States are therefore stored as what gadgets took from them: a state lists (arc, number of the merge), and the state that
it was split from with the number up to which that one's list holds. An arc ``t`` is there unless one of the tokens that it begins
with was taken before the next longer one was made. A merge whose path is not there makes a token that no text can have.

A pre-split word is encoded from left to right: a table of symbols gives the tokens that begin at a place, and the longest one is taken
whose arc leaves the state that was reached. Where none is left, the place leads nowhere, and the walk goes one arc back to the next
shorter token. A prefix of a word has one path at most, so a place that led nowhere needs no second look. Arcs are kept in a
table once they are worked out. Decoding walks the arcs and emits their labels, which the tokenizer joins with a space, as it has no decoder.

Words are split, lower-cased and put in byte letters by the tokenizer's own rules (cuts of ASCII and Latin-1 letters by the same ones
without Unicode's tables); strings of its special tokens are ids. A worker remembers up to ``WORDS`` distinct words and as many cuts between spaces.

A null or empty text has no ids. Nulls in other columns, repeated rows and extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terravane.llm.shared import annotate
from terravane.llm.tokens import _byte_letters

#: Distinct cuts and arcs that a worker remembers: bounds its memory.
WORDS, ARCS = 300_000, 1_000_000
#: Bytes of texts of one slice.
SLICE_BYTES = 2_000_000
#: Characters of a long text that are cut at a time.
STRETCH = 1 << 18
#: The splitting rule, and what it finds in cuts without other letters, digits and white space than these.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[!-~\n\tÀ-ÖØ-öø-ÿ]*")
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_LETTERS = _byte_letters()
NONE = -1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Automaton:
    """States and arcs are tokens, numbered as made: symbols first, then merges in their order. ``START`` has every arc that lives."""

    def __init__(self, symbols: list[str]):
        self.labels = list(symbols)
        self.first = len(symbols)  # token first + r is that of merge r
        self.left = [NONE] * len(symbols)
        self.right = [NONE] * len(symbols)
        self.alive = [True] * len(symbols)
        self.taken: list[dict[int, int]] = [{} for _ in symbols]  # from each state: arc -> number of the merge
        self.number = {s: k for k, s in enumerate(symbols)}

    def gadget(self, a: int, b: int) -> int:
        """The gadget of the next merge. Returns the token that it makes."""
        made = len(self.labels)
        label = self.labels[a] + self.labels[b]
        if label in self.number:
            raise ValueError(f"{label!r} is made by two merges")
        lives = self.alive[a] and self.alive[b] and self.arc(a, b)
        self.taken[a][b] = made
        self.labels.append(label)
        self.left.append(a)
        self.right.append(b)
        self.alive.append(lives)
        self.taken.append({})
        self.number[label] = made
        return made

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has the arc. Both go down: the state to those it was split from, the arc to the tokens that it begins with."""
        holds_to = len(self.labels)  # what a state's list says counts up to this number
        while state != NONE:
            taken = self.taken[state]
            if taken:
                part, next_longer = token, len(self.labels)
                while part != NONE:
                    # equal numbers: the merge that took the arc is the one that made the longer token, so the path began one place earlier and was merged first
                    if (at := taken.get(part)) is not None and at < holds_to and at <= next_longer:
                        return False
                    part, next_longer = self.left[part], part
            holds_to, state = state, self.right[state]
        return True


def compile_merges(vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> tuple[Automaton, list[int]]:
    """The automaton, and the tokenizer's id of each of its tokens."""
    made = {a + b for a, b in merges}
    automaton = Automaton([t for t in vocabulary if t not in made])
    for a, b in merges:
        if a not in automaton.number or b not in automaton.number:
            raise ValueError(f"the merge of {a!r} and {b!r} comes before one that makes them")
        automaton.gadget(automaton.number[a], automaton.number[b])
    return automaton, [vocabulary[t] for t in automaton.labels]


class Codec:
    """Encodes and decodes by the automaton of a tokenizer's file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or any(model.get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) or told["decoder"] or told["post_processor"]:
            raise ValueError("the automaton is for plain merges without a decoder")
        for token in told["added_tokens"]:
            if token["normalized"] or token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"texts can't be cut at the token {token['content']!r}")
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton, self.ids = compile_merges(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.labels = {i: label for label, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        rules = Tokenizer.from_file(path)
        self._normalize, self._split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self._grow()
        # the rules below are those of this file, for cuts of the characters that they name
        steps = [r["type"] for r in (told["normalizer"] or {}).get("normalizers", [])]
        first = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self._plain = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == _SPLIT
        self._words: dict[str, bytes] = {}
        self._cuts: dict[str, bytes] = {}
        self._arcs: dict[int, bool] = {}

    def _grow(self) -> None:
        """The table of the living tokens by their symbols, and for each token the longest one that it begins with."""
        a = self.automaton
        spelled: list[tuple[int, ...]] = []
        for t in range(len(a.labels)):
            spelled.append((t,) if a.left[t] == NONE else spelled[a.left[t]] + spelled[a.right[t]])
        self.lengths = [len(s) for s in spelled]
        self.next: list[dict[str, int]] = [{}]
        self.token = [NONE]
        self.shorter = [NONE] * len(a.labels)
        for t in sorted(range(len(a.labels)), key=self.lengths.__getitem__):
            if a.alive[t]:
                node = 0
                for s in spelled[t]:
                    if self.token[node] != NONE:
                        self.shorter[t] = self.token[node]
                    symbol = a.labels[s]
                    if symbol not in self.next[node]:
                        self.next[node][symbol] = len(self.next)
                        self.next.append({})
                        self.token.append(NONE)
                    node = self.next[node][symbol]
                self.token[node] = t

    def _arc(self, state: int, token: int) -> bool:
        if len(self._arcs) >= ARCS:
            self._arcs.clear()
        known = self._arcs[state << 32 | token] = self.automaton.arc(state, token)
        return known

    def _walk(self, word: str) -> bytes:
        """The ids of one pre-split word in byte letters."""
        symbols = [*word[:-1], word[-1] + self.suffix]
        n, path, ends, nowhere, arcs = len(symbols), [], [0], set(), self._arcs
        lengths, shorter, nexts, tokens = self.lengths, self.shorter, self.next, self.token
        token = None  # the next one to try at the place reached; None: the longest
        while ends[-1] < n:
            at = ends[-1]
            if token is None:
                node, token = 0, NONE
                for k in range(at, n):
                    if (node := nexts[node].get(symbols[k], NONE)) == NONE:
                        break
                    if tokens[node] != NONE:
                        token = tokens[node]
            while token != NONE:
                if at + lengths[token] not in nowhere:
                    if not path:
                        break
                    if (there := arcs.get(path[-1] << 32 | token)) is None:
                        there = self._arc(path[-1], token)
                    if there:
                        break
                token = shorter[token]
            if token != NONE:
                path.append(token)
                ends.append(at + lengths[token])
                token = None
            else:
                nowhere.add(at)
                ends.pop()
                token = shorter[path.pop()]
        return array("I", [self.ids[t] for t in path]).tobytes()

    def _cut(self, cut: str) -> bytes:
        """The ids of a cut between spaces: no rule of the tokenizer looks across a space, and none keeps one."""
        words, out = self._words, []
        if self._plain and _PLAIN.fullmatch(cut):
            own = [w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS) for w in _WORD.findall(cut.lower())]
        else:
            own = [word for word, _ in self._split(self._normalize(cut))]
        for word in own:
            if (found := words.get(word)) is None:
                if len(words) >= WORDS:
                    words.clear()
                found = words[word] = self._walk(word)
            out.append(found)
        if len(self._cuts) >= WORDS:
            self._cuts.clear()
        found = self._cuts[cut] = b"".join(out)
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned little-endian 32-bit integers."""
        known, out = self._cuts, []
        for k, part in enumerate(self._special.split(text) if self._special else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            at = 0
            while at < len(part):  # stretches of a long text, up to a space
                end = part.find(" ", at + STRETCH)
                end = len(part) if end < 0 else end
                out.append(b"".join([known[cut] if cut in known else self._cut(cut) for cut in part[at:end].split(" ")]))
                at = end + 1
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for a worker and file: compiled once."""
    return Codec(path)


RESULTS = {"ids": "binary", "decoded": "string"}
DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``ids`` (unsigned 32-bit, little-endian) and ``decoded``, the text that the ids decode to."""
    path = tokenizer or default_tokenizer()

    def of_texts(column: pa.Array) -> list[pa.Array]:
        own = codec(path)
        ids = [own.encode(t.as_py() or "") for t in column]
        return [pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.string())]

    return annotate(docs, docs.columns, text, RESULTS, of_texts, SLICE_BYTES, prefix)


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: what ``encode`` returns, hashed in the task that makes it."""
    path = tokenizer or default_tokenizer()

    def of_texts(column: pa.Array) -> list[pa.Array]:
        own = codec(path)
        rows = []
        for t in column:
            ids = own.encode(t.as_py() or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return annotate(docs, ["doc_id"], "text", DIGESTS, of_texts, SLICE_BYTES)
