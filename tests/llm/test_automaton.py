"""The tokenization automaton against merging step by step and against the library."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from terravane.llm import automaton


def _merge(word, merges):
    """Merging by the smallest number, from the left."""
    rank = {m: k for k, m in enumerate(merges)}
    word = list(word)
    while pairs := [(rank[p], k) for k, p in enumerate(zip(word, word[1:])) if p in rank]:
        k = min(pairs)[1]
        word[k : k + 2] = [word[k] + word[k + 1]]
    return word


def test_paths_are_what_merging_leaves():
    rng = random.Random(4)
    for _ in range(60):
        tokens, merges = list("abc"), []
        while len(merges) < 12:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        own, ids = automaton.compile_merges({t: k for k, t in enumerate(tokens)}, merges)
        assert ids == [tokens.index(t) for t in own.labels]
        for length in range(1, 7):
            for word in map("".join, itertools.product("abc", repeat=length)):
                wanted = _merge(word, merges)
                paths = [[]]  # all ways to spell the word, by the automaton's arcs
                full = []
                while paths:
                    path = paths.pop()
                    if sum(map(len, path)) == length:
                        full.append(path)
                        continue
                    rest = word[sum(map(len, path)) :]
                    for t in tokens:
                        if rest.startswith(t) and own.alive[own.number[t]] and (not path or own.arc(own.number[path[-1]], own.number[t])):
                            paths.append([*path, t])
                assert full == [wanted], (word, merges)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(automaton.default_tokenizer())


def _texts():
    rng = random.Random(5)
    letters = "aaabbthinger SSthe0123 \n\t'st're'LLéü中文ßİΣ…— ́　\U0001f600"
    out = [None, "", "   \n", "a" * 200, "ha" * 90, "!?" * 80, "<|endoftext|> x<|startoftext|>y <|endoftext|>", "<|startoftext|", "x" * 3000, "ΑΣ ΟΔΟΣ", "e ́a", "don't I'LL we've"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    out += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 13))) for _ in range(30)) for _ in range(200)]
    return out + [" ".join(rng.choice(["tower", "Thinking", "12", "ab-c"]) for _ in range(90_000)), out[40]]


def test_the_operator_agrees_with_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(automaton, "STRETCH", 100)
    texts = _texts()
    docs = spark.createDataFrame([(k if k % 50 else None, t, 0.5, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens double, decoded string, k long").repartition(5)
    rows = automaton.encode(docs, prefix="own_").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["k"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["own_ids"], "<u4").tolist() == ids, texts[r["k"]]
        assert r["own_decoded"] == library.decode(ids, skip_special_tokens=False)
    wanted = sorted((len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for i in (library.encode(t or "", add_special_tokens=False).ids for t in texts))
    assert sorted((r["n_tokens"], r["ids_sha256"]) for r in automaton.digests(docs).collect()) == wanted
    with pytest.raises(ValueError):
        automaton.encode(docs.withColumnRenamed("k", "ids"))
    assert automaton.digests(docs.limit(0)).collect() == []


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(automaton, "WORDS", 3)
    monkeypatch.setattr(automaton, "ARCS", 5)
    own = automaton.Codec(automaton.default_tokenizer())
    for text in _texts()[1:60]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError):
        automaton.Codec(automaton.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"))  # it has a decoder
    with pytest.raises(ValueError):
        automaton.compile_merges({"a": 0, "b": 1, "c": 2, "abc": 3, "ab": 4}, [("ab", "c"), ("a", "b")])
