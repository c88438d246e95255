"""Alignment of tokens against a walk over all pairs of whole texts' tokens."""

import hashlib
import random
import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravane.llm import alignment
from terravane.llm.tokens import _byte_letters, default_tokenizer


def _brute(texts):
    """Results of each text, by encoding it whole and comparing every token with every other."""
    a_ = Tokenizer.from_file(default_tokenizer())
    a_.encode_special_tokens = True
    b_ = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    byte_of = {c: b for b, c in _byte_letters().items()}
    links, out = [], []
    for text in texts:
        pairs, groups, n = [], [], (0, 0)
        if text:
            raw = f" {text}".encode()
            a = [(i, bytes(byte_of[c] for c in a_.id_to_token(i))) for i in a_.encode(f" {text}", add_special_tokens=False).ids]
            b = []
            for i in b_.encode(text, num_threads=1):
                p = b_.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b_.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                spans = []
                for side in (a, b):
                    at, own = 0, []
                    for i, x in side:
                        own.append((i, at, at + len(x)))
                        at += len(x)
                    spans.append(own)
                pairs = [(i, k) for i, s, e in spans[0] for k, t, f in spans[1] if s < f and t < e] if len(raw) < 4000 else _swept(*spans)
                cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
                for lo, hi in zip([0, *cuts], cuts):
                    groups.append("|".join(",".join(str(i) for i, s, e in own if lo <= s and e <= hi) for own in spans) if len(raw) < 4000 else None)
                if len(raw) >= 4000:
                    groups = _grouped(spans, cuts)
                n = len(a), len(b)
        links.append(pairs)
        out.append([*n, len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(p for own in links for p in own)
    most = {}
    for (_, k), n in count.items():
        most[k] = max(most.get(k, 0), n)
    return [(*row[:4], sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), row[4]) for row, own in zip(out, links)], count, most


def _swept(a, b):
    i = k = 0
    out = []
    while i < len(a) and k < len(b):
        out.append((a[i][0], b[k][0]))
        end = min(a[i][2], b[k][2])
        i, k = i + (a[i][2] == end), k + (b[k][2] == end)
    return out


def _grouped(spans, cuts):
    out, at = [], [0, 0]
    for hi in cuts:
        sides = []
        for s in (0, 1):
            own = []
            while at[s] < len(spans[s]) and spans[s][at[s]][2] <= hi:
                own.append(str(spans[s][at[s]][0]))
                at[s] += 1
            sides.append(",".join(own))
        out.append("|".join(sides))
    return out


def _texts():
    rng = random.Random(8)
    letters = "abcdefgh ABC  \n\t.,'01é中üß\U0001f600—\xa0\r"
    out = [None, "", " ", "  ", "a ", " a", "a  b", "x\n y \n", "<s> </s> <unk> <|endoftext|>", "▁", "a▁b c", "the ▁ end", "\x00", "a\x00b", "﻿x", "​ z", "ﬁne ① é é", "  x　 y", "don't we'll", "<0x0A>", "word" * 300]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    return out + [" ".join(rng.choice(words) for _ in range(30_000)), out[40], "hot"] + ["hot"] * 200


@pytest.mark.parametrize("most", [alignment.SLICE_BYTES, 300])
def test_every_text_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "SLICE_BYTES", most)
    monkeypatch.setattr(alignment, "CUTS", most)
    texts = _texts()
    wanted, count, best = _brute(texts)
    docs = spark.createDataFrame([(None if k % 40 == 0 else k, t, 0.5, "x") for k, t in enumerate(texts)], "doc_id long, text string, n double, pairs string").repartition(4)
    out, pairs = alignment.align(docs)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = sorted(((r["doc_id"], *(r[c] for c in columns)) for r in out.collect()), key=repr)
    assert found == sorted(((None if k % 40 == 0 else k, *w) for k, w in enumerate(wanted)), key=repr)
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in count.items()}


def test_texts_that_do_not_come_back_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a▁b"), (2, ""), (3, None)], "doc_id int, text string")
    assert [tuple(r)[1:] for r in alignment.align(docs)[0].collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert alignment.align(docs.limit(0))[0].collect() == []
    assert alignment.align(docs.where(F.lit(False)))[1].count() == 0
