"""The first ten operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terravane.llm import chat, decontamination, graph, language, licenses, near_dedup, packing, quality, queries, sharding, textkernel, token_files, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int"
TOXIC = ["idiot", "moron", "scum", "clown"]


def _prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def _rows():
    rng = random.Random(11)
    ends = ["er", "ou", "tion", "st", "nd", "ea", "on", "ly"]
    en = [rng.choice(["the", "and", "thing", "ingly", "heon", "ereat"]) + rng.choice(ends) + rng.choice(ends) for k in range(600)]
    ends = ["äu", "sch", "über", "ß", "ein", "zu", "ver", "lich"]
    de = [rng.choice(["der", "ung", "öch", "lich", "keit", "schaft"]) + rng.choice(ends) + rng.choice(ends) for k in range(600)]
    base = _prose(rng, 120, en)
    out = [None, "", "   \n\t ", "...!!! 12", "Word", "one two", "é", "<|endoftext|> <|im_start|>x", "a  b\n\n  c\td  e \x1c f"]
    out += [base, base, base.upper(), base.replace(" ", "\n"), " ".join(base.split()[:110] + ["new", "end"]), "Released under the MIT License. " * 3, "Apache License, Version 2.0 " + base]
    out += ["This work is licensed under the GNU General Public License, version 3.", "cc-by-nc CC BY NC", " ".join(["same line"] * 90), "x\nx\n\n \nx y\nx"]
    out += [_prose(rng, 30_000, en), "z" * 50_000]  # very long
    out += [_prose(rng, rng.randint(5, 200), en if k % 2 else de) for k in range(120)]
    rows = []
    for k, text in enumerate(out):
        if text and k > 24 and k % 5 == 0:
            words = text.split()
            text = " ".join([*words[:3], *(rng.choice(TOXIC) for _ in range(4)), *words[3:]])
        lang = None if k < 9 else "de" if text and re.search("[öäß]|ung|keit|lich", text) else "en"
        rows.append((k, text, lang, None if k % 10 == 0 else "hot" if k % 3 else f"h{k % 4}", len(text or ""), 0.5, True, 3))
    return rows + [rows[9], rows[30]]  # repeated rows


ROWS = _rows()
TEXTS = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _components(texts):
    sets = {d: _set(t) for d, t in texts.items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return sets, {d: root(d) for d in sets}


def test_near_duplicates_are_brute_force(docs, nothing):
    sets, component = _components(TEXTS)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"])
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_with_a_hot_group(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    base = [rng.choice(words) for _ in range(100)]
    texts = {}
    for k in range(260):  # copies with up to eight changed words: many are near, not all to all
        own = list(base)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(100)] = rng.choice(words)
        texts[k] = " ".join(own)
    df = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    _, component = _components(texts)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()} == component
    assert 1 < len(set(component.values())) < 260


def test_candidates_miss_almost_no_link():
    # small and larger sets with similarities from 0.75 on: the share of pairs that no band or the last cut would lose
    rng = np.random.default_rng(21)
    lost_bands, lost_cut, estimates = [], [], []
    for union, both in ((4, 3), (8, 6), (40, 30), (100, 75), (100, 80), (60, 54)):
        n = 3000
        own = (union - both) // 2 + (union - both) % 2
        values = rng.integers(0, 2**63, (n, union), dtype=np.uint64)
        a, b = values[:, : both + own], np.concatenate([values[:, :both], values[:, both + own :]], axis=1)
        sig = [near_dedup.min_max_signatures(np.sort(x, axis=1).ravel(), np.arange(n + 1) * x.shape[1]) for x in (a, b)]
        bands = [np.ascontiguousarray(x[:, : 2 * near_dedup.BANDED]).view(np.uint64) for x in sig]
        share = near_dedup._equal_share(*sig)
        lost_bands.append((~(bands[0] == bands[1]).any(axis=1)).mean())
        lost_cut.append((share < near_dedup.ESTIMATE_CUT).mean())
        estimates.append(share.mean() - both / union)
    assert max(lost_bands) <= 2 / 3000 and max(lost_cut) <= 5 / 3000
    assert max(map(abs, estimates)) < 0.01  # unbiased, but for the few bits of the further values


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5), (None, 3)]
    up = list(range(500))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            up[max(root(a), root(b))] = min(root(a), root(b))
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert all(r["component"] == root(r["node"]) for r in found)
    assert {r["node"] for r in found} == {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_shards(docs, nothing, spark):
    rows = sharding.shard(docs).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, ((r[0], r[1]) for r in ROWS)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    for k in {r["shard"] for r in rows}:
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == k)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    assert sharding.shard(nothing).count() == 0


def test_shards_with_many_parts_and_heavy_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice([7, 8, -(2**60), None, k * 10**9]), "x" * rng.randint(0, 90) + str(k), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    out = sharding.shard(df, part_bytes=600).collect()
    assert sorted((r["text"], r["part"]) for r in out) == sorted((t, p) for _, t, p in rows)
    total = sum(r["size"] for r in out)
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    keys = [-(2**63) if r["doc_id"] is None else r["doc_id"] for r in order]
    assert keys == sorted(keys)
    for k in range(8):
        own = [r for r in order if r["shard"] == k]
        assert [r["slot"] for r in own] == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / 8) < 0.02 * total / 8


def test_sharding_query_is_brute_force(docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_histogram_sharding(spark, str(tmp_path)).collect()
    wanted = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == wanted
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    total, biggest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = Counter()
    for r in rows:
        by[r["shard"]] += r["size"]
    assert set(by) <= set(range(8)) and max(by.values()) <= total / 8 + biggest


def test_shards_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(7 if k % 3 == 0 else k * 10**12 if k % 2 else None, "x" * rng.randint(0, 60) + str(k)) for k in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    mean = sum(r["b"] for r in out) / 8
    assert len(out) == 8 and all(abs(r["b"] - mean) < 0.02 * mean and r["top"] == r["n"] - 1 for r in out)


def test_licences(docs, nothing):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(TEXTS[r["doc_id"]]))
        places, labels = [], set()
        for p, label in phrases.items():
            hits = [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            places += hits
            labels |= {label} if hits else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert next(r["labels"] for r in rows if "GNU" in (TEXTS[r["doc_id"]] or "")) == "gpl-3"
    assert licenses.license_scan(nothing).count() == 0


def test_quality(docs, nothing):
    rows = quality.quality(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r["kept"] == (not r["base_failed"] and not r["host_rejected"])
    assert quality.quality(nothing).count() == 0


def test_a_bad_host_is_rejected(spark):
    good, bad = " ".join(f"w{k}" for k in range(80)), "short"
    rows = [(k, good if k % 20 else bad, f"h{k % 9}") for k in range(900)] + [(1000 + k, bad if k % 5 else good, "spam") for k in range(200)]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] >= 1000 for r in out if r["host_rejected"]} == {True} and sum(r["host_rejected"] for r in out) == 200
    assert sum(r["kept"] for r in out) == 855


def test_a_host_that_always_fails_is_rejected(spark, monkeypatch):
    good, bad = " ".join(f"w{k}" for k in range(80)), "short"
    for clean in (2, 3, 4):
        rows = [(k, bad, "spam") for k in range(500)] + [(1000 + k, good, f"h{k % clean}") for k in range(500 * clean)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        for most in (100_000, 0):  # by broadcast, and by a salted shuffle
            monkeypatch.setattr(quality, "BROADCAST_HOSTS", most)
            out = quality.quality(df).groupBy("host_rejected").agg(F.count("*"), F.max("doc_id")).collect()
            assert sorted(map(tuple, out)) == [(False, 500 * clean, 999 + 500 * clean), (True, 500, 499)]


def test_prior_strength_is_the_beta_s():
    rng = np.random.default_rng(7)
    a, b = 2.0, 6.0
    n = rng.integers(5, 60, 40_000)
    rates = rng.binomial(n, rng.beta(a, b, len(n))) / n
    assert quality.prior_strength(rates.mean(), rates.var(ddof=1), (1 / n).mean()) == pytest.approx(a + b, rel=0.1)
    same = rng.binomial(n, 0.25) / n
    assert quality.prior_strength(same.mean(), same.var(ddof=1), (1 / n).mean()) > 100
    assert quality.prior_strength(0.5, 0.25, 0.001) == pytest.approx(0, abs=0.01)
    assert quality.prior_strength(0.3, 0.0, 1.0) == float("inf")


def test_toxicity(docs, nothing, spark):
    labels = spark.createDataFrame([(d, 1, int(any(w in (t or "").split() for w in TOXIC))) for d, t in TEXTS.items()], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert toxicity.score(nothing, toxicity.fit(docs, labels)).count() == 0
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        out = toxicity.score(docs, toxicity.fit(docs, some)).agg(F.count("*"), F.max("score"), F.max("predicted")).first()
        assert tuple(out) == (len(ROWS), 0.0, 0)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels.limit(0))).count() == 0


def test_toxicity_is_brute_force(docs, spark):
    labels = spark.createDataFrame([(d, int(any(w in (t or "").split() for w in TOXIC))) for d, t in TEXTS.items()], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    known = {int(h): s for h, s in zip(model.hashes, model.scores)}
    hashed = lambda w: int(textkernel.word_hashes(textkernel.words_of(pa.array([w]), textkernel.ALNUM))[0])
    assert {hashed(w) for w in TOXIC} <= set(known)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for d, text in TEXTS.items():
        words, seen, steps = re.findall("[0-9a-z\u0080-\U0010ffff]+", _lower(text)), Counter(), []
        for w in words:
            if (h := hashed(w)) in known:
                seen[h] += 1
            steps.append(known[h] / seen[h] if h in known else -model.drift)
        strengths = [model.lam * sum(steps[i:j]) - math.log(model.k * len(words)) for i, j in (_segments(steps) if any(s > 0 for s in steps) else [])]
        total = sum(s for s in strengths if s > 0)
        assert rows[d]["n_passages"] == sum(s > 0 for s in strengths), d
        assert rows[d]["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * math.log1p(total) + model.intercept)))), d


def test_many_hits_in_one_text():
    # falling sums: a search that passes every earlier segment would be quadratic
    began = time.perf_counter()
    assert len(toxicity.maximal_segments([1.0, -1.5] * 50_000)) == 50_000
    assert toxicity.maximal_segments([1.0, -0.5] * 50_000) == [(0, 99_999, 25_000.5)]
    assert len(toxicity.maximal_segments([1.0, -1.5, 2.0, -3.0] * 25_000)) > 0
    assert time.perf_counter() - began < 5


def test_extreme_value_law():
    # steps of +1 and -1: lambda is ln(q / p), and a walk's law is known in closed form
    p, q = 0.3, 0.7
    lam, k = toxicity._extreme_value(np.array([1.0, -1.0]), np.array([p, q]))
    assert lam == pytest.approx(math.log(q / p))
    rng = np.random.default_rng(5)
    n = 2000
    walk = np.cumsum(np.where(rng.random((1500, n)) < p, 1, -1), axis=1)
    best = (walk - np.minimum.accumulate(np.minimum(walk, 0), axis=1)).max(axis=1)
    for x in (9, 10, 11):
        assert 1 - math.exp(-k * n * math.exp(-lam * (x - 1))) == pytest.approx((best >= x).mean(), abs=0.15)


def _segments(s):
    """The definition, applied again and again: the best contiguous range, then what lies left and right of it."""
    ranges, found = [(0, len(s))], []
    while ranges:
        lo, hi = ranges.pop()
        run, low, at, best = 0.0, 0.0, lo, (0.0, lo, lo)
        for k in range(lo, hi):  # the shortest of the best ranges
            if run <= low:
                low, at = run, k
            run += s[k]
            if run - low > best[0] + 1e-12:
                best = (run - low, at, k + 1)
        if best[0] > 0:
            found.append(best[1:])
            ranges += [(lo, best[1]), (best[2], hi)]
    return sorted(found)


def test_maximal_segments_are_brute_force():
    rng = random.Random(8)

    for _ in range(300):
        s = [rng.choice([-3.7, -2.1, -1.3, 0.9, 2.2, 3.1]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == _segments(s)


def test_language(docs, nothing):
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    lang = {r[0]: r[2] for r in ROWS}
    assert len(rows) == len(ROWS) and model.languages == ["de", "en"]
    known = [r for r in rows if lang[r["doc_id"]] and len((TEXTS[r["doc_id"]] or "").split()) > 20 and r["doc_id"] > 24]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in known) >= 0.95 * len(known)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in TEXTS[r["doc_id"]] or "")) and 0 <= r["score"] <= 1 for r in rows)
    assert language.predict(nothing, model).count() == 0


def _word_probability(v, p, word):
    """The sum over all segmentations, from the end of the word to its start."""
    start, inner = {s: k for k, s in enumerate(v.starts)}, {s: k + len(v.starts) for k, s in enumerate(v.inner)}
    rest = [0.0] * len(word) + [1.0]
    for i in range(len(word) - 1, -1, -1):
        rest[i] = p[v.lone] * rest[i + 1] + sum(p[inner[word[i:j]]] * rest[j] for j in range(i + 1, min(len(word), i + v.longest) + 1) if word[i:j] in inner)
    return p[v.bare] * rest[0] + sum(p[start[word[:j]]] * rest[j] for j in range(1, min(len(word), v.longest) + 1) if word[:j] in start)


def test_forward_is_all_segmentations():
    v = language.vocabulary(language.default_vocabulary())
    p = np.random.default_rng(3).random((v.size, 2))
    words = [b"the", b"thing", "\u00fcber".encode(), b"q", b"internationalisation" * 3, "\u0442\u043e\u0432\u0430\u0440\u0438\u0449\u0435\u0441\u0442\u0432\u043e\u043c\u0431".encode(), "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c".encode() * 5, b"z" * 300]
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    found = language.word_scores(v, np.log(p), data, ends - [len(w) for w in words], ends)
    for k in range(2):
        assert np.allclose(found[:, k], [math.log(_word_probability(v, p[:, k], w)) for w in words], rtol=1e-9)


def test_long_words_are_scored_whole(monkeypatch):
    v = language.vocabulary(language.default_vocabulary())
    log_p = np.log(np.random.default_rng(4).random((v.size, 3)) / 1e4)
    word = np.frombuffer(b"ab" * 1100 + "stra\u00dfe".encode() * 300, dtype=np.uint8)
    alone = language.word_scores(v, log_p, word, np.array([0]), np.array([len(word)]))
    monkeypatch.setattr(language, "LONG_WORD", 10**9)
    assert np.allclose(language.word_scores(v, log_p, word, np.array([0]), np.array([len(word)])), alone, rtol=1e-9)
    assert np.isfinite(alone).all()


def test_expected_counts_are_derivatives():
    # the expected count of a piece is the derivative of log P by log p
    v = language.vocabulary(language.default_vocabulary())
    p = np.random.default_rng(6).random((v.size, 1)) / 100
    for word in (b"there", "gr\u00fc\u00dfe".encode(), b"information"):
        totals = np.zeros_like(p)
        language._accumulate(v, np.frombuffer(word, dtype=np.uint8), np.array([0]), np.array([len(word)]), np.log(p), np.array([0]), np.array([3.0]), totals)
        for piece in np.flatnonzero(totals[:, 0])[:12]:
            more = p[:, 0].copy()
            more[piece] *= 1 + 1e-6
            slope = (math.log(_word_probability(v, more, word)) - math.log(_word_probability(v, p[:, 0], word))) / math.log1p(1e-6)
            assert totals[piece, 0] == pytest.approx(3 * slope, rel=1e-3, abs=1e-6)


def test_language_is_brute_force(docs):
    model = language.fit(docs)
    v, p = language.vocabulary(model.vocabulary), np.exp(model.log_p)
    rows = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for d in [*range(0, 20), 22, 23, 30, 45, 60]:
        if not any(c.isalpha() for c in TEXTS[d] or ""):
            assert (rows[d]["lang_pred"], rows[d]["score"]) == ("und", 0.0)
            continue
        words = re.findall(rb"[^\x20\x09-\x0D]+", _lower(TEXTS[d]).encode())
        sums = [sum(math.log(_word_probability(v, p[:, k], w)) for w in words) for k in range(2)]
        assert rows[d]["lang_pred"] == model.languages[int(np.argmax(sums))]
        assert rows[d]["score"] == pytest.approx(1 / sum(math.exp((s - max(sums)) / math.sqrt(len(words))) for s in sums), rel=1e-6)


def test_many_languages(spark):
    # no language is left out, however many there are
    rows = [(k * 40 + j, f"word{k}x thing{k}y " * 5, f"l{k:03d}") for k in range(60) for j in range(8)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 60


def test_blocks_of_languages_change_nothing(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(k * 40 + j, " ".join(f"w{k % 9}{rng.choice('abcdef')}o{rng.choice('xyz')}" for _ in range(30)), f"l{k:03d}") for k in range(30) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = language.fit(docs)
    key = lambda m: sorted(map(tuple, language.predict(docs, m).collect()))
    wanted = key(whole)
    monkeypatch.setattr(language, "BLOCK", 7)
    few = language.fit(docs)
    assert few.languages == whole.languages and np.allclose(few.log_p, whole.log_p, atol=1e-9)
    assert [r[:2] for r in key(few)] == [r[:2] for r in wanted] and np.allclose([r[2] for r in key(few)], [r[2] for r in wanted])


def test_very_many_languages_fit_in_little_memory(spark):
    rows = [(k, f"some text of number {k}", f"dirty {k}") for k in range(5000)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    kept = [k for k in range(5000) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert model.languages == sorted(f"dirty {k}" for k in kept)  # not one is left out
    assert model.log.nbytes + model.piece.nbytes + model.base.nbytes < 20_000_000  # dense they would be 1.3 GB


def test_a_repeated_id_is_one_document(spark):
    rows = [(101, f"english words that repeat {k % 3}", "en") for k in range(5000)] + [(200 + k, f"deutsche wörter die es gibt {k}", "de") for k in range(40)]
    for doc_id in (101, 103, 106):
        df = spark.createDataFrame([(doc_id if lang == "en" else i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string").repartition(3)
        model = language.fit(df, most=600)
        if zlib.crc32(str(doc_id).encode()) % 4 == 2:
            assert model.languages == ["de"]
            continue
        assert model.languages == ["de", "en"] and np.diff(model.first).min() > 10  # both were seen
        few = language.fit(df, most=1)
        assert np.diff(few.first).min() > 3


def test_long_words_are_learned():
    v = language.vocabulary(language.default_vocabulary())
    p = np.random.default_rng(7).random((v.size, 1)) / 100
    for word in (b"there", b"information", "grüße".encode() * 4):
        totals = np.zeros_like(p)
        language._accumulate(v, np.frombuffer(word, dtype=np.uint8), np.array([0]), np.array([len(word)]), np.log(p), np.array([0]), np.array([1.0]), totals)
        assert np.allclose(language._long_word_counts(v, np.log(p[:, 0]), np.frombuffer(word, dtype=np.uint8)), totals[:, 0], atol=1e-9)


def test_nothing_to_learn_from(docs, nothing):
    model = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()} == {("und", 0.0)}
    assert language.predict(nothing, language.fit(nothing)).count() == 0


def _ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], dtype="<u4") for d, x in TEXTS.items()}


def test_ids_are_the_library_s():
    from tokenizers import Tokenizer

    rng = random.Random(12)
    t = Tokenizer.from_file(tokens.default_tokenizer())
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "word", "\u00e9", "\u00a0", "'s", "12", "\u4e2d", "\t", "!!", "\U0001f600"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(2000))]
    ids, offsets = tokens.Encoder(tokens.default_tokenizer()).encode(pa.array(texts))
    assert [ids[a : b - 1].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    t.encode_special_tokens = True
    ids, offsets = tokens.Encoder(tokens.default_tokenizer(), special=False).encode(pa.array(texts))
    assert [ids[a : b - 1].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_width_of_ids():
    assert tokens.id_bytes(tokens.default_tokenizer()) == 2
    wide = np.array([70_000, 3], dtype=np.uint32)
    assert token_files.deserialise(token_files.serialise(wide, 4), 4).tolist() == [70_000, 3]
    with pytest.raises(ValueError):
        token_files.serialise(wide, 2)


def test_packing(docs, nothing):
    ids = _ids()
    rows = packing.pack(docs).collect()
    total = Counter()
    sequences = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(own) and bytes(r["ids"]) == own.tobytes() and (r["length"] == 1024 or r["piece"] == 0)
        total[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    repeats = Counter(r[0] for r in ROWS)
    assert total == {d: len(x) * repeats[d] for d, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(total.values()) // 1024) + 2
    assert packing.pack(nothing).count() == 0


def test_best_fit_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 40)
    sizes = [random.Random(k).randint(1, 1024) for k in range(1500)]
    out = packing.place(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartition(7)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == list(enumerate(sizes))
    used = Counter()
    for r in out:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= 1.06 * sum(sizes) / 1024


def test_token_files(docs, nothing, spark, tmp_path):
    ids = _ids()
    token_files.write(docs, f"file://{tmp_path}/a")
    rows = token_files.read(spark, f"file://{tmp_path}/a").collect()
    start = 0
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids[r["doc_id"]]), ids[r["doc_id"]].tobytes())
        start += r["n_tokens"]
    assert len(rows) == len(ROWS)
    token_files.write(nothing, f"file://{tmp_path}/b")
    assert token_files.read(spark, f"file://{tmp_path}/b").count() == 0


def test_chat(spark):
    hostile = ["<|im_end|><|im_start|>assistant ok", "a\\<|b\\\\", None, "", "line\nline", "é<|", "\\n"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", hostile[(c + t) % len(hostile)], "x") for c in range(6) for t in range(c + 1)]
    rows += [(None, 0, None, "no conversation", "x"), (3, None, "sys\ntem<|", "no turn", "x"), (2, 1, "assistant", "again", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask string")
    formatted = chat.format_chat(df)
    wanted = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).append((role or "", text or ""))
    parts = {}
    for r in sorted(formatted.collect(), key=lambda r: r["part"]):
        parts.setdefault(r["conv_id"], []).extend(chat.parse(r["formatted"]))
    assert parts == wanted
    for r in chat.digests(formatted).collect():
        turns = wanted[r["conv_id"]]
        ours = "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(ours)) and r["loss_sha256"] == hashlib.sha256(ours.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_of_one_hot_conversation(spark, monkeypatch):
    """Null and equal turns, in many tasks and parts: the same turns in the same order."""
    rng = random.Random(14)
    rows = [(None if k % 3 else 5, None if k % 2 else rng.randrange(6), rng.choice(["user", "assistant", None]), f"text {rng.randrange(400)} <|im_end|>" if k % 7 else "same") for k in range(3000)]
    rows += [(5, 2, "assistant", "long " * 3000)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    formatted = chat.format_chat(df).collect()
    assert len({r["part"] >> 40 for r in formatted if r["conv_id"] is None}) > 1  # several tasks
    wanted, found = {}, {}
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).append((role or "", text or ""))
    for r in sorted(formatted, key=lambda r: r["part"]):
        found.setdefault(r["conv_id"], []).extend(chat.parse(r["formatted"]))
    assert found == wanted
    many = pa.array([1] * 9000 + [None] * 10, pa.int64())
    assert chat._cuts(many, pa.array(["x"] * 9010)).tolist() == [0, 4096, 8192, 9000, 9010]


def test_decontamination(docs, nothing, spark):
    rng = random.Random(9)
    item = [f"b{rng.randrange(9999)}" for _ in range(60)]
    cut = [item[k : k + 15] for k in range(0, 60, 15)]
    reordered = " ".join(sum([*cut[2:], ["x", "y"], *cut[:2]], []))
    texts = [" ".join(item), "Before. " + " ".join(item).upper() + " after", reordered, " ".join(item[:20]), "clean " * 50, None, ""]
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, coverage_before double")
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(item))], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.decontaminate(df, benchmark).collect()}
    assert [rows[k]["contaminated"] for k in range(7)] == [True, True, True, False, False, False, False]
    assert rows[0]["items"] == [1, 4] and rows[0]["coverage"] == 1 and rows[2]["coverage"] == 1 and rows[3]["coverage"] == pytest.approx(1 / 3)
    assert not decontamination.decontaminate(df, benchmark.limit(0)).where("contaminated").count()
    assert decontamination.decontaminate(nothing, benchmark).count() == 0


def test_a_large_benchmark(spark, monkeypatch):
    texts = [" ".join(f"t{k}x{j}" for j in range(20)) for k in range(30)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 2000)
    assert {r["doc_id"]: r["items"] for r in decontamination.decontaminate(df, benchmark).collect()} == {k: [100 + k] for k in range(30)}


def test_greedy_tiles_are_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        a, b = [rng.randrange(4) for _ in range(rng.randint(0, 25))], [rng.randrange(4) for _ in range(rng.randint(0, 18))]
        size = 3
        pairs = [(i, j) for i in range(len(a) - size + 1) for j in range(len(b) - size + 1) if a[i : i + size] == b[j : j + size]]
        used_a, used_b, wanted = set(), set(), []
        while True:
            best = None
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                        k += 1
                    if k >= size and (best is None or (-k, j, i) < best):
                        best = (-k, j, i)
            if best is None:
                break
            k, j, i = -best[0], best[1], best[2]
            wanted.append((i, j, k))
            used_a.update(range(i, i + k))
            used_b.update(range(j, j + k))
        found = decontamination.tiles(np.array([p for p, _ in pairs], dtype=np.int64), np.array([q for _, q in pairs], dtype=np.int64), size) if pairs else []
        assert sum(t[2] for t in found) == sum(t[2] for t in wanted) and sorted(t[2] for t in found) == sorted(t[2] for t in wanted)


def test_stages_take_awkward_rows(docs, nothing, spark, tmp_path):
    labels = spark.createDataFrame([(d, 1, int(any(w in (t or "").split() for w in TOXIC))) for d, t in TEXTS.items()], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, TEXTS[30])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        kept = [r["doc_id"] for r in out.select("doc_id").collect()]
        before = Counter(r["doc_id"] for r in at.select("doc_id").collect())
        assert not Counter(kept) - before, name
        at = spark.createDataFrame(out.collect(), docs.schema)
    left = {r["doc_id"] for r in at.collect()}
    assert at.count() == len(left) and 30 not in left
    toxic = {d for d, t in TEXTS.items() if any(w in (t or "").split() for w in TOXIC)}
    assert toxic and len(toxic & left) <= 0.2 * len(toxic)
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).select("doc_id").distinct().count() == len(left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


CLASHES = ["__text", "__score", "__0", "score", "kept", "kept_id", "coverage", "items", "rep", "part", "toxicity_score", "row"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [r for r in ROWS if r[0] < 25 or r[0] > 100][:60]
    base = spark.createDataFrame([(None if k % 9 == 4 else r[0], r[1], r[2]) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    docs = base.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    spark.createDataFrame([(d, int(any(w in (t or "").split() for w in TOXIC))) for d, t in TEXTS.items()], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, TEXTS[30])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in CLASHES] == list(range(len(CLASHES)))
            assert r["doc_id"] is None or r["text"] == TEXTS[r["doc_id"]]
        kept = [r["doc_id"] for r in out.collect()]
        assert name == "language_id" or kept.count(None) == sum(k % 9 == 4 for k in range(len(rows)))


def test_stages_without_labels_keep_all(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    for name in ("toxicity", "language_id", "decontamination"):
        assert dict(corpus_pipeline.STAGES)[name](spark, unlabelled, str(tmp_path)).count() == len(ROWS)


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op4_toxicity", "op10_language_id", "op2_histogram_sharding", "op9_token_files"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_null_doc_ids(spark):
    """Rows with a null doc_id: each operator's docstring states what becomes of them."""
    texts = [TEXTS[9], TEXTS[9], None, "Released under the MIT License.", "cc by nc " * 30]
    df = spark.createDataFrame([(None, t, "en", "h", k) for k, t in enumerate(texts)] + [(7, TEXTS[9], "en", "h", 9)], "doc_id long, text string, lang string, source string, labels int")
    near = near_dedup.near_duplicates(df).collect()
    assert sorted((r["component_id"], r["kept"]) for r in near if r["doc_id"] is None) == [(None, True)] * 5
    assert [(r["component_id"], r["kept"]) for r in near if r["doc_id"] == 7] == [(7, True)]
    assert sorted(r["slot"] for r in sharding.shard(df).collect() if r["shard"] == 0)[0] == 0
    licences = licenses.license_scan(df).where("doc_id is null").collect()
    assert sorted(r["labels"] for r in licences) == ["", "", "", "cc-by-nc", "mit"]
    model = toxicity.fit(df, spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(df, model).count() == 6
    assert language.predict(df, language.fit(df)).where("doc_id is null and lang_pred = 'und'").count() in (1, 5)
    assert packing.pack(df).where("doc_id is null").count() >= 5
    assert quality.quality(df).where("doc_id is null").count() == 5
    assert decontamination.decontaminate(df, spark.createDataFrame([(1, TEXTS[9])], "item_id long, text string")).where("doc_id is null and contaminated").count() == 2


def test_every_number_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14))
