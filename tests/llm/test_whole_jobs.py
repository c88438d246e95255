"""Operators on inputs where a cut of the work would show."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from tokenizers import Tokenizer

import corpus_pipeline
from terravane.llm import decontamination, licenses, packing, textkernel, token_files, tokens


def _licences(text):
    """Labels and best score of the templates by trying every place of the text."""
    w = re.findall("[a-z0-9]+", text.lower())
    labels = {label for p, label in licenses.BASE if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))}
    best = 1.0 if labels else 0.0
    for label, template, keys in licenses.TEMPLATES:
        own = template.split()
        for start in range(-len(own), len(w)):
            same = [x for q, x in enumerate(own) if 0 <= start + q < len(w) and w[start + q] == x]
            if len(set(same)) < min(2, len(set(own))):
                continue
            ok = True
            for key in keys:
                k = key.split()
                q = next(i for i in range(len(own)) if own[i : i + len(k)] == k)
                ok &= any(s >= 0 and w[s : s + len(k)] == k for s in range(start + q - licenses.SLACK, start + q + licenses.SLACK + 1))
            if ok:
                labels.add(label)
                best = max(best, len(same) / len(own))
    return ",".join(sorted(labels)), best


def test_licences_of_several_statements(spark):
    statements = {label: text for label, text, _ in licenses.TEMPLATES}
    texts = [f"see see see {text} see" for _, text, _ in licenses.TEMPLATES]
    texts += [f"{a}. {b}" for a, b in itertools.permutations(statements.values(), 2)]
    texts += [f"{a}\n\nfiller words here\n{b}; {c}" for a, b, c in random.Random(2).sample(list(itertools.combinations(statements.values(), 3)), 120)]
    ties = ["gnu gnu general public license version 3 3", "license license mozilla public license public license"]  # words of equal rarity, and repeated ones
    texts += ties
    stray = " unencumbered lesser affero mozilla redistribution isc nc unencumbered"
    texts += [text + stray for text in statements.values()] + [stray + " x " + text for text in statements.values()]
    texts += [" ".join(text.split()[2:]) + " cc by" for text in statements.values()]  # the opening is missing
    texts += ["this software may for any purpose be used without fee", "gnu general public license of any version 3", "cc by", "nc 4 0", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.license_scan(df.repartition(3)).collect():
        labels, score = _licences(texts[r["doc_id"]] or "")
        assert (r["labels"], round(r["score"], 9)) == (labels, round(score, 9)), texts[r["doc_id"]]
    both = f"{statements['gpl-3']} {statements['mpl-2']}"
    assert set(_licences(both)[0].split(",")) == {"gpl-3", "mpl-2"}


def test_each_text_visits_the_templates_of_its_words():
    index = licenses.index()
    texts = ["no word of any licence but the one of", "released under the mit license", "the license of the software is granted free", "gnu general public license version 3 and mozilla public license", ""]
    w = textkernel.words_of(pa.array(texts), textkernel.ALNUM)
    number = index.find(textkernel.word_hashes(w))
    idf = np.linspace(1, 5, len(index.words))
    visited = {r: (words, found) for r, words, found in licenses.candidates(number, w.row, len(texts), idf)}
    assert 0 not in visited and 2 not in visited and 4 not in visited  # ruled out by their words alone
    for r, (words, found) in visited.items():
        assert [idf[x] for x in words] == sorted((idf[x] for x in words), reverse=True)
        own = set(texts[r].split())
        for t, (_, template, keys) in enumerate(licenses.TEMPLATES):
            assert (t in found) == (len(own & set(template.split())) >= 2 and set(" ".join(keys).split()) <= own)
        assert 1 <= len(found) <= 8 < len(licenses.TEMPLATES)
    assert sum(index.members.sum(axis=1) >= 1) == len(licenses.TEMPLATES) == 31


def test_token_files_of_one_hot_id(spark, tmp_path):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(rng.choices(words, k=30)) if k % 2 else "the same text again") for k in range(1200)]
    rows.append((5, " ".join(rng.choices(words, k=40_000))))  # very long
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, frame string, part int").repartition(5)
    path = f"file://{tmp_path}/files"
    token_files.write(docs, path)
    found = token_files.read(spark, path).collect()
    library = Tokenizer.from_file(tokens.default_tokenizer())
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    wanted = sorted(((i, np.array([*library.encode(t, add_special_tokens=False).ids, tokens.END_ID], "<u4").tobytes()) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in found), key=key) == wanted
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered[:-1])]).tolist()
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered]
    assert ids == sorted(ids)
    blocks = spark.read.parquet(f"{path}/blocks").selectExpr("part", "explode(doc_ids) AS doc_id").groupBy("part", "doc_id").count().collect()
    for hot in (None, 7):  # neither all null ids nor all rows of one id are one task's
        own = [r["count"] for r in blocks if r["doc_id"] == hot]
        assert len(own) >= 2 and max(own) < 400


def test_samples_are_spread():
    ids = np.arange(10_000, dtype=np.uint32)
    some = token_files.spread(ids, 2000)
    assert len(some) == 2000 and some[0] == 0 and some[-1] == 9999 and len(token_files.spread(ids[:2000], 2000)) == 2000


def test_short_items_are_found(spark):
    items = [(1, "alpha"), (2, "Beta gamma"), (3, "one two three four"), (4, "never there"), (5, "..."), (6, "a b c d e f"), (6, "alpha")]
    texts = ["x Alpha, y", "beta\ngamma beta gamma", "gamma beta", "zero one two three four five", "one two three", "a b c d e f alpha", "", None, "alpha " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = {r["doc_id"]: (r["items"], r["coverage"]) for r in decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {0: ([1, 6], 1.0), 1: ([2], 1.0), 2: ([], 0.0), 3: ([3], 1.0), 4: ([], 0.0), 5: ([1, 6, 6], 1.0), 6: ([], 0.0), 7: ([], 0.0), 8: ([1, 6], 1.0)}


def _shares_of(text, item):
    """Share of the item's words that greedy tiles cover, by trying every place again and again."""
    a, b = (re.findall("[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) for x in (text, item))
    if len(b) < 5:
        return float(bool(b) and any(a[k : k + len(b)] == b for k in range(len(a))))
    free_a, free_b, covered = set(range(len(a))), set(range(len(b))), 0
    while True:
        best = (4, 0, 0)
        for i in free_a:
            for j in free_b:
                k = 0
                while i + k in free_a and j + k in free_b and a[i + k] == b[j + k]:
                    k += 1
                best = max(best, (k, -j, -i))
        if best[0] < 5:
            return covered / len(b)
        k, j, i = best[0], -best[1], -best[2]
        free_a -= set(range(i, i + k))
        free_b -= set(range(j, j + k))
        covered += k


def test_decontamination_is_brute_force_on_both_ways(spark, monkeypatch):
    rng = random.Random(31)
    words = [f"w{k}" for k in range(300)]
    stock = "which of the following is the best answer"
    items = [(k, f"{stock} " * (k % 3 == 0) + " ".join(rng.choices(words, k=rng.randint(8, 40)))) for k in range(60)]
    items += [(100, "one two"), (101, "alpha"), (102, "..."), (103, None), (5, items[4][1]), (None, "a b c d e f g"), (104, "la la la la la la la la")]
    texts = [None, "", "clean words only here now", stock, "zero one two three", "ALPHA!", "la " * 60, "x a b c d e f g"]
    for k in range(40):
        item = items[rng.randrange(60)][1].split()
        cut = rng.randrange(len(item))
        texts.append(" ".join([*rng.choices(words, k=9), *item[cut:], "between", *item[:cut], *rng.choices(words, k=5)]))
        texts.append(" ".join([*rng.choices(words, k=9), *item[: len(item) // 3], *rng.choices(words, k=5)]))
    docs = spark.createDataFrame([(k if k % 7 else None, t, k) for k, t in enumerate(texts)] + [(900, texts[8], 900)], "doc_id long, text string, coverage_ long").repartition(3)
    texts = dict(enumerate(texts)) | {900: texts[8]}
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    wanted = {k: [(i, _shares_of(t, x)) for i, x in items if x is not None] for k, t in texts.items()}
    for common in (64, 3):
        answers = []
        for most in (10**9, 0):
            monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
            monkeypatch.setattr(decontamination, "COMMON", common)
            rows = decontamination.decontaminate(docs, benchmark, ["doc_id", "coverage_"]).collect()
            answers.append(sorted(map(tuple, rows), key=repr))
            assert len(rows) == len(texts)
            for r in rows:
                found = wanted[r["coverage_"]]
                hits = sorted(-1 if i is None else i for i, share in found if share >= 0.5)
                assert (r["items"], r["contaminated"]) == (hits, bool(hits))
                top = max(share for _, share in found)
                if top >= 0.5 or common == 64:
                    assert abs(r["coverage"] - top) < 1e-12
        assert answers[0] == answers[1]  # the best item and its coverage as well


def test_no_item_of_common_windows_is_lost(spark, monkeypatch):
    rng = random.Random(21)
    block = "one two three four five six"
    items = [(k, " ".join([block] * 12)) for k in range(70)] + [(100 + k, f"{block} {block} own word number {k}") for k in range(70)] + [(200 + k, " ".join(rng.choice(["la", "lo"]) for _ in range(rng.randint(5, 30)))) for k in range(90)]
    texts = [" ".join([block] * 12), f"x {block} y", " ".join([block] * 40), "la " * 30, " ".join(rng.choice(["la", "lo", "li"]) for _ in range(200)), f"{block} own word number 7", "nothing of it", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    answers = []
    for most in (10**9, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
        rows = sorted(map(tuple, decontamination.decontaminate(docs, benchmark).collect()))
        answers.append(rows)
        for doc_id, _, _, found, contaminated in rows:
            hits = [i for i, x in items if _shares_of(texts[doc_id], x) >= 0.5]
            assert (found, contaminated) == (hits, bool(hits))
    assert answers[0] == answers[1] and len(answers[0][0][3]) >= 70
    few = decontamination.Items([0], ["a b c d e f g"]).windows  # its table is as large as it needs
    assert len(few.marked) < 10_000


def test_repeated_windows_are_walked(monkeypatch):
    rng = random.Random(8)
    for _ in range(60):
        text, item = ([rng.randrange(3) for _ in range(rng.randint(5, 60))] for _ in range(2))
        keys = [np.array([hash(tuple(x[k : k + 5])) & (2**63 - 1) for k in range(len(x) - 4)], dtype=np.uint64) for x in (text, item)]
        p, q = np.nonzero(keys[0][:, None] == keys[1][None, :])
        assert sorted(decontamination.walked_runs(*keys)) == (sorted(decontamination.runs(p, q)) if len(p) else [])
    items = decontamination.Items([1, 2], ["la " * 300, "other words that are not there at all"])
    row, key, at = textkernel.shingles(w := textkernel.words_of(pa.array(["la " * 5000, "other words that are not there at all", "x"]), textkernel.ALNUM), textkernel.word_hashes(w), 5, short=False)
    whole = decontamination._shares(row, key, at, items)
    monkeypatch.setattr(decontamination, "MOST_MATCHES", 1000)
    assert decontamination._shares(row, key, at, items) == whole == {(0, 0): 1.0, (1, 1): 1.0}


def _fewest(sizes, capacity):
    """The fewest bins, by trying all ways to pack."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                at = rooms.index(room)
                place(k + 1, [*rooms[:at], room - sizes[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0] if sizes else 0


def test_packing_against_all_ways_to_pack(spark):
    rng = random.Random(17)
    tables = [[rng.randint(60, 900) for _ in range(rng.randint(1, 9))] for _ in range(10)]
    tables += [[512, 512, 341, 341, 341, 1024], [600, 500, 424, 524], [1] * 9]
    equal = 0
    for sizes in tables:
        out = packing.place(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartition(3)).collect()
        used = {}
        for r in out:
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):  # gapless
                assert offset == at
                at += length
            assert at <= 1024
        fewest = _fewest(sizes, 1024)
        one = len(packing.best_fit(np.array([s for s in sizes if s < 1024], dtype=np.int64), 1024)) + sizes.count(1024)  # as one task would
        assert fewest <= one <= fewest * 11 / 9 + 6 / 9 and fewest <= len(used) <= one + 1
        equal += len(used) == fewest
    assert equal >= len(tables) - 2


def _shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    texts = []
    for k in range(90):
        base = rng.choices(words, k=rng.randint(8, 70))
        texts.append(" ".join(base))
        if k % 3 == 0:
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", "one", texts[0], texts[0].upper(), texts[5]]
    items = [(k, " ".join(texts[k * 7].split()[:25])) for k in range(5)] + [(9, " ".join(rng.choices(words, k=30)))]
    docs = spark.createDataFrame([(100 + k * 3, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    text_of = {100 + k * 3: t for k, t in enumerate(texts)}
    # near duplicates: the smallest id of each component of links at 0.75 of the full sets
    sets = {d: _shingle_set(t) for d, t in text_of.items()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    deduped = stages["near_dedup"](spark, docs, str(tmp_path))
    kept = sorted(r["doc_id"] for r in deduped.collect())
    assert kept == sorted({root(d) for d in sets}) and len(kept) < len(texts)
    # benchmark passages: documents in which greedy tiles cover half of an item
    clean = stages["decontamination"](spark, deduped, str(tmp_path))
    left = sorted(r["doc_id"] for r in clean.collect())
    assert left == [d for d in kept if not any(_shares_of(text_of[d], x) >= 0.5 for _, x in items)] and len(left) < len(kept)
    # packing: all pieces of what is left, as few sequences as one task's best fit would take
    packed = stages["packing"](spark, clean, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokens.default_tokenizer())
    sizes = {d: len(library.encode(text_of[d] or "", add_special_tokens=False).ids) + 1 for d in left}
    assert sorted((r["doc_id"], r["length"]) for r in packed) == sorted(sizes.items())
    best = packing.best_fit(np.array(list(sizes.values()), dtype=np.int64), 1024)
    assert len({r["sequence_id"] for r in packed}) == len(best)
