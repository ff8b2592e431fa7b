"""Deduplication, classifiers, quality rules, licences and the pipeline: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from termloom.llm import components, langid, licenses, pieces, quality, queries, simhash, substrings, toxicity

DOCS = "doc_id long, text string, lang string, fp long, shard int, digest string, seed long, rank int"  # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, 2, "x", 3, 4) for i, t in rows], DOCS).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- substring dedup


def brute_dedup(rows, window):
    rows = list(dict.fromkeys(rows))
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "window"), [(0, 13), (1, 13), (2, 5), (3, 6), (4, 3)])
def test_substrings_against_brute_force(spark, seed, window):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcde") + rng.choice("xyzé") for _ in range(rng.randrange(5, 40))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(["the", "of", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))]
        rows.append((rng.randrange(0, 1000), rng.choice(["\n", "  ", "\t", "\x0b", " \xa0 "]).join(parts)))
    rows += [(rows[0][0], rows[0][1]), (2000, rows[1][1]), (2001, rows[1][1]), (-5, rows[2][1]), (3000, None), (3001, ""), (3002, " \n"), (None, rows[3][1]), (None, "null id"), (4000, "same " * 50), (4001, "same " * 80), (4002, "a b c"), (4003, "a b c")]
    for shard_bytes in (1 << 20, 600):
        got = [tuple(r)[:4] for r in substrings.dedup_substrings(frame(spark, rows), window=window, shard_bytes=shard_bytes).collect()]
        assert sorted(got, key=repr) == brute_dedup(rows, window)


def test_substrings_keep_layout_and_empty_tables(spark):
    rows = [(1, "a\tb  c"), (2, "p " * 30), (3, "q  " + "p " * 30)]
    got = {r.doc_id: r for r in substrings.dedup_substrings(frame(spark, rows), keep_layout=True).collect()}
    assert got[1].text == "a\tb  c" and got[3].text == "q" and got[1].digest == hashlib.md5(b"a\tb  c").hexdigest()
    assert substrings.dedup_substrings(frame(spark, rows).limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    got = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(frame(spark, [(1, long), (2, "x " + long + " y")])).collect()}
    assert got == {1: 0, 2: 200_000}


def test_long_words_that_hold_the_same_blocks_are_different(spark):
    a, b = "a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096
    fill = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*fill, a])), (2, " ".join([*fill, b])), (3, " ".join([*fill, a]) + " more")]
    got = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    assert len({int(substrings.word_hashes(x.encode(), t)[0]) for x in (a, b) for t in (0, 1)}) == 4


def test_windows_that_share_half_of_their_hash_are_told_apart(spark, monkeypatch):
    rolled = substrings._rolled
    monkeypatch.setattr(substrings, "_rolled", lambda h, n, by: rolled(h, n, by) % np.uint64(3) if by == substrings._A else rolled(h, n, by))
    texts = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(30)).encode()) for i in range(12)]
    keys = {i: (substrings._rolled(substrings.word_hashes(t), 5, substrings._A).view(np.int64), substrings._second_keys(t, 5)) for i, t in texts}
    least = {}
    for i, (k, k2) in keys.items():
        for pair in zip(k.tolist(), k2.tolist()):
            least[pair] = min(least.get(pair, i), i)
    k, k2 = (np.array([p[j] for p in least], t) for j, t in ((0, np.int64), (1, np.int32)))
    passages = substrings.Passages([i for i, _ in texts], [t for _, t in texts], k, k2, np.array(list(least.values()), np.int64), 5)
    want = {i: n for i, _, n, _ in brute_dedup([(i, t.decode()) for i, t in texts], 5)}
    for i, t in texts:
        covered = passages.covered(i, t.split())
        assert (0 if covered is None else int(covered.sum())) == want[i]


# -- SimHash


def brute_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    fps = list(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "délta", "É"]) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 80):
        w = rng.choice(base).split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "one"), (103, "ONE"), (104, "two words"), (5, base[5]), (None, base[5]), (None, "alone in the dark")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fp = {(i, t): brute_fingerprint(t) for i, t in rows}
    root = brute_components(set(fp.values()))
    least = {}
    for (i, _), f in fp.items():
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = Counter((i, f"{fp[i, t]:016x}", least.get(root[fp[i, t]])) for i, t in rows)
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_links_lose_none_between_near_fingerprints(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(3)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = components.components(edges).collect()
    groups = {}
    for node, root in got:
        groups.setdefault(root, set()).add(node % (1 << 64))
    want = {}
    for f, r in brute_components(fps).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("small", [1, 3, 8])
def test_tallies_find_every_link_of_crowded_lists(small, monkeypatch):
    """Fingerprints that crowd the same lists: links by tally and by postings against all pairs."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(small)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    links = set()
    for i, positions in enumerate(simhash.SETS):
        mask = np.uint64(simhash._mask(positions) % (1 << 64))
        own = np.array(fps, np.uint64)
        rows = sorted(zip((own & mask).view(np.int64).tolist(), own.view(np.int64).tolist()))
        keys, values = (np.array(x, np.int64) for x in zip(*rows))
        for out in simhash._found(np.full(len(keys), i, np.int8), keys, values):
            links |= {(int(a) % (1 << 64), int(b) % (1 << 64)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = brute_components(fps)
    group = lambda of: sorted(sorted(g) for g in {r: [f for f in fps if of(f) == r] for r in map(of, fps)}.values())
    assert group(find) == group(want.get)
    x, y = np.array([0x1122334455667788, 0], np.uint64), np.array([0x1122004455660088, 0], np.uint64)
    assert simhash.tally(x, y).tolist() == [6, 8]


def test_dense_lists_give_the_same_roots(monkeypatch):
    rng = np.random.default_rng(4)
    shared = (0, 2, 3, 5, 7)
    free = rng.choice(1 << 24, 400, replace=False).astype(np.uint64)
    free[:200] = (free[0] & np.uint64(0xFFF000)) | rng.choice(1 << 12, 200, replace=False).astype(np.uint64)
    free = np.unique(free)
    spread = sum(((free >> np.uint64(8 * k)) & np.uint64(0xFF)) << np.uint64(8 * p) for k, p in enumerate((1, 4, 6)))
    fp = np.sort(spread | np.uint64(0x1100220033000044 & 0xFF00FF00FFFF00FF))
    by_pairs = simhash._roots_by_pairs(fp)
    monkeypatch.setattr(simhash, "DENSE", 10)
    assert (simhash._roots(fp, shared) == by_pairs).all() and len(set(by_pairs)) < len(fp)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (501, 500)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components.components(edges.limit(0)).count() == 0


# -- language, toxicity


def test_language_on_held_out_rows(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = queries.op7_language_id(spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.rejected for r in got]) < 0.05


def test_language_edges(spark):
    rows = [(i, t) for i, t in enumerate(["the house and the garden are green " * 5, "der garten und das haus sind schön " * 5] * 6)]
    docs = frame(spark, rows).withColumn("lang", queries.F.when(queries.F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = langid.fit(docs, queries.F.lit(True))
    ask = frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the garden"), (5, "und das haus"), (None, "the house"), (4, "the garden"), (6, "das haus " * 100_000)])
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(ask, model).collect()]
    assert Counter(got) == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (None, "en"), (6, "de")])
    assert langid.accepted(ask, model).columns == ask.columns
    assert {r.doc_id for r in langid.accepted(ask, model).collect()}.isdisjoint({1, 2, 3})
    assert langid.identify(ask.limit(0), model).count() == 0
    nothing = langid.fit(docs.limit(0), queries.F.lit(True))
    assert {r.lang_pred for r in langid.identify(ask, nothing).collect()} == {"und"}
    unlabelled = langid.fit(frame(spark, rows), queries.F.lit(True))
    assert unlabelled.langs == []


@pytest.mark.parametrize(("text", "letters"), [("²", False), ("½ ³", False), ("Ⅷ 12_", False), ("", False), ("ª", True), ("12 é", True), ("中", True)])
def test_letters_are_told_by_category(text, letters):
    assert langid.has_letter(text) is letters


def test_a_rejected_language():
    idf = np.ones(langid.N_BINS, np.float32)
    x = langid.normalised(langid.gram_counts("the house and the garden")[None], idf)
    model = langid.LanguageModel(idf, x, ["en"], {"en": 0.5})
    assert [r[2] for r in model.predict(["the house and garden", "zzz qqq xxx", None])] == [False, True, True]


def test_grams_and_nearest_centroids_against_brute_force():
    def plain_counts(text):
        spaced, out = [], np.zeros(langid.N_BINS, int)
        for c in text.lower():
            if "a" <= c <= "z" or ord(c) >= 192:
                spaced.append(c)
            elif not spaced or spaced[-1] != " ":
                spaced.append(" ")
        if spaced and spaced[0] == " ":
            spaced = spaced[1:]
        wide, k = 1 << 32, [int(x) for x in langid._K]
        for n in (1, 2, 3):
            for i in range(len(spaced) - n + 1):
                h = ord(spaced[i]) * k[0] % wide
                for j in range(1, n):
                    h = ((h ^ (h >> 15)) * k[j] + ord(spaced[i + j]) * k[0]) % wide
                out[h >> 20] += 1
        return out

    texts = ["The house, and 12 gardens!", "Über die Straße", "été", "a", "x  y"]
    for t in texts:
        assert (langid.gram_counts(t) == plain_counts(t)).all()
    rng = np.random.default_rng(0)
    idf = rng.uniform(1, 3, langid.N_BINS).astype(np.float32)
    centres = langid.normalised(rng.integers(0, 3, (6, langid.N_BINS)), idf)
    model = langid.LanguageModel(idf, centres, ["a", "a", "b", "b", "c", "c"], dict.fromkeys("abc", 0.0))
    for t, (lang, score, _) in zip(texts, model.predict(texts), strict=True):
        v = [np.log1p(n) * w for n, w in zip(plain_counts(t), idf, strict=True)]
        size = sum(x * x for x in v) ** 0.5
        cosines = [sum(x * y for x, y in zip(v, c, strict=True)) / size for c in centres]
        assert score == pytest.approx(max(cosines), abs=1e-4) and lang == model.langs[int(np.argmax(cosines))]


def plain_risk(w, b, xp, xu, prior):
    sigmoid = lambda x: [1 / (1 + np.exp(-(x_ @ w + b))) for x_ in x]
    p, u = sigmoid(xp), sigmoid(xu)
    return prior * np.mean([1 - s for s in p]) + max(0.0, np.mean(u) - prior * np.mean(p))


@pytest.mark.parametrize("prior", [0.05, 0.3])
def test_nnpu_reaches_the_least_risk_of_a_grid(prior):
    rng = np.random.default_rng(1)
    xp = (rng.random((60, 2)) < (0.9, 0.3)).astype(float)
    n = int(400 * prior)
    xu = np.vstack([(rng.random((n, 2)) < (0.9, 0.3)), (rng.random((400 - n, 2)) < (0.05, 0.3))]).astype(float)
    w, b = toxicity.nnpu(xp, xu, prior)
    grid = [(x, y, z) for x in np.linspace(-8, 8, 9) for y in np.linspace(-8, 8, 9) for z in np.linspace(-8, 8, 9)]
    least = min(plain_risk(np.array([x, y]), z, xp, xu, prior) for x, y, z in grid)
    assert plain_risk(w, b, xp, xu, prior) <= least + 0.02
    assert w[0] > abs(w[1])


def auc(pairs):
    pos, neg = ([s for s, y in pairs if y == k] for k in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_toxicity_on_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = queries.table(spark, folder, "labels").select("doc_id", "toxic")
    got = queries.op8_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert auc([(r.score, r.toxic) for r in got]) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_edges(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["day", "sun", "tree", "road", "lake"]) for _ in range(20)) + (" vile scum" if i % 5 == 0 else "")) for i in range(300)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 3)] + [(0, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, queries.F.lit(True))
    ask = frame(spark, [(1, None), (2, ""), (3, "VILE scum"), (4, "sun lake"), (3, "VILE scum"), (None, "x " * 200_000)])
    got = Counter((r.doc_id, r.predicted) for r in toxicity.score(ask, model).collect())
    assert got == Counter({(1, 0): 1, (2, 0): 1, (3, 1): 2, (4, 0): 1, (None, 0): 1})
    assert toxicity.score(ask.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0), queries.F.lit(True))
    assert {r.score for r in toxicity.score(ask, none).collect()} == {0.0}
    assert not toxicity.fit(docs.limit(0), labels, queries.F.lit(True)).fitted


# -- quality


def brute_counts(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] >= 2 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts_and_divergence(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "a"] if rng.random() < 0.4 else ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(5)]) for _ in range(150)) + "."
    rows = [(i, good()) for i in range(40)]
    odd = {100: " ".join("#$%&" + str(i) for i in range(150)), 101: "a b c " * 40, 102: None, 103: "", 104: "É é\n É é\nÉ é\nÉ é\n\n \n", 105: " ".join(f"WORD{i}!!" for i in range(150))}
    rows += [*odd.items(), (100, odd[100]), (None, rows[0][1])]
    docs = frame(spark, rows).withColumn("lang", queries.F.when(queries.F.col("doc_id") == 105, queries.F.lit(None)).otherwise("en"))
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        counts = brute_counts(rows[0][1] if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in odd)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_every_language_is_measured_by_its_own_documents(spark):
    rng = random.Random(8)
    spoken = {"ru": ("и в не на я что он с как это", "абвгдежз"), "en": ("the of and to in is that it was for", "abcdefgh"), "xx": ("ein der", "abcdefgh")}

    def prose(lang):
        common_, letters = spoken[lang]
        return " ".join(rng.choice(common_.split()) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(160))

    rows = [(i, prose(x), x) for i, x in enumerate(["ru"] * 40 + ["en"] * 40 + ["xx"] * 5)]
    rows += [(100, prose("ru"), "en"), (101, prose("en"), "ru"), (102, prose("ru"), None), (103, " ".join(f"#{i}$" for i in range(200)), "ru"), (104, None, "ru"), (105, "а" * 100_000, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, slots string, n long")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(got[i].kept for i in range(85)) and got[102].kept
    assert not any(got[i].kept for i in (100, 101, 103, 104, 105))
    assert got[80].char_distance == got[80].word_distance == 0  # too few documents for a reference
    assert set(quality.common_words(docs.select("lang", "text"), 5)) == {"ru", "en"}


def test_js_distance():
    p = np.array([[1, 0], [1, 1], [0, 2], [0, 0]])
    d = quality.js_distance(p, np.array([1.0, 1.0]))
    assert d[1] == 0 and d[0] == d[2] == pytest.approx(0.5579, abs=1e-4) and 0 <= d[3] <= 1


# -- licences


def test_licences_are_found_and_inherited(spark):
    mit = "MIT License\n" + licenses.TEMPLATES[4][1]
    rows = [
        ("a/LICENSE", mit), ("a/b/c/x.py", "print(1)"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0"), ("a/y.py", None),
        ("a/z.py", "code and much more code\n# All Rights Reserved.\nmore"), ("other/q.py", "no words here"), ("top.py", "x"), (None, "Released under the MIT License."), ("a/z.py", "code and much more code\n# All Rights Reserved.\nmore"),
        ("a/long.py", "word " * 200_000 + "\nReleased under the MIT License.\n"), ("d/s", "License of the garden, and of trees, grass, and many other things"), ("a/b/e.py", ""),
    ]
    files = spark.createDataFrame([(p, t, "x", 1) for p, t in rows], "path string, text string, license string, section int")
    got = {r.path: (r.own_license, r.license, r.license_source, r.inherited_from) for r in licenses.scan_licenses(files).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", "file", None), "a/b/c/x.py": (None, "Apache-2.0", "inherited", "a/b"), "a/b/LICENSE.txt": ("Apache-2.0", "Apache-2.0", "file", None),
        "a/y.py": (None, "MIT", "inherited", "a"), "a/z.py": ("Proprietary", "Proprietary", "header", None), "other/q.py": (None, None, "none", None), "top.py": (None, None, "none", None),
        None: (None, None, "none", None), "a/long.py": ("MIT", "MIT", "header", None), "d/s": (None, None, "none", None), "a/b/e.py": (None, "Apache-2.0", "inherited", "a/b"),
    }
    assert licenses.scan_licenses(files).count() == len(rows)
    assert licenses.scan_licenses(files.limit(0)).count() == 0
    plan = licenses.scan_licenses(files)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|Cartesian", plan)


def test_whole_texts_titles_and_split_headers(spark):
    text = dict((x, t) for x, t in licenses.TEMPLATES if len(t) > 600)
    half = len(text["MIT"]) // 2
    rows = {
        "mit/LICENSE": f"MIT License\n\nCopyright (c) 2024 Jane Q. Public\n\n{text['MIT'][26:half]}\n\n{text['MIT'][half:]}\n",
        "mit/src/a.py": "print(1)",
        "bsd3/COPYING": "Copyright (c) 2001, Some Company and its friends\nAll rights reserved.\n\n" + text["BSD-3-Clause"].split("reserved. ", 1)[1].replace(". ", ".\n\n"),
        "bsd2/LICENSE.md": "BSD 2-Clause License\n\nCopyright (c) 2019, Someone\n\n" + text["BSD-2-Clause"].split("reserved. ", 1)[1],
        "isc/LICENSE": "Copyright 2020 Someone <a@example.org>\n\n" + text["ISC"],
        "apache/LICENSE": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n"
        + "   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n" + "\n\n".join(f"   {i}. Some long section about grants of rights, Contributors and Derivative Works number {i}." for i in range(40)),
        "gpl/COPYING": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "\n\n".join(f"Paragraph {i} of many words on conveying covered works." for i in range(90)),
        "gpl/a.c": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 2 of the License, or\n// (at your option) any later version.\nint main() {}\n",
        "apache/a.go": '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\npackage a\n',
        "x/s.rs": "// SPDX-License-Identifier: GPL-3.0-or-later\nfn main() {}",
        "x/t.py": "# SPDX-License-Identifier: SomethingElse-9\n",
        "x/u.py": "word " * 300_000,
    }
    files = spark.createDataFrame(list(rows.items()), "path string, text string")
    got = {r.path: (r.license, r.license_source) for r in licenses.scan_licenses(files).collect()}
    assert got == {
        "mit/LICENSE": ("MIT", "file"), "mit/src/a.py": ("MIT", "inherited"), "bsd3/COPYING": ("BSD-3-Clause", "file"), "bsd2/LICENSE.md": ("BSD-2-Clause", "file"),
        "isc/LICENSE": ("ISC", "file"), "apache/LICENSE": ("Apache-2.0", "file"), "gpl/COPYING": ("GPL-3.0", "file"), "gpl/a.c": ("GPL-2.0", "file"),
        "apache/a.go": ("Apache-2.0", "file"), "x/s.rs": ("GPL-3.0", "file"), "x/t.py": ("GPL-3.0", "inherited"), "x/u.py": ("GPL-3.0", "inherited"),
    }


# -- the pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    names = [n for n, _ in cp.STAGES]
    assert names == ["language", "near_duplicates", "substrings", "benchmark", "sentencepiece"]
    docs = queries.table(spark, sf_dir, "documents")
    item = queries.table(spark, sf_dir, "benchmark").first()
    extra = [(9001, "...", "en", "s", 3), (9002, f"Some words before. {item.text}\nand after.", "en", "s", 9), (None, docs.filter("lang = 'en'").first().text[:150] + " without id", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES:
        before = {r.doc_id for r in docs.collect()}
        docs = components.common.materialize(stage(spark, docs, sf_dir), "test-stage")[0]
        rows = docs.collect()
        after = {r.doc_id for r in rows}
        assert after <= before
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "language":
            assert 9001 not in after and len(after) > 0.95 * len(before)
        elif name == "near_duplicates":
            ids = sorted(before - {None})
            every = [texts[i] for i in ids] + [texts[None]]  # a document without id can link others
            groups = {}
            for i, root in zip(ids, brute_copies(every)):
                groups.setdefault(root, set()).add(i)
            assert after - {None} == {min(g) for g in groups.values()} and None in after
        elif name == "substrings":
            want = {i: t for i, _, _, t in brute_dedup([(i, texts[i]) for i in before], 13)}
            assert {r.doc_id: words(r.text) for r in rows} == {i: words(t) for i, t in want.items()}
            assert all(r.n_chars == len(r.text) for r in rows if r.n_chars is not None)
        elif name == "benchmark":
            assert 9002 not in after
        else:
            model = pieces.Pieces(queries.tokenizer_path("piece_bpe_32k.model"))
            assert all(r.round_trip for r in rows if pieces.MARK not in texts[r.doc_id]) and all(model.sp.decode(list(r.ids)) is not None for r in rows[:5])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    show = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted(repr(tuple(show(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(show(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())


def five_words(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_copies(texts):
    """For each text the first one that it reaches over 5-word Jaccard of at least 0.8."""
    sets, root = [five_words(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_stage_drops_what_is_alike_in_five_word_shingles(spark):
    import corpus_pipeline as cp

    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = [" ".join(base)]
    for n in [1, 2, 3, 4, 5, 6] * 6:  # words changed: similarity 0.95 to 0.74
        w = list(base)
        for at in rng.sample(range(200), n):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(n)) for n in (1, 4, 5, 6, 300)] + ["", None, "a b", "A  b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    root = brute_copies(texts)
    for bound, chunk in ((200, 3), (3000, 50)):  # clusters that are too large for a task, in small blocks and parts
        with pytest.MonkeyPatch.context() as m:
            m.setattr(cp.nearcopies, "CLUSTER_BYTES", bound)
            m.setattr(cp.nearcopies, "CHUNK", chunk)
            assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()} == set(root)
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(root) and len(kept) < len(texts) - 20
    assert cp.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("columns", [("text_", "digest_", "id_", "row_", "key_", "least_"), ("KEY_", "Row_", "row__", "component", "shard", "passages")])
def test_stages_with_clashing_columns_nulls_and_empty_tables(spark, sf_dir, columns):
    import corpus_pipeline as cp

    source = queries.table(spark, sf_dir, "documents").drop("n_chars").limit(40)
    item = queries.table(spark, sf_dir, "benchmark").first().text
    extra = [(None, None, None, None), (9001, None, "en", "s"), (9002, "", None, "s"), (9003, f"A {item} b", "en", "s"), (9004, "long words of the text " * 30_000, "en", None), (None, f"B {item} c", "en", "s")]
    docs = source.unionByName(spark.createDataFrame(extra + extra[1:3], source.schema))
    for i, c in enumerate(columns):
        docs = docs.withColumn(c, queries.F.lit(i))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert rows and all(r[c] == i for r in rows for i, c in enumerate(columns)) if name != "sentencepiece" else len(rows) == docs.count()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "substrings":
            assert len(rows) == docs.count()
        if name == "benchmark":
            assert not {r.doc_id for r in rows} & {9003} and {9001, 9002, 9004} <= {r.doc_id for r in rows}
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == out.columns and empty.count() == 0


def test_run_leaves_no_table_but_the_last(spark, tmp_path):
    import corpus_pipeline as cp
    from termloom.sources import shared

    shared.drop_all(spark)
    docs = spark.createDataFrame([(i, f"the house number {i} and the garden of it " * 3, "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0
    assert [p.rsplit("/", 1)[1][:18] for p in shared._made[spark.sparkContext.applicationId]] == ["pipeline-benchmark"]


def test_stage_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as cp

    rng = random.Random(5)
    a, b = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (1, b), (1, b + " more"), (2, a), (3, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == 2 and {i for i, _ in got} == {1} and {t[0] for _, t in got} == {"a", "b"}
