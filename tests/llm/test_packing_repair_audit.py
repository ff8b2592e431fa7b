"""Best-fit packing, conversation repair and divergence audit: against plain readings of what they promise."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import best_fit, conversations, divergence, queries

WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")


# -- best-fit packing


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def placed(steps, counts):
    """(sequence, offset, length) of every piece."""
    for length, n in counts.items():
        own = sorted(s for s in steps if s[0] == length)
        for i in range(n):
            _, first, each, sequence, offset = [s for s in own if s[1] <= i][-1]
            yield sequence + (i - first) // each, offset + (i - first) % each * length, length


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    counts = Counter(lengths)
    ends = defaultdict(int)
    for sequence, offset, length in sorted(placed(best_fit.plan(counts, capacity), counts)):
        assert offset == ends[sequence]  # gapless
        ends[sequence] += length
    assert sorted(capacity - x for x in ends.values()) == plain_best_fit(lengths, capacity)


def test_plan_of_many_pieces_needs_few_steps():
    steps = best_fit.plan({length: 10**9 + length % 7 for length in range(1, 4097)})
    assert len(steps) < 4 * 4096
    with pytest.raises(ValueError, match="capacity"):
        best_fit.plan({5: 1}, 4)


PARTS = [*"aB 'sT1.é\u0301ßΣİ中\u3000\x85\n\x1c", "J\u030c", "I\u0307", "T", "\u0308", "\u0338", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "ok...", "3.14%", "don't.", "It'S!", "a,b", "...", " The", " word,", "##", "中.", "é!"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20).map("".join))
def test_ids_of_words_are_those_of_texts(text):
    own = best_fit.encoder(WORD_BPE)
    assert own.by_word and own.lowers
    whole = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == whole


def test_long_words_are_not_remembered():
    own = best_fit.encoder(WORD_BPE)
    before = len(own.memory.young)
    text = "中文字" * 2000
    assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.memory.young) <= before


def test_tokenizers_that_keep_white_space_get_whole_texts():
    own = best_fit.encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    assert not own.by_word
    assert np.frombuffer(own.encode([b"Two  words. "])[0], "<u4").tolist() == own.tokenizer.encode("Two  words. ", add_special_tokens=False).ids


def test_packed_documents(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "no id"), (1, "a b c"), (7, "word " * 9000), (8, "x " * 4094), (9, "x " * 4095)] + [(i, "and so on " * (i % 40)) for i in range(10, 300)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, length long, ids string, task int").repartition(5)
    packed = best_fit.pack(best_fit.cut(docs, WORD_BPE, keep_ids=True)).collect()
    own = best_fit.encoder(WORD_BPE).tokenizer
    want = Counter()
    for i, t in rows:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert sorted(4096 - x for x in ends.values()) == plain_best_fit([r["length"] for r in packed], 4096)
    whole = best_fit.sequences(spark.createDataFrame(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")).collect()
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in whole} == dict(ends)
    assert all(sum(r["lengths"]) * 4 == len(r["ids"]) for r in whole)
    assert best_fit.pack(best_fit.cut(docs.limit(0), WORD_BPE)).count() == 0


# -- conversation repair


def brute_repair(symbols):
    """(cost, audit) by trying every repaired sequence of edits, up to two insertions at a place."""
    best = None

    def walk(i, after, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(symbols) and after in ("", "a") and (best is None or (cost, audit) < best):
            best = (cost, audit)
        wants = "a" if after == "u" else "u"
        if not audit.endswith("II"):
            walk(i, wants, cost + 5, audit + "I")
        if i == len(symbols):
            return
        x = symbols[i]
        walk(i + 1, after, cost + 2, audit + "D")
        if x == "d":
            return
        late = 5 if x.isupper() else 0
        walk(i + 1, wants, cost + 1 + late, audit + "R")
        if x.lower() == wants:
            walk(i + 1, wants, cost + late, audit + "K")
        elif x.lower() == "s" and after == "" and set(audit) <= {"D"}:
            walk(i + 1, "s", cost + late, audit + "K")

    walk(0, "", 0, "")
    return best


def test_cheapest_edits_against_every_sequence_of_edits():
    rng = random.Random(5)
    cases = ["".join(x) for n in range(4) for x in itertools.product("suaxSUAd", repeat=n)]
    cases += ["".join(rng.choice("suaxSUAXdua") for _ in range(rng.randrange(4, 8))) for _ in range(400)]
    trie = conversations.Trie()
    for signature in sorted(x[::-1] for x in cases):
        assert trie.answer(signature) == brute_repair(signature[::-1]), signature[::-1]


def test_trie_computes_a_node_once():
    rng = random.Random(6)
    signatures = sorted("".join(rng.choice("uad") for _ in range(rng.randrange(12))) for _ in range(3000))
    trie = conversations.Trie()
    for x in signatures:
        trie.answer(x)
    assert trie.computed == len({x[:k] for x in signatures for k in range(1, len(x) + 1)})
    one = conversations.Trie()
    assert one.answer("a" * 50_000)[0] == conversations.Trie().answer("a" * 50_000)[0]


TURNS = [
    (1, 0, "system", "You help."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (1, 3, "user", "Hello?"), (1, 5, "assistant", "cut off"),
    (2, None, "user", "no turn."), (2, None, None, "no role."), (2, 4, "assistant", None), (2, 4, "assistant", "tie."), (2, 4, "assistant", "tie."),
    (None, 1, "user", "x."), (None, 2, "tool", "y. \n"), (3, 0, "user", " \t"), (4, 7, "", "blank role."), (5, 1, "assistant", "long. " * 30_000 + "end!"),
    (5, -3, "User", "case."), (6, 1, "ünal", "a."), (6, 2, "user", "b\x1f"),
]


def plain_answers(rows):
    """The contract read line by line, over rows after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        known = [r[1] for r in own if r[1] is not None]
        seen, faults = set(), []
        for r in own:
            body = r[3].rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (r[2], r[3]) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((r[2], r[3]))
        symbols = "".join("d" if f in ("b", "d") else (k if f == "" else k.upper()) for f, k in zip(faults, [r[2][:1] if r[2][:1] in ("s", "u", "a") and r[2] else "x" for r in own], strict=True))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = brute_repair(symbols)
        lines, at, after = [], 0, ""
        for edit in audit:
            row = None if edit == "I" else own[at]
            at += edit != "I"
            if edit == "D":
                continue
            after = "s" if edit == "K" and row[2][0] == "s" and not lines else "a" if after == "u" else "u"
            role = row[2] if edit == "K" else {"u": "user", "a": "assistant"}[after]
            lines.append(f"{role}:{row[3] if row else ''}")
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def test_repairs_against_a_plain_reading(spark):
    rows = spark.createDataFrame([(*r, 1, "x") for r in TURNS], "conv_id long, turn long, role string, text string, cost long, signature string").repartition(3)
    answers = conversations.cheapest_edits(conversations.signatures(rows))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.digests(rows, answers).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    want = plain_answers([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in TURNS])
    assert got == {k: v[:-1] for k, v in want.items()}
    turns = defaultdict(list)
    for r in sorted(conversations.repaired(rows, answers).collect(), key=lambda r: r["place"]):
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert dict(turns) == {k: v[-1] for k, v in want.items() if v[-1]}


def test_conversations_without_rows_and_an_empty_table(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    answers = conversations.cheapest_edits(conversations.signatures(rows.filter("conv_id = 3"), rows))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.digests(rows.filter("conv_id = 3"), answers).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[4] == (0, "", 0, 0, 0, 0, 0, empty)
    assert got[3] == (2, "D", 0, 1, 0, 0, 0, empty)
    assert len(got) == 7
    none = rows.limit(0)
    assert conversations.digests(none, conversations.cheapest_edits(conversations.signatures(none))).count() == 0


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, r, x) for c in (1, None, 77) for t in (None, *range(12)) for r, x in (("assistant", f"Text {c} {t}. Yes!"), (None, None))]
    want = Counter()
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = r or " ", x or " "
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        want[c, t, "user" if code == 4 else role, text] += {0: 0, 3: 2}.get(code, 1)
    got = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(map(tuple, got.collect())) == +want


# -- divergence audit


def plain_divergence(rows, min_docs, top):
    rows = [(lang or "", source or "", [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(t for r in rows if r[0] == lang for t in set(r[2]))
        kept = [t for t, n in docs.items() if n >= min_docs]
        sources = {r[1] for r in rows if r[0] == lang}
        count = {s: Counter(t for r in rows if r[0] == lang and r[1] == s for t in r[2] if t in set(kept)) for s in sources}
        total = sum(count.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p(count[s], t), p(count[o], t)) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p(count[s], t), p(total, t))) for t in kept if count[s][t] and p(count[s], t) > p(total, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "chunk_rows", "cells"), [(0, 50_000, 1 << 20), (1, 7, 40), (2, 3, 1)])
def test_divergence_against_plain_integers(spark, monkeypatch, seed, chunk_rows, cells):
    monkeypatch.setattr(divergence, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_TERMS", 10 * chunk_rows)
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{'é中ÉZß'[i % 5] * (i % 3)}" for i in range(60)] + ["Don't", "x1y", "\x85q", "\xa0", "ﬁ", "😀"]
    rows = [(rng.choice(["de", "en", "en", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "é", "z", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for _ in range(150)]
    rows += [("xx", "lone", "only once"), ("xx", "other", None), ("en", "mute", ""), ("en", "mute2", "1 2 3"), rows[0], rows[0], ("yy", "alone", "a a a a")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, source string, text string, n long, chunk int, term string").repartition(4)
    got = sorted(map(tuple, divergence.divergence(docs, top=5).collect()))
    assert got == plain_divergence(rows, 3, 5)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_scaled_probabilities_are_exact_beyond_64_bits():
    rng = random.Random(3)
    totals = [rng.randrange(1, 9 * 10**15) for _ in range(500)]
    counts = [rng.randrange(0, t) for t in totals]
    got = divergence.scaled(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]


def test_counts_beyond_doubles_are_exact():
    n = np.array([2**53 + 1, 3, 2**60 + 7])
    assert divergence._dense(np.array([0, 1, 1]), np.array([2, 0, 2]), n, 2, 3).tolist() == [[0, 0, 2**53 + 1], [3, 0, 2**60 + 7]]


def test_a_long_word_and_hot_terms(spark):
    rows = [("en", "a", "x" * 3_000_000 + " the" * 50_000)] * 3 + [("en", f"s{i}", "the cat") for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.divergence(docs).filter("source = 'a' and part = 'term'").collect()
    assert {r["item"] for r in got} <= {"x" * 3_000_000, "the"}
