"""SentencePiece, token ids, HTML, decontamination: against libraries and brute force."""

from __future__ import annotations

import io
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import decontaminate as D
from termloom.llm import html_text, packing, pieces, queries, token_ids

TEXT = st.text(alphabet="abc ABC\t\n\x0b\x0c\r .,'1é²ßЖ漢🎉▁\xa0\x1c\x85_#<|endoftext|>", max_size=60)
DOCS = "doc_id long, text string, ids string, shard int, score string"  # extra columns with clashing names


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(queries.tokenizer_path("piece_bpe_32k.model"))


# -- SentencePiece


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_equal_the_library_and_decode(model, text):
    ids = model.encode(text).tolist()
    assert ids == model.sp.encode(text)
    assert model.decode(ids) == text.replace(pieces.MARK, " ")  # the mark itself is a space to the library, too


def test_a_word_before_different_marks_is_encoded_once():
    own = pieces.Pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    texts = ["a thousandfold word, thousandfold.\nThe thousandfold! thousandfold&&& (thousandfold%%%", "no thousandfold;\tor thousandfold"]
    assert [own.encode(t).tolist() for t in texts] == own.sp.encode(texts)
    assert sorted(p for p in own.cache.young if "thous" in p) == ["thousandfold", "▁thousandfold"]


def test_parts_of_long_texts_are_cut_alike(model, monkeypatch):
    texts = ["", "ab " * 9 + "漢字\n\n▁▁x.y,zé  the end." * 5, "x" * 50, "", "to be.\nOr not"]
    norms = [model.sp.normalize(t) for t in texts]
    whole = [model.parts(n) for n in norms]
    assert ["".join(p) for p in whole] == norms and all(p for parts in whole for p in parts)
    for size in (1, 2, 7):
        monkeypatch.setattr(pieces, "BLOCK_CHARS", size)
        assert [model.parts(n) for n in norms] == whole
        assert [x.tolist() for x in model.encode_all(texts)] == model.sp.encode(texts)
    assert list(model.encode_all([])) == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=2, max_size=5), max_size=25), st.integers(1, 8), st.randoms(use_true_random=False))
def test_pieces_stay_apart_as_merging_all_their_characters_says(strings, n_ranks, rng):
    """Any ranks, equal ones and ones that are no order of merges, too."""
    own = object.__new__(pieces.Pieces)
    own.piece = ["a", "b", "c", *sorted(strings)]
    own.n, own.pairs, own.ends = len(own.piece), {}, {}
    own.rank = {p: float(-rng.randrange(n_ranks)) for p in own.piece}
    for i, p in enumerate(own.piece):
        assert own._stands_alone(i) == (own.merge(p) == [p])
        for j, q in enumerate(own.piece):
            assert own._follows(i, j) == (own.merge(p + q) == [p, q])


def brute_viterbi(word, score):
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + score[word[s:end]], best[s][1] + [word[s:end]]) for s in range(end) if s in best and word[s:end] in score]
        if options:
            best[end] = max(options, key=lambda o: o[0])
    return best[len(word)][0]


def test_unigram_paths_have_the_best_sum():
    own = pieces.Pieces(queries.tokenizer_path("piece_bpe_32k.model"), "unigram")
    score = {p: own.score[i] for p, i in own.id.items()}
    for word in ("▁the", "▁internationalisation", "▁aab", "tionheand", "▁ererer"):
        ids = own.viterbi(word)
        assert "".join(own.piece[i] for i in ids) == word
        assert sum(own.score[i] for i in ids) == pytest.approx(brute_viterbi(word, score))


def with_model_type(path, kind):
    """The model file with another number in field 3 of its trainer settings (field 2): 1 is unigram, 2 is BPE."""
    data = bytearray(open(path, "rb").read())

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    def fields(at, stop):
        while at < stop:
            tag, at = varint(at)
            size = 0
            if tag & 7 == 2:
                size, at = varint(at)
            yield tag >> 3, at, at + size
            at = at + size if tag & 7 == 2 else varint(at)[1] if tag & 7 == 0 else at + (4 if tag & 7 == 5 else 8)

    for number, a, b in list(fields(0, len(data))):
        if number == 2:
            for inner, at, _ in fields(a, b):
                if inner == 3:
                    data[at] = kind
    return bytes(data)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces as a unigram model, whose segmentation is the best sum of scores: nothing is trained."""
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(with_model_type(queries.tokenizer_path("piece_bpe_32k.model"), 1))
    return str(path)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_unigram_ids_equal_the_library(unigram, text):
    own = pieces.pieces(unigram, "unigram")
    assert own.encode(text).tolist() == own.sp.encode(text)
    assert own.decode(own.encode(text)) == text.replace(pieces.MARK, " ")


def test_unigram_paths_of_the_words_of_documents(spark, sf_dir, unigram):
    """No word gets a path with a smaller sum than the library's, and nearly all get the same path."""
    own = pieces.pieces(unigram, "unigram")
    words = {w for r in queries.table(spark, sf_dir, "documents").select("text").collect() for w in (r.text or "").split()}
    value = lambda ids: sum(own.score[i] for i in ids)
    same = 0
    for w in words:
        ids, theirs = own.encode(w).tolist(), own.sp.encode(w)
        assert value(ids) >= value(theirs) and own.decode(ids) == own.decode(theirs) == w
        same += ids == theirs
    assert same > 0.99 * len(words) > 1000


def test_encode_and_decode_frames(spark):
    rows = [(1, "Hello  world\n", "x", 1, "y"), (2, None, None, None, None), (3, "", "", 0, ""), (None, "a", "", 0, ""), (1, "Hello  world\n", "x", 1, "y"), (4, "ab " * 20_000, "", 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    path = queries.tokenizer_path("piece_bpe_32k.model")
    found = pieces.encode(docs, path)
    got = found.collect()
    assert len(got) == 6 and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    assert [r.n_pieces for r in got if r.doc_id in (2, 3)] == [0, 0]
    back = pieces.decode(found, path).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in rows)
    assert pieces.encode(docs.limit(0), path).count() == 0


# -- token ids


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_packing_round_trips(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    assert (packing.unpack(packing.pack(ids, bits), bits, len(ids)) == ids).all()
    assert len(packing.pack(ids, bits)) == -(-len(ids) // 64) * 8 * bits


def test_packing_rejects_wide_ids_and_counts_bits():
    with pytest.raises(ValueError):
        packing.pack(np.array([4], np.uint32), 2)
    assert [packing.bits_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("block", [64, 100, 1000])
def test_files_allow_random_access(block):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 700, 0, 3)]
    sink = io.BytesIO()
    writer = packing.Writer(sink, 13, block)
    for i, d in enumerate(docs):
        writer.add(i * 10, d)
    writer.close()
    reader = packing.Reader(io.BytesIO(sink.getvalue()))
    assert reader.n_ids == sum(map(len, docs)) and reader.doc_ids.tolist() == [i * 10 for i in range(8)]
    for i in (5, 0, 3, 7, 2):
        assert (reader.doc(i) == docs[i]).all()
    for (doc_id, start, parts), d, i in zip(reader.docs(), docs, range(8), strict=True):
        assert doc_id == i * 10 and (np.concatenate([np.zeros(0, np.uint32), *parts]) == d).all() and start == reader.starts[i]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_equal_the_library(text):
    own = token_ids.encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_written_and_read_back(spark):
    texts = {9: "last one", 3: None, 5: "", 7: "Größe " * 3000, 1: "tie", -4: "first"}
    rows = [(i, t, "", 0, "") for i, t in texts.items()] + [(1, "tie", "", 0, ""), (None, "no id", "", 0, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    got = [tuple(r) for r in token_ids.read_ids(token_ids.write_ids(docs, path, shard_bytes=4000)).collect()]
    own, want, start = token_ids.encoder(path).tokenizer, [], 0
    for i in sorted([*texts, 1]):
        ids = [*own.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got) == want
    assert token_ids.read_ids(token_ids.write_ids(docs.limit(0), path)).count() == 0


# -- decontamination

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards boil strong potions near the old mill every single night of the year"


def edits(text, n, seed):
    rng, s = random.Random(seed), list(text)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = "§"
        elif kind == 1:
            s.insert(at, "§")
        else:
            del s[at]
    return "".join(s)


def brute_distance(item, text):
    """Fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(25))
def test_passages_within_the_budget_are_found(seed):
    k = int(0.1 * len(ITEM))
    rng = random.Random(seed)
    filler = " ".join(rng.choice(["of", "mill", "year", "night", "fox", "zzz"]) for _ in range(60))
    passage = edits(ITEM, rng.randrange(0, 2 * k), seed)
    text = D.normalise(f"{filler} {passage} {filler}")
    found = D.Matcher([(7, ITEM)], 0.1, 8).find(text)
    distance = brute_distance(ITEM, text)
    assert bool(found) == (distance <= k)
    if found:
        assert min(f[3] for f in found) == distance
        for _, a, b, n in found:
            assert 0 <= a <= b <= len(text) and n <= k


def test_align_agrees_with_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        item, text = ("".join(rng.choice("ab ") for _ in range(n)) for n in (rng.randrange(1, 12), rng.randrange(1, 30)))
        got = D.align(D.codes(item), D.codes(text), len(item))
        assert got is not None and got[0] == brute_distance(item, text)


def test_a_band_gives_what_its_diagonals_hold():
    rng = random.Random(6)
    for _ in range(300):
        m, n = rng.randrange(1, 12), rng.randrange(0, 25)
        item, text = ("".join(rng.choice("ab") for _ in range(x)) for x in (m, n))
        low = rng.randrange(-m, n + 1)
        high = rng.randrange(low, n + 1)
        inside = lambda i, j: low <= j - i <= high
        cost = {}
        for j in range(n + 1):
            for i in range(m + 1):
                if inside(i, j):
                    options = [0] if i == 0 else []
                    if j == 0:
                        options.append(i)
                    if i and j and (i - 1, j - 1) in cost:
                        options.append(cost[i - 1, j - 1] + (item[i - 1] != text[j - 1]))
                    if j and (i, j - 1) in cost:
                        options.append(cost[i, j - 1] + 1)
                    if i and (i - 1, j) in cost:
                        options.append(cost[i - 1, j] + 1)
                    if options:
                        cost[i, j] = min(options)
        want = min((cost[m, j] for j in range(n + 1) if (m, j) in cost), default=None)
        got = D.align(D.codes(item), D.codes(text), m, low, high)
        assert (got[0] if got else None) == (want if want is not None and want <= m else None)
        if got:
            assert brute_distance(item, text[got[1] : got[2]]) <= got[0]


@pytest.mark.parametrize(("item", "unit"), [("ab " * 30, "ab "), ("0" * 300, "0"), ("-=" * 100, "-=")])
def test_repetitive_texts_take_linear_time(item, unit):
    import time

    matcher = D.Matcher([(1, D.normalise(item))], 0.1, 8)
    took = []
    for n in (40_000, 160_000):
        text = D.normalise("some words before " + unit * (n // len(unit)) + " and after")
        start = time.perf_counter()
        found = matcher.find(text)
        took.append(time.perf_counter() - start)
        assert found and found[0][3] == 0
    assert took[1] < 12 * took[0] + 1 and took[1] < 60


def test_repetitive_texts_within_the_budget_of_edits():
    rng = random.Random(9)
    for seed in range(30):
        item = "ab " * rng.randrange(6, 12) + rng.choice(["", "xyz ", "ba "]) + "ab " * 5
        item = D.normalise(item)
        text = D.normalise("q " * rng.randrange(0, 9) + edits("ab " * rng.randrange(5, 30), rng.randrange(0, 8), seed) + " end")
        found = D.Matcher([(1, item)], 0.1, 8).find(text)
        distance = brute_distance(item, text)
        assert bool(found) == (distance <= int(0.1 * len(item)))
        if found:
            assert min(f[3] for f in found) == distance


def test_short_items_use_smaller_grams():
    for m in range(1, 60):
        k, q, t = D.budget(m, 0.1, 8)
        assert 1 <= q <= 8 and (t >= 1 or q == 1)
    assert D.Matcher([(1, "abc")], 0.1, 8).find("xx abc yy") and not D.Matcher([(1, "abc")], 0.1, 8).find("xx abd yy")


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=12), st.text("ab c", max_size=40), st.integers(0, 4))
def test_columns_of_bits_tell_what_the_alignment_finds(item, text, k):
    found = D.align(D.codes(item), D.codes(text), k)
    assert D.within(D._masks(item), len(item), D.codes(text).tolist(), k) == (found is not None)


def test_items_that_share_a_sentence_or_a_vocabulary_cost_little():
    rng = random.Random(3)
    words = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    sentence = "choose the best answer to the following question and explain it"
    own = [f"w{i}" for i in range(900)]
    for items, text, most in (
        ([f"{sentence} {words(12, own)}" for _ in range(2000)], f"{words(200, own)} {sentence} {words(200, own)}", 1.5),
        ([words(60, ["one", "two", "three", "four", "five"]) for _ in range(200)], words(500, ["one", "two", "three", "four", "five"]), 3),
    ):
        matcher = D.Matcher([(i, D.normalise(x)) for i, x in enumerate(items)], 0.1, 8)
        started = time.process_time()
        matcher.find(D.normalise(text))
        assert time.process_time() - started < most


def test_short_items_stand_alone_and_the_shortest_are_ignored(spark):
    matcher = D.Matcher([(1, "abc def g")], 0.1, 8)
    assert not matcher.find("xabc def g") and not matcher.find("abc def gh") and matcher.find("xabc def g abc def g.")
    benchmark = spark.createDataFrame([(1, "Yes."), (2, "abc"), (3, " a  b  c "), (4, None), (5, "abcd efgh"), (6, "a long enough passage")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "said yes. abc"), (2, "xabcd efgh"), (3, "abcd efgh"), (4, "a long enaugh passage")], "doc_id long, text string")
    assert {r.doc_id: [p.item_id for p in r.passages] for r in D.find_passages(docs, benchmark).collect()} == {1: [], 2: [], 3: [5], 4: [6]}
    assert tuple(D.ignored_items(benchmark).first()) == (6, 4)
    assert tuple(D.ignored_items(benchmark.limit(0)).first()) == (0, 0)


def test_many_blocks_are_opened_once(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 1)
    benchmark = spark.createDataFrame([(i, f"passage number {i} of many") for i in range(70)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"text passage number {i} of many text") for i in range(0, 90, 3)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [p.item_id for p in r.passages if p.edits == 0] for r in D.find_passages(docs, benchmark).collect()}
    assert got == {i: [i] if i < 70 else [] for i in range(0, 90, 3)}


def test_decontaminate_frames(spark):
    docs = spark.createDataFrame([(1, f"Start. {ITEM.upper()}\n end", "", 0, ""), (2, None, "", 0, ""), (3, "", "", 0, ""), (4, "clean words only", "", 0, ""), (1, f"Start. {ITEM.upper()}\n end", "", 0, ""), (5, "x " * 300_000 + ITEM, "", 0, "")], DOCS)
    benchmark = spark.createDataFrame([(10, ITEM), (11, ITEM.replace(" ", "\n")), (12, None), (13, " ")], "item_id long, text string")
    rows = D.find_passages(docs, benchmark).collect()
    assert sorted((r.doc_id, sorted({p.item_id for p in r.passages})) for r in rows) == [(1, [10, 11]), (1, [10, 11]), (2, []), (3, []), (4, []), (5, [10, 11])]
    assert sorted(r.doc_id for r in D.clean(docs, benchmark).collect()) == [2, 3, 4]
    assert D.clean(docs, benchmark).columns == docs.columns
    none = D.find_passages(docs, benchmark.limit(0)).collect()
    assert len(none) == 6 and not any(r.passages for r in none)
    assert D.find_passages(docs.limit(0), benchmark).count() == 0


def test_blocks_of_items_give_one_row_a_document(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 1)
    docs = spark.createDataFrame([(1, ITEM), (2, "other words"), (None, ITEM), (1, ITEM)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, ITEM), (11, "other words")], "item_id long, text string")
    rows = sorted(((r.doc_id or 0, [p.item_id for p in r.passages]) for r in D.find_passages(docs, benchmark).collect()))
    assert rows == [(0, [10]), (1, [10]), (1, [10]), (2, [11])]


# -- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site name and a long slogan that is text</a></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies, lots of cookies, please accept all of our cookies.</div>
<div class="page has-sidebar"><div id=content><h1>Head&shy;line &amp; more</h1><p>First   paragraph with
many words, and <b>bold</b> ones&nbsp;too, enough of them to count.<p>Second one<br>after a break, also with a good number of words.
<div class=ad>Buy now, the best offer of the year, only today!</div><p>Short.<ul><li>Point one of the list<li>Point two</ul>
<blockquote>Quoted words &lt;tag&gt; of someone.</blockquote></div>
<aside>Related stories that nobody wants to read, really not.</aside></div>
<form><label>Name</label><input></form><div id="comments"><p>Reader comment with a lot of words that must not be taken as text.</p></div>
<footer>&copy; 2020 All rights reserved by the site and so on</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "\n".join([
        "Head\xadline & more", "First paragraph with many words, and bold ones too, enough of them to count.",
        "Second one after a break, also with a good number of words.", "Short.", "Point one of the list", "Point two", "Quoted words <tag> of someone.",
    ])


LONG, SHORT = "long words of a story " * 90, "A second section of few words."
MENU = "<nav><a href=/>Home</a></nav>"


@pytest.mark.parametrize(("html", "want"), [
    (f"<body>{MENU}<article><h1>T</h1><p>lead</p><div class=entry><p>{LONG}</p></div></article></body>", ["T", "lead", LONG]),
    (f"<body>{MENU}<main><article><section><p>{LONG}</p></section><section><p>{SHORT}</p></section></article><div><p>{SHORT}</p></div></main></body>", [LONG, SHORT]),
    (f"<body>{MENU}<main><h1>T</h1><div><p>{LONG}</p></div></main><div><p>{SHORT}</p></div></body>", ["T", LONG]),
    (f"<body>{MENU}<article><p>lead</p><article><p>{LONG}</p></article></article></body>", ["lead", LONG]),
    (f"<body>{MENU}<div id=a><div>{f'<p>{LONG}</p>' * 19}</div><div><p>{LONG}</p></div></div></body>", [LONG] * 20),
])
def test_main_text_is_the_whole_article(html, want):
    assert html_text.main_text(html) == "\n".join(" ".join(t.split()) for t in want)


PROSE = "<p>" + "Plain words of the article that go on for a while. " * 6 + "</p>"


@pytest.mark.parametrize(("part", "kept"), [
    ('<section id="social-impact"><h2>Impact</h2><p>It changed how people talk to each other and what they read.</p></section>', "Impact\nIt changed how people talk to each other and what they read."),
    ('<h2 id="related-work">Related work</h2>', "Related work"),
    ('<h2 class="header">Part two</h2>', "Part two"),
    ('<pre><code>x = 1 <span class="token comment"># one</span></code></pre>', "x = 1 # one"),
    ("<p>Here <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is a sum.</p>", "Here a+b is a sum."),
    ("<p>The <label>left column</label> has names.</p>", "The left column has names."),
    ('<div class="notice"><p>' + "This notice is a part of the story and is told in as many words as the rest of the article. " * 4 + "</p></div>", " ".join(["This notice is a part of the story and is told in as many words as the rest of the article."] * 4)),
    ('<div class="comment-list comments"><p>' + "A reader says a great many things here. " * 5 + "</p></div>", None),
    ('<div class="ad">Buy now, the best offer of the year, only today!</div>', None),
    ('<div class="menu"><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></div>', None),
    ('<ul class="share-buttons social"><li><a href=x>Post it</a><li><a href=y>Mail it</a></ul>', None),
    ('<div class="newsletter-signup"><p>Get the best stories by mail every week, free of charge.</p></div>', None),
    ('<aside class="pull">Other stories</aside>', None),
    ("<form><label>Name</label><input></form>", None),
])
def test_what_names_take_out_of_an_article(part, kept):
    own = " ".join("Plain words of the article that go on for a while." for _ in range(6))
    for around in ("article", "main"):
        got = html_text.main_text(f"<body>{MENU}<{around}>{PROSE * 3}{part}{PROSE}</{around}><footer>end</footer></body>")
        assert got == "\n".join([own] * 3 + ([kept] if kept else []) + [own])


def test_pages_against_a_plain_reading_of_their_articles(spark, sf_dir):
    """The pages of the tables have one article each; here it is cut out by patterns."""
    import html as entities
    import re

    n = 0
    for r in queries.op5_html_text(spark, sf_dir).join(queries.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        found = re.search(r"<article[^>]*>(.*?)</article>", r.html or "", re.S)
        if not found:
            continue
        text = re.sub(r"(?s)<!--.*?-->|<(script|style|aside|nav|form|footer|header)\b.*?</\1>", "", found[1])
        text = re.sub(r'(?s)<(div|ul|section|p)[^>]*class="[^"]*"[^>]*>.*?</\1>', "", text)
        blocks = re.split(r"</?(?:p|h[1-6]|li|ul|ol|div|section|blockquote|table|tr|td|pre)\b[^>]*>", text)
        blocks = [" ".join(entities.unescape(re.sub(r"<br\b[^>]*>", " ", b).replace("\x00", "")).split()) for b in (re.sub(r"<(?!br\b)[^>]*>", "", x) for x in blocks)]
        n += r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert n >= 0.98 * queries.table(spark, sf_dir, "pages").count()


@pytest.mark.parametrize("html", ["", "   ", "<p></p>", "<script>x</script>", "<nav><a>x</a></nav>", "<", "&", "<p", "</p></div>"])
def test_pages_without_text(html):
    assert html_text.main_text(html).strip() in ("", "<", "&", "<p")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<nav>", "</nav>", "text ", "&amp;", "&#0;", "<br>", "<td>", "</article>", "<article>", "<div>" * 3000, "<!-- x", "-->", "<script>", "</script>"]), max_size=40))
def test_broken_markup_does_not_crash(parts):
    assert isinstance(html_text.main_text("".join(parts)), str)


LONG = "A long paragraph of running text that says a lot of things. " * 6
PARA = f"<p>{LONG}</p>"
TEXT = LONG.strip()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body><p>a<![foo[bar]]>b</p>", ["ab"]),
        ("<body><p>a<![CDATA[x]]>b<![endif]>c<!foo>d<?php x ?>e</p>", ["abcde"]),
        (f"<form><div class=nav><a href=1>one</a></div><article><h1>T</h1>{PARA}</article></form>", ["T", TEXT]),
        (f"<form action=x><h1>T</h1>{PARA}{PARA}<input name=q></form>", ["T", TEXT, TEXT]),
        (f"<form role=search><label>Find</label></form><div>{PARA}{PARA}</div><footer>{PARA * 5}</footer>", [TEXT, TEXT]),
        (f"<div class=post><div class='post-header'><h1>Title</h1></div>{PARA}{PARA}</div>", ["Title", TEXT, TEXT]),
        (f"<div class=post><h2><a href=x>Linked title</a></h2>{PARA}<p><a href=y>{LONG}</a></p>{PARA}<ul><li><a href=1>aa</a></li><li><a href=2>{LONG}</a></li></ul></div>", ["Linked title", TEXT, TEXT, TEXT]),
        (f"<div><h1>T</h1>{PARA}<div id='related-work'><h2>Related</h2>{PARA}</div>{PARA}</div>", ["T", TEXT, "Related", TEXT, TEXT]),
        (f"<article><h1>T</h1>{PARA}<div class='comment-list'><div>{PARA}</div></div></article>", ["T", TEXT]),
        (f"<article><h1>T</h1>{PARA}<ol class='commentlist'><li class='comment'>{PARA * 4}</li></ol></article>", ["T", TEXT]),
        (f"<div class=post><h1>T</h1>{PARA}</div><ol class=commentlist><li class=comment>{PARA * 4}</li></ol>", ["T", TEXT]),
        (f"<article><h1>T</h1><div class=commentary>{PARA}</div></article>", ["T", TEXT]),
        (f"<div id=comments>{PARA}</div><footer>Imprint</footer>", [""]),
        (f"<body>{PARA}<!-- without end {PARA}", [TEXT]),
        (f"<body>{PARA}<p>5 < 6 and <b un", [TEXT, "5 < 6 and"]),
    ],
)
def test_pages_that_lost_text_or_kept_too_much(html, want):
    assert html_text.main_text(html).split("\n") == want


@pytest.mark.parametrize("unit", ["<!--", "<![", "<![CDATA[", "<?", "<a ", "</", "<!", "<a b='", "<form>", "<div class=nav>", "<!-- x -->"])
@pytest.mark.parametrize("tail", ["", ">", "x"])
def test_markup_takes_linear_time(unit, tail):
    started = time.process_time()
    html_text.main_text(unit * 30_000 + tail)
    assert time.process_time() - started < 3


def test_extract_frames(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>A &#228; b</p></article>", "x"), (2, None, None, None), (1, "u", "<article><p>A &#228; b</p></article>", "x"), (3, "w", "<p>" + "word " * 100_000, "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id, r.text[:5]) for r in rows) == [(1, "A ä b"), (1, "A ä b"), (2, ""), (3, "word ")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_whole_widths_have_the_bytes_of_shifted_ones(monkeypatch):
    rng = np.random.default_rng(1)
    for bits in (8, 16, 32):
        ids = rng.integers(0, 1 << bits, 200, dtype=np.uint64).astype(np.uint32)
        plain = packing.pack(ids, bits)
        with monkeypatch.context() as m:
            m.setattr(packing, "_WHOLE", {})
            assert packing.pack(ids, bits) == plain and (packing.unpack(plain, bits, 200) == ids).all()
        assert (packing.unpack(plain, bits, 200) == ids).all()
