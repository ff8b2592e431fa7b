"""Tokens, BM25 and expansion on hand-made fixtures."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import stem
from termloom.functions import text as T
from termloom.operators import bm25, expansion, index, subwords

DOCS = [
    ("d1", "machine learning algorithms build models from data"),
    ("d2", "deep learning uses neural networks and data"),
    ("d3", "support vector machines are machine learning algorithms"),
    ("d4", "artificial intelligence and data science"),
    ("d5", "the the the"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string")


@pytest.fixture(scope="module")
def idx(docs):
    return index.build_index(docs)


def terms(spark, **queries):
    rows = [(q, i, t) for q, text in queries.items() for i, t in enumerate(text.split())]
    return spark.createDataFrame(rows, "qid string, pos int, term string")


def test_tokens_keep_letters_and_digits_of_any_script(spark):
    row = spark.sql("SELECT 'Größe, 42-mal É!' AS text").select(T.tokens(F.col("text")).alias("t")).first()
    assert row.t == ["größe", "42", "mal", "é"]


def test_null_and_empty_texts_have_no_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " .,")], "id int, text string")
    assert T.token_rows(df, "id").count() == 0


def test_subwords_are_merged_with_exclusive_ends(spark):
    df = spark.createDataFrame([("a", ["play", "##ing", "chess"])], "key string, pieces array<string>")
    rows = T.merge_subwords(df, "key").orderBy("word_idx").collect()
    assert [(r.word, r.word_idx, r.start_pos, r.end_pos) for r in rows] == [("playing", 0, 0, 2), ("chess", 1, 2, 3)]


def test_terms_are_cut_into_the_longest_pieces(spark):
    vocabulary = spark.createDataFrame([("un", 1), ("una", 2), ("##aff", 3), ("##a", 4), ("##ble", 5), ("a", 6), ("##ff", 7)], "piece string, id int")
    terms = spark.createDataFrame([("unaffble",), ("unaffx",), ("unaff",), ("a",), ("a",), ("",), (None,), ("a" * 101,)], "term string")
    got = {r.term: (r.pieces, r.ids) for r in subwords.pieces(terms, vocabulary).collect()}
    assert got == {"unaffble": (["una", "##ff", "##ble"], [2, 7, 5]), "unaff": (["una", "##ff"], [2, 7]), "a": (["a"], [6])}
    assert subwords.pieces(terms, vocabulary.limit(0)).count() == 0 and subwords.pieces(terms.limit(0), vocabulary).count() == 0
    rows = spark.createDataFrame([("k", 0, "a"), ("k", 1, "zz"), ("k", 2, "unaff")], "key string, pos int, term string")
    assert sorted(tuple(r) for r in subwords.encoded(rows, vocabulary, "key").collect()) == [("k", 0, "a", 0, "a", 6), ("k", 2, "unaff", 0, "una", 2), ("k", 2, "unaff", 1, "##ff", 7)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "x x y z"), ("b", "y y z z"), ("c", "z z z y")], "doc_id string, text string")
    row = bm25.search(index.build_index(docs), terms(spark, q="x"), 10).collect()
    assert len(row) == 1 and row[0].doc_id == "a"
    assert row[0].score == pytest.approx(math.log(1 + 2.5 / 1.5) * 2 / 3.2, abs=1e-9)


def test_document_scores_need_every_token(spark, idx):
    asked = spark.createDataFrame([("q", "d1", "machine learning"), ("q", "d2", "machine learning"), ("q", "d1", "..."), ("q", "no", "data"), ("q", "d4", "and"), ("q", "d4", "the data and")], "qid string, doc_id string, term string")
    got = {(r.doc_id, r.term): r.score for r in bm25.document_term_scores(idx, asked).collect()}
    assert got["d1", "machine learning"] > 0
    assert got["d2", "machine learning"] == got["d1", "..."] == got["no", "data"] == got["d4", "and"] == 0
    assert got["d4", "the data and"] > 0  # stop words ask for nothing


def test_collection_score_is_the_mean_of_the_best(spark, idx):
    asked = spark.createDataFrame([("data",), ("absent",)], "term string")
    got = {r.term: r.score for r in bm25.collection_term_scores(idx, asked, top=2).collect()}
    best = sorted((r.score for r in bm25.term_scores(idx, asked).filter("term = 'data'").collect()), reverse=True)[:2]
    assert got["data"] == pytest.approx(sum(best) / 2) and got["absent"] == 0


def test_dense_token_scores(spark, docs, idx):
    asked = spark.createDataFrame([("q", "d1", "machine data")], "qid string, doc_id string, text string")
    scores = bm25.dense_scores(bm25.token_scores(idx, asked, 10), 10).first().scores
    assert [i for i, s in enumerate(scores) if s > 0] == [0, 6] and len(scores) == 10


def test_relevance_models_by_hand(spark):
    feedback = expansion.feedback_frame(spark, {"q": ["x b the x", "b c"]}, {"q": [3.0, 1.0]})
    query = terms(spark, q="x")
    rm1 = {r.term: r.weight for r in expansion.expand_from_feedback(query, feedback, "rm1").collect()}
    rm3 = {r.term: r.weight for r in expansion.expand_from_feedback(query, feedback, "rm3").collect()}
    assert rm1 == pytest.approx({"x": 0.5, "b": 0.375, "c": 0.125}) and sum(rm1.values()) == pytest.approx(1)
    assert rm3 == pytest.approx({"x": 1.5, "b": 0.375, "c": 0.125})


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_rm3_holds_query_terms_sorted_and_cut(spark, docs, idx, n):
    query = terms(spark, q="machine learning algorithms")
    rows = expansion.rm3(idx, docs, query, k=n).orderBy("rank").collect()
    assert len(rows) <= n and all(r.weight > 0 for r in rows)
    assert [round(r.weight, 9) for r in rows] == sorted((round(r.weight, 9) for r in rows), reverse=True)
    if n > 3:
        assert {"machine", "learning", "algorithms"} <= {r.term for r in rows}
    again = expansion.rm3(idx, docs, query, k=n).orderBy("rank").collect()
    assert [(r.rank, r.term, round(r.weight, 9)) for r in rows] == [(r.rank, r.term, round(r.weight, 9)) for r in again]  # sums may differ in the last bits


def test_zero_scores_weigh_nothing_and_logs_are_a_softmax(spark):
    zero = expansion.document_weights(spark.createDataFrame([("q", "a", 0.0), ("q", "b", 0.0)], "qid string, doc_id string, score double"))
    assert [r.doc_weight for r in zero.collect()] == [0, 0]
    logs = expansion.document_weights(spark.createDataFrame([("q", "a", -1.0), ("q", "b", -2.0)], "qid string, doc_id string, score double"))
    weights = [r.doc_weight for r in logs.orderBy("doc_id").collect()]
    assert weights == pytest.approx([math.e / (1 + math.e), 1 / (1 + math.e)])


def test_wrong_model_and_unequal_lists_are_errors(spark, docs, idx):
    with pytest.raises(ValueError):
        expansion.expand_queries(idx, docs, terms(spark, q="data"), "rm9")
    with pytest.raises(ValueError):
        expansion.feedback_frame(spark, {"q": ["a"]}, {"q": [1.0, 2.0]})


def test_filters(spark):
    model = spark.createDataFrame([("q", "the", 1.0), ("q", "ab", 0.9), ("q", "data", 0.8)], "qid string, term string, weight double")
    assert {r.term for r in expansion.filtered(model, T.STOPWORDS, 3, 12).collect()} == {"data"}


def test_no_documents_no_expansion(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert expansion.rm1(index.build_index(empty), empty, terms(spark, q="data")).count() == 0


def test_index_round_trip(spark, docs, idx, tmp_path):
    path = str(tmp_path / "i")
    again = index.write_index(docs, path, buckets=16)
    assert index.index_statistics(again).first() == index.index_statistics(idx).first()
    assert all(index.validate_index(again).first())
    query = terms(spark, q="machine data", r="learning learning absent")
    plain, pruned = (sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in bm25.search(i, query, 10).collect()) for i in (idx, index.open_index(spark, path)))
    assert plain == pruned and plain
    told = index.index_settings(spark, path, 1.2, 0.75).first()
    assert told.size_mb > 0 and (told.buckets, told.stemmed, told.k1, told.b) == (16, False, 1.2, 0.75)
    with pytest.raises(Exception):
        index.open_index(spark, str(tmp_path / "none"))


def test_search_reads_the_folders_of_its_terms_once(spark, docs, tmp_path):
    own = index.write_index(docs, str(tmp_path / "i"), buckets=64)
    plan = bm25.search(own, terms(spark, q="machine"), 10)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x and "tf#" in x]
    assert len(scans) == 1 and "PartitionFilters: []" not in scans[0] and "bucket" in scans[0]


def test_documents_are_counted_in_their_rows(spark):
    rows = spark.createDataFrame([(1, "b a b The b a"), (2, ""), (3, None), (4, "the of")], "doc_id long, text string")
    got = {r.doc_id: (r.dl, [tuple(c) for c in r.counts]) for r in index.forward(rows).collect()}
    assert got == {1: (3, [("b", 3)]), 2: (0, []), 4: (0, [])}  # a is a stop word, too


def test_stems_of_published_examples(spark, docs):
    examples = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi",
        "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal",
        "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
        "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    }
    assert {w: stem.stem(w) for w in examples} == examples
    assert stem.stem("größe") == "größe" and stem.stem("is") == "is" and stem.stem("x42s") == "x42s"
    own = index.build_index(docs, stemmed=True)
    asked = own.query_terms(spark.createDataFrame([("q", "The network learned")], "qid string, text string"))
    assert [r.term for r in asked.orderBy("pos").collect()] == ["network", "learn"]
    assert {r.doc_id for r in bm25.search(own, asked, 10).collect()} == {"d1", "d2", "d3"}
    assert "learn" in {r.term for r in expansion.rm1(own, docs, asked).collect()}
