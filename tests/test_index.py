"""The index: pruned search, phrases, spans and folders against plain readings; a stream against a rebuilt index."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.functions.text import STOPWORDS
from termloom.operators import bm25, expansion, index, scan
from termloom.plans.queries import QUERIES
from termloom.plans.workload import Workload
from termloom.streaming import indexing

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS + ["the", "and"], weights=[1 / (i + 1) for i in range(60)] + [0.3, 0.2], k=rng.choice([0, 3, 20, 60]))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 100, t) for i, t in enumerate(texts(400, 1))] + [(5000, None), (5001, "lone " + "w0 " * 1200)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(2)
    rows = [(q, " ".join(rng.choices(WORDS, k=rng.choice([1, 4, 15])))) for q in range(12)] + [(50, "absent"), (51, "the"), (52, "lone w0 w0")]
    return spark.createDataFrame(rows, "qid int, text string")


@pytest.fixture(scope="module", params=[(1, 64 << 20), (7, 200)], ids=["one folder", "folders"])
def own(request, docs, tmp_path_factory):
    buckets, part_bytes = request.param
    patch = pytest.MonkeyPatch()
    patch.setattr(index, "PART_BYTES", part_bytes)
    patch.setattr(index, "TASK_BYTES", 4000)
    patch.setattr(index, "MAX_PARTS", 12)
    patch.setattr(index, "FEW_PARTS", 2)
    written = index.write_index(docs, str(tmp_path_factory.mktemp("i")), buckets=buckets)
    patch.undo()
    return written


def rows_of(df):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize(("k", "k1", "b"), [(1, 1.2, 0.75), (10, 1.2, 0.75), (10, 0.9, 0.4), (5, 2.0, 1.0), (3, 1.2, 0.0), (1000, 1.2, 0.75)])
def test_pruned_search_gives_the_rows_of_the_whole_one(own, queries, monkeypatch, k, k1, b):
    monkeypatch.setattr(bm25, "SEED_POSTINGS", 30)
    monkeypatch.setattr(bm25, "SEED_DOCS", 2)
    terms = own.query_terms(queries)
    assert rows_of(bm25.pruned_search(own, bm25.weights(own, terms, k1, b), k, k1, b)) == rows_of(bm25.search(own, terms, k, k1, b))


def test_pruned_search_leaves_postings_out(own, queries, monkeypatch):
    monkeypatch.setattr(bm25, "SEED_POSTINGS", 30)
    told = bm25.essential_terms(own, bm25.weights(own, own.query_terms(queries)), 2)
    read, there = told.agg(F.sum(F.when(F.col("essential"), F.col("df"))), F.sum("df")).first()
    assert read < there
    monkeypatch.setattr(bm25, "PRUNE_EACH", 1)
    assert rows_of(bm25.search(own, own.query_terms(queries), 2, prune_from=0)) == rows_of(bm25.search(own, own.query_terms(queries), 2))


def test_pruned_search_builds_one_index(spark, sf_dir, monkeypatch):
    def another(w):
        raise AssertionError("a second index")

    monkeypatch.setattr(Workload, "index", property(another))
    assert QUERIES["bm25_topk_pruned"](spark, sf_dir).count() == 400


def test_pruned_search_shuffles_neither_postings_nor_rows_of_documents(own, queries):
    made = bm25.weights(own, own.query_terms(queries)), bm25.search(own, own.query_terms(queries), 3).select("qid", "doc_id")
    wanted, pairs = (queries.sparkSession.createDataFrame(x.collect(), x.schema) for x in made)
    for found in (own.of_terms(wanted), bm25.score_documents(own, wanted, pairs)):
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") >= 2
    assert set(own.postings.columns).isdisjoint({"places", "starts", "width"})  # which are in the documents' rows


def test_spans_are_those_of_the_documents(own, docs, spark):
    got = {(r.doc_id, r.term): (r.tf, r.width, r.places) for r in own.spans(spark.createDataFrame([(5001,), (7,)], "doc_id long")).collect()}
    assert got[5001, "lone"] == (1, 1, [0]) and got[5001, "w0"] == (1200, 1, [1] * 1200) and {d for d, _ in got} <= {5001, 7}


def test_bounds_of_blocks_hold(own):
    part = index.tf_part(0.9, 0.4, own.size[1])
    best = own.postings.groupBy("term", "block").agg(F.max(part).alias("best"), F.count("*").alias("there"))
    joined = best.join(own.maxima.drop("best"), ["term", "block"])
    assert joined.count() == own.maxima.count()
    assert joined.filter((F.col("best") > index.tf_part(0.9, 0.4, own.size[1], "max_tf", "min_dl") + 1e-12) | (F.col("there") != F.col("n")) | (F.col("there") > index.BLOCK_DOCS)).count() == 0


def test_documents_are_read_from_their_folders(own, docs, spark):
    wanted = spark.createDataFrame([(-100,), (5001,), (7,), (4,)], "doc_id long")
    found = own.of_documents(wanted)
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs.filter("text is not null").join(wanted, "doc_id").collect()}
    if own.bounds is not None:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "part" in plan[plan.index("PartitionFilters") :].split("\n")[0]
        assert len({r.part for r in own.near(wanted).select("part").distinct().collect()}) < own.bounds.count()


def analysed(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in STOPWORDS]


def test_phrases_against_a_plain_reading(own, docs, spark):
    asked = [(1, "w0 w1"), (2, "w1 w0 w0"), (3, "w0 the w0"), (4, "w2"), (5, "the and"), (6, "w0 absent"), (7, "w0 w0 w0 w0"), (8, "w3 w1 w0")]
    want = {}
    for qid, text in asked:
        phrase = analysed(text)
        for r in docs.collect():
            words = analysed(r.text)
            at = [i for i in range(len(words)) if phrase and words[i : i + len(phrase)] == phrase]
            if at:
                want[qid, r.doc_id] = (len(at), at[0])
    got = bm25.phrases(own, spark.createDataFrame(asked, "qid int, text string")).collect()
    assert {(r.qid, r.doc_id): (r.n, r.first) for r in got} == want and want


def test_relevance_model_of_the_index_is_that_of_the_texts(own, docs, queries):
    feedback = bm25.search(own, own.query_terms(queries), 4)
    by_text, by_index = (sorted((r.qid, r.term, round(r.weight, 9)) for r in m.collect()) for m in (expansion.relevance_model(feedback, docs), expansion.indexed_model(own, feedback)))
    assert by_text == by_index and any(r[1] == "lone" for r in by_text)
    short, whole = (expansion.rm1(own, docs, own.query_terms(queries), max_tokens=n).filter("qid = 52 and term = 'w0'").first() for n in (10, 1000))
    assert short.weight != whole.weight


def test_spans_of_pieces(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a lengthy word, the lengthy a"), (2, "x")], "doc_id long, text string")
    built = index.write_index(docs, str(tmp_path / "i"), widths=index.fixed_pieces(3))
    asked = spark.createDataFrame([("q", 1, "Lengthy the"), ("r", 1, "lengthy"), ("r", 2, "nothing"), ("s", 3, "x")], "qid string, doc_id long, text string")
    got = defaultdict(list)
    for r in bm25.token_scores(built, asked, 10).orderBy("pos").collect():
        got[r.qid].append(r.pos)
    # pieces: a | len gth y | wor d | the | len gth y | a, of which the first ten count
    assert got == {"q": [1, 2, 3, 7, 8, 9], "r": [1, 2, 3, 7, 8, 9]}
    dense = bm25.dense_scores(bm25.token_scores(built, asked, 10), 10).filter("qid = 'q'").first().scores
    assert [i for i, x in enumerate(dense) if x > 0] == [1, 2, 3, 7, 8, 9] and len(dense) == 10


def test_positions_of_forward_rows(spark):
    rows = spark.createDataFrame([(1, "b the c b"), (2, ""), (3, "the the")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in index.forward(rows).collect()}
    assert [tuple(c) for c in got[1].counts] == [("b", 2), ("c", 1)]
    assert got[1].places == [[0, 2], [1]] and got[1].starts == [[0, 3], [2]] and got[1].heads == [2, 1] and got[1].dl == 3
    assert got[2].counts == got[3].counts == [] and got[3].dl == 0
    exploded = index.positions(spark.createDataFrame([("x", [3, 2, 5]), ("y", []), ("z", None), ("v", [0])], "key string, gaps array<int>"), "gaps", "at")
    assert sorted(map(tuple, exploded.collect())) == [("v", 0), ("x", 3), ("x", 5), ("x", 10)]


def test_an_index_without_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    index.write_index(none, str(tmp_path / "i"))
    again = index.open_index(spark, str(tmp_path / "i"))
    terms = again.query_terms(spark.createDataFrame([(1, "w0")], "qid int, text string"))
    assert bm25.search(again, terms).count() == 0 and again.size == (0, None)


def test_a_repeated_token_of_a_term_counts_once(own, spark):
    asked = [("q", 5001, t) for t in ("w0", "w0 W0", "lone", "lone w0 lone", "w0 absent", "the", "?")]
    got = {r.term: r.score for r in bm25.document_term_scores(own, spark.createDataFrame(asked, "qid string, doc_id long, term string")).collect()}
    assert got["w0 W0"] == pytest.approx(got["w0"]) and got["lone w0 lone"] == pytest.approx(got["lone"] + got["w0"]) and got["w0"] > 0
    assert got["w0 absent"] == got["the"] == got["?"] == 0


@pytest.fixture(scope="module")
def forward_only(docs, tmp_path_factory):
    return index.write_index(docs, str(tmp_path_factory.mktemp("f")), inverted=False)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("buffer", [1, 1 << 20])
def test_batches_of_queries_meet_documents_and_shuffle_no_postings(own, forward_only, queries, spark, monkeypatch, buffer):
    monkeypatch.setattr(scan, "BUFFER", buffer)
    monkeypatch.setattr(scan, "DOCS", 7)
    terms = own.query_terms(queries)
    jobs = {
        "search": lambda i: bm25.search(i, terms, 5),
        "sweep": lambda i: bm25.parameter_sweep(i, terms, [0.9, 2.0], [0.4, 1.0], 3),
        "means": lambda i: bm25.collection_term_scores(i, terms, 3),
        "phrases": lambda i: bm25.phrases(i, queries),
    }
    rows = lambda df: sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())
    found = {name: job(forward_only) for name, job in jobs.items()}
    assert all("MapInArrow" in _plan(df) and "Generate" not in _plan(df).split("MapInArrow")[1] for df in found.values())
    got = {name: rows(df) for name, df in found.items()}
    monkeypatch.setattr(scan, "ASKED_ROWS", 0)  # the joins with postings, for queries too many to go to every task
    assert got == {name: rows(job(own)) for name, job in jobs.items()} and all(got.values())


def test_documents_that_cover_a_query(forward_only, docs, queries):
    words = {r.doc_id: set(analysed(r.text)) for r in docs.collect()}
    want = {}
    for q in queries.collect():
        asked = set(analysed(q.text))
        want |= {(q.qid, d): len(asked & own) for d, own in words.items() if asked and 4 * len(asked & own) >= 3 * len(asked)}
    got = scan.covering(forward_only, forward_only.query_terms(queries), 0.75).collect()
    assert {(r.qid, r.doc_id): r.shared for r in got} == want and want


def test_an_index_without_postings_is_opened_again(forward_only, docs, spark, tmp_path):
    index.write_index(docs, str(tmp_path / "i"), inverted=False)
    again = index.open_index(spark, str(tmp_path / "i"))
    assert again.size == forward_only.size and told(again) == told(index.build_index(docs))


# -- a stream of updates


def told(own):
    terms = sorted((r.term, r.df, r.cf) for r in own.term_stats.collect())
    postings = sorted((r.term, r.doc_id, r.tf, r.dl, tuple(r.places)) for r in own.postings.collect())
    documents = sorted((r.doc_id, r.dl) for r in own.doc_stats.collect())
    return terms, postings, documents


def test_a_stream_of_updates_equals_a_rebuilt_index(spark, tmp_path):
    rng, path, state = random.Random(4), str(tmp_path / "s"), {}
    levels = set()
    for batch_id in range(9):
        updates = [(rng.randrange(30), t if rng.random() < 0.8 else None, j) for j, t in enumerate(texts(12, 100 + batch_id))] + [(None, "no id", 99)]
        for doc_id, t, _ in updates[:-1]:  # the last of a batch counts
            state[doc_id] = t
        frame = spark.createDataFrame(updates, "doc_id int, text string, at int").repartition(3)
        for _ in range(2 if batch_id in (3, 6) else 1):  # a batch that is run again changes nothing
            segments = indexing.apply_batch(frame, path, batch_id, order_col="at", fanout=2)
        levels |= {level for _, level in segments}
        if batch_id in (0, 4, 8):
            rebuilt = index.build_index(spark.createDataFrame([x for x in state.items()], "doc_id int, text string"))
            assert told(indexing.open_parts(spark, path)) == told(rebuilt)
    assert max(levels) >= 2 and len(segments) <= 4
    query = spark.createDataFrame([(1, 0, "w0"), (1, 1, "w5")], "qid int, pos int, term string")
    assert rows_of(bm25.search(indexing.open_parts(spark, path), query)) == rows_of(bm25.search(rebuilt, query))


@pytest.mark.parametrize("few", [0, 1000])
def test_segments_hold_occurrences_once(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(indexing, "FEW_DEAD", few)
    path = str(tmp_path / "s")
    for batch_id, rows in enumerate(([(1, "w0 w1"), (2, "w0"), (3, "w2 w2")], [(1, None), (1, "w3"), (2, None)], [(3, "w4 w0")])):
        indexing.apply_batch(spark.createDataFrame(rows, "key int, body string"), path, batch_id, id_col="key", text_col="body", fanout=3 if batch_id < 2 else 9)
    assert all(set(indexing._names(spark, f"{path}/segments/{x}")) == {"forward", "terms", "tombstones"} for x in indexing._names(spark, f"{path}/segments"))
    own = indexing.open_parts(spark, path)
    assert told(own) == told(index.build_index(spark.createDataFrame([(1, "w3"), (3, "w4 w0")], "doc_id int, text string")))
    assert ("broadcast" in own.documents._jdf.queryExecution().analyzed().toString()) == bool(few)


def test_old_segments_go_and_unfinished_manifests_do_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    for batch_id in range(5):
        indexing.apply_batch(spark.createDataFrame([(batch_id, "w0")], "doc_id int, text string"), path, batch_id, fanout=2)
    live = {x for x, _ in indexing._manifest(spark, path)} | {x for x, _ in indexing._manifest(spark, path, 4)}
    assert set(indexing._names(spark, f"{path}/segments")) == live
    (tmp_path / "s" / "manifest" / "00000009").mkdir()
    assert indexing.open_parts(spark, path).term_stats.collect()[0].df == 5
    with pytest.raises(ValueError, match="no finished batch"):
        indexing.open_parts(spark, str(tmp_path / "none"))


def test_a_stream_with_deletions_merges(spark, tmp_path):
    feed = str(tmp_path / "feed")
    for rows in ([(1, "w0 w1"), (2, "w0")], [(1, None)], [(2, "w2"), (3, "w0 w0")]):
        spark.createDataFrame(rows, "doc_id int, text string").write.mode("append").parquet(feed)
        stream = spark.readStream.schema("doc_id int, text string").parquet(feed)
        indexing.index_stream(stream, str(tmp_path / "s"), str(tmp_path / "c"), fanout=2).awaitTermination()
    got = indexing.open_parts(spark, str(tmp_path / "s"))
    assert Counter({r.term: r.cf for r in got.term_stats.collect()}) == {"w2": 1, "w0": 2}
