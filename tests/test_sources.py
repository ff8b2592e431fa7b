"""Readers, writers, the store, files, the command line and the stream."""

from __future__ import annotations

import duckdb
import pytest

from termloom import cli
from termloom.operators import index
from termloom.plans.oracle import ORACLE_SQL
from termloom.plans.queries import QUERIES
from termloom.sources import files, records, store, trec
from termloom.streaming import indexing


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_short_lines_are_dropped(spark):
    assert trec.parse_run(lines(spark, "q Q0 d 1 0.5 t", " q\tQ0 e  2 0.25 t ", "q Q0 d 1 0.5", "")).count() == 2
    assert [tuple(r) for r in trec.parse_qrels(lines(spark, "q 0 d 2", "q 0 d")).collect()] == [("q", "d", 2)]


def test_run_and_qrels_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q1", "a", 1, 1.25), ("q1", "b", 2, 0.123456789), ("q2", "c", 1, 3.0)], "qid string, doc_id string, rank int, score double")
    trec.write_run(run, str(tmp_path / "run"), "tag")
    back = {(r.qid, r.doc_id): (r.rank, r.score, r.tag) for r in trec.read_run(spark, str(tmp_path / "run")).collect()}
    assert back == {("q1", "a"): (1, 1.25, "tag"), ("q1", "b"): (2, 0.123457, "tag"), ("q2", "c"): (1, 3.0, "tag")}
    (tmp_path / "qrels").write_text("q1 0 a 1\nq1 0 a 2\nq1 0 b 0\n")
    assert {tuple(r) for r in trec.read_qrels(spark, str(tmp_path / "qrels")).collect()} == {("q1", "a", 2), ("q1", "b", 0)}


def test_records_fall_back(spark):
    docs = spark.createDataFrame([(1, "t", "b"), (2, None, "b"), (3, None, None)], "doc_id int, text string, body string")
    assert {tuple(r) for r in records.collection(docs).collect()} == {(1, "t"), (2, "b")}
    queries = spark.createDataFrame([(1, "text", "x", "y"), (2, None, "title", "more"), (3, None, "title", ""), (4, None, None, None)], "qid int, text string, title string, description string")
    assert {r.qid: r.text for r in records.queries(queries).collect()} == {1: "text", 2: "title more", 3: "title", 4: ""}


def test_empty_texts_are_no_records(spark, tmp_path):
    docs = spark.createDataFrame([(1, "", "b"), (2, "", None), (3, None, ""), (4, " ", "b")], "doc_id int, text string, body string")
    assert {tuple(r) for r in records.collection(docs).collect()} == {(1, "b"), (4, " ")}
    spark.createDataFrame([(1, "ünï"), (2, ""), (3, None), (None, "x"), (4, " ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<p>"), (2, ""), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["collection_scan"]).fetchall()
    assert sorted(map(tuple, QUERIES["collection_scan"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr) and len(want) == 4


def test_feedback_sources(spark):
    qrels = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 2)], "qid string, doc_id string, rel int")
    assert [r.doc_id for r in records.feedback_source(qrels=qrels).orderBy("rank").collect()] == ["c", "b"]
    with pytest.raises(ValueError):
        records.feedback_source()


def test_store_round_trips(spark, tmp_path):
    base = str(tmp_path)
    queries = spark.createDataFrame([("q", "text")], "qid string, text string")
    record = store.save_training_set(spark, f"{base}/set", {"note": "é"}, queries=queries)
    tables, metadata = store.load_training_set(spark, f"{base}/set")
    assert record["counts"] == {"queries": 1} and set(tables) == {"queries"} and metadata["metadata"] == {"note": "é"}
    store.save_weights(spark, (1.0, 2.0, 3.0), f"{base}/w", {"metric": "map"})
    assert store.load_weights(spark, f"{base}/w") == (1.0, 2.0, 3.0)
    store.save_json(spark, {"a": [1]}, f"{base}/j", compress=True)
    assert store.load_json(spark, f"{base}/j") == {"a": [1]}
    folds = spark.createDataFrame([("f", "training", "1"), ("f", "testing", "2")], "fold string, split string, qid string")
    store.save_folds(folds, f"{base}/f")
    assert {tuple(r) for r in store.load_folds(spark, f"{base}/f").collect()} == {("f", "training", "1"), ("f", "testing", "2")}
    runs = spark.createDataFrame([("r", "q", "d", 1, 0.5)], "run_name string, qid string, doc_id string, rank int, score double")
    reached = spark.createDataFrame([("r", "map", 0.5)], "run_name string, metric string, value double")
    path = store.save_experiment(spark, base, "exp", runs, queries, (1.0, 1.0, 1.0), {"ok": True}, reached)
    assert store.load_json(spark, f"{path}/summary") == {"ok": True} and spark.read.parquet(f"{path}/runs").count() == 1
    assert [r.value for r in spark.read.text(f"{path}/run_lines/run_name=r").collect()] == ["q Q0 d 1 0.500000 r"]
    assert spark.read.parquet(f"{path}/evaluations").first().run_name == "r"
    with pytest.raises(ValueError):
        store.save_training_set(spark, f"{base}/x", other=queries)


def test_query_ids_and_formats(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1\n\n 2 \n")
    ids = records.query_ids(spark, str(tmp_path / "ids.txt"))
    assert {r.qid for r in ids.collect()} == {"1", "2"}
    (tmp_path / "d.jsonl").write_text('{"doc_id": "a", "text": "x"}\n')
    assert records.read(spark, str(tmp_path / "d.jsonl")).first().text == "x"


def test_files(tmp_path):
    folder = files.ensure_dir(tmp_path / "a" / "b")
    (folder / "x.tmp").write_text("1")
    assert files.backup(folder / "x.tmp").read_text() == "1" and files.backup(folder / "none") is None
    assert files.with_extension(folder, "tmp") == [folder / "x.tmp"] and files.remove_older(folder, -1) == 1
    assert files.readable_size(2048) == "2.0 KB"
    with files.timed("step"):
        pass


def test_stream_builds_the_same_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(12)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    indexing.index_stream(stream, str(tmp_path / "idx"), str(tmp_path / "cp")).awaitTermination()
    parts = indexing.open_parts(spark, str(tmp_path / "idx"))
    assert index.index_statistics(parts).first() == index.index_statistics(index.build_index(docs)).first()


def test_command_line_end_to_end(spark, tmp_path):
    t = str(tmp_path)
    docs = spark.createDataFrame([(str(i), f"term{i % 4} term{i % 3} shared words here") for i in range(24)], "doc_id string, text string")
    docs.write.parquet(f"{t}/docs")
    queries = spark.createDataFrame([(str(i), f"term{i} shared") for i in range(4)], "qid string, text string")
    queries.write.parquet(f"{t}/queries")
    spark.createDataFrame([(i, [float(i % 3 == k) for k in range(4)]) for i in range(8)], "vec_id long, embedding array<double>").write.parquet(f"{t}/vectors")
    (tmp_path / "qrels").write_text("".join(f"{q} 0 {d} {int(d % 4 == q)}\n" for q in range(4) for d in range(24)))
    cli.main(["create-index", "--collection", f"{t}/docs", "--index", f"{t}/index"])
    cli.main(["index-stats", "--index", f"{t}/index"])
    cli.main(["search", "--index", f"{t}/index", "--queries", f"{t}/queries", "--output", f"{t}/run", "--k", "10"])
    cli.main(["expand", "--index", f"{t}/index", "--collection", f"{t}/docs", "--queries", f"{t}/queries", "--output", f"{t}/expansion"])
    cli.main(["create-training-data", "--index", f"{t}/index", "--collection", f"{t}/docs", "--queries", f"{t}/queries", "--qrels", f"{t}/qrels", "--vectors", f"{t}/vectors", "--output", f"{t}/set", "--dim", "4", "--terms", "5"])
    cli.main(["train-weights", "--training", f"{t}/set", "--collection", f"{t}/docs", "--run", f"{t}/run", "--vectors", f"{t}/vectors", "--output", f"{t}/weights", "--resolution", "2"])
    assert len(store.load_weights(spark, f"{t}/weights")) == 3
    cli.main(["cross-validate", "--training", f"{t}/set", "--collection", f"{t}/docs", "--run", f"{t}/run", "--vectors", f"{t}/vectors", "--output", f"{t}/cv", "--folds", "2", "--resolution", "2"])
    cli.main(["evaluate", "--qrels", f"{t}/qrels", "--runs", f"bm25={t}/run,cv={t}/cv/run", "--output", f"{t}/eval", "--metrics", "map,P_5"])
    assert spark.read.parquet(f"{t}/eval/comparison").count() == 2
