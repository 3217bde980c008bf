"""Readers, writers and streaming operators."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import services as SV
from corpusmill.operators import upsert as U
from corpusmill.sources import readers, writers
from corpusmill.streaming import incremental, windows


def test_json_lines_and_rejects(spark, tmp_path):
    p = tmp_path / "chunks.jsonl"
    good = {"schema_version": 1, "doc_id": "d", "chunk_id": "c", "url": "u", "document_title": "t", "section_path": ["a"], "chunk_index": 0, "page_start": 1, "page_end": 1, "chunking_version": "v1", "text": "x", "content_hash": "sha256:" + "0" * 64}
    p.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"chunk_id": "bad", "page_end": 0}) + "\n{broken\n")
    rows, rejects = readers.chunk_records(spark, str(p))
    assert [r.chunk_id for r in rows.collect()] == ["c"]
    assert sorted((r.chunk_id or "", r.error) for r in rejects.collect()) == [("", "unreadable line"), ("bad", "page_range")]
    writers.append_rejects(rejects, str(tmp_path / "log"))
    writers.append_rejects(rejects, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_pages(spark, tmp_path):
    p = tmp_path / "pages.jsonl"
    p.write_text('{"doc_id": "d", "page": 2, "clean_text": "b"}\n{"doc_id": "d", "clean_text": " a  b "}\n')
    assert [r.page for r in readers.pages(spark, str(p)).collect()] == [2]
    assert [(r.page, r.clean_text) for r in readers.pages(spark, str(p), lenient=True).collect()] == [(2, "b"), (2, "a b")]


def test_golden_and_tags(spark, tmp_path):
    p = tmp_path / "golden.json"
    p.write_text(json.dumps({"version": "1", "questions": [{"question_id": "1", "question": "q?", "soft_positive_chunk_ids": ["a", "b"], "strict_positive_chunk_ids": ["a"], "graded_relevance": [{"chunk_id": "a", "score": 1.0}, {"chunk_id": "c", "score": 0.0}]}]}))
    got = {r.item_id: (r.grade, r.is_soft, r.is_strict) for r in readers.golden_targets(spark, str(p)).collect()}
    assert got == {"a": (1.0, True, True), "b": (0.0, True, False), "c": (0.0, False, False)}
    t = tmp_path / "tags.json"
    t.write_text(json.dumps([{"question_id": "1", "tags": ["x", "y"]}]))
    catalog = spark.createDataFrame([("1",)], "question_id string")
    assert readers.question_tags(spark, str(t), catalog).count() == 2
    with pytest.raises(ValueError):
        readers.question_tags(spark, str(t), spark.createDataFrame([("1",), ("2",)], "question_id string"))


def test_questions_and_manifests(spark, tmp_path):
    (tmp_path / "q.txt").write_text("one?\n \ntwo?\n")
    assert readers.questions(spark, str(tmp_path / "q.txt")).count() == 2
    for name, body in (("a", '{"run_id": "a", "started_at": "2026-01-01T00:00:00Z"}'), ("b", '{"run_id": "b", "started_at": "?"}'), ("c", '{"run_id": "c", "started_at": "2026-02-01T00:00:00Z"}'), ("d", "{")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "run_manifest.json").write_text(body)
    assert [r.run_id for r in readers.run_manifests(spark, str(tmp_path / "runs")).collect()] == ["c", "a", "b"]


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("a|b", 0.5, ["x", "y"]), (None, None, None)], "n string, v double, t array<string>")
    assert writers.markdown_table(d).split("\n")[2:] == ["| a\\|b | 0.5000 | x;y |", "| n/a | n/a | n/a |"]
    with pytest.raises(ValueError):
        writers.markdown_table(d, most_rows=1)
    writers.csv_report(d, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert "## Empty" not in writers.run_report("R", {"Empty": d.limit(0), "Full": d})
    writers.manifest(spark, f"file://{tmp_path}/m.json", {"run_id": "r", "status": "s", "started_at": "t"})
    with pytest.raises(ValueError):
        writers.manifest(spark, f"file://{tmp_path}/m.json", {"run_id": "r"})


def test_stream_equals_batch(spark, small, tmp_path):
    source = tmp_path / "events"
    spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(source))
    batch = windows.windowed_counts(spark.read.parquet(str(source)), "1 hour").groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("w"))
    stream = windows.windowed_counts(windows.read_events(spark, str(source)), "1 hour", late="3650 days")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("counted").groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("w"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_keyed_table_follows_a_stream_once(spark, tmp_path):
    source = tmp_path / "in"
    schema = "k int, v string, t int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).coalesce(1).write.parquet(str(source))
    target = incremental.KeyedTable(spark, f"file://{tmp_path}/table", schema, ["k"], "t")
    read = lambda: spark.readStream.schema(schema).parquet(str(source))
    incremental.follow(read(), target, str(tmp_path / "cp"))
    spark.createDataFrame([(1, "A", 2), (3, "c", 1)], schema).coalesce(1).write.mode("append").parquet(str(source))
    incremental.follow(read(), target, str(tmp_path / "cp"))
    assert {r.k: r.v for r in target.read().collect()} == {1: "A", 2: "b", 3: "c"}
    before = target.version()
    target.apply(spark.createDataFrame([(9, "z", 9)], schema), before)  # a batch that was merged before
    assert target.read().count() == 3


def test_semi_join_beyond_the_broadcast_bound(spark):
    from corpusmill.session import materialise, semi_join_keys

    keys = materialise(spark.range(50).selectExpr("cast(id * 2 as string) as id"), "keys")
    d = spark.range(100).selectExpr("cast(id as string) as id")
    assert semi_join_keys(d, keys, "id").count() == semi_join_keys(d, keys, "id", limit=10).count() == 50


def test_inserts_that_must_be_new(spark):
    old, new = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"), spark.createDataFrame([("b", 2)], "v string, k int")
    assert sorted(map(tuple, U.insert_or_fail(old, new, ["k"]).where("k is not null").collect())) == [(1, "a"), (2, "b")]
    for bad in ([("x", 1)], [("x", 3), ("y", 3)], [("x", None)]):
        with pytest.raises(ValueError):
            U.insert_or_fail(old, spark.createDataFrame(bad, "v string, k int"), ["k"])


def test_a_second_ingest_changes_nothing(spark):
    old = spark.createDataFrame([("a", "p", "m"), ("b", "p", "m"), ("c", "p", "m")], "k string, print string, meta string")
    new = spark.createDataFrame([("a", "p", "new"), ("b", "other", "new"), ("d", "p", "m"), ("d", "p", "m"), (None, "p", "m")], "k string, print string, meta string")
    state, first = U.apply_changes(old, new, "k")
    assert {(r.k, r.action) for r in first.collect()} == {("a", "update"), ("b", "skip_and_log"), ("d", "insert")}
    again, second = U.apply_changes(state, new, "k")
    assert {(r.k, r.action) for r in second.collect()} == {("a", "skip"), ("b", "skip_and_log"), ("d", "skip")}
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, state.collect())) == [("a", "p", "new"), ("b", "p", "m"), ("c", "p", "m"), ("d", "p", "m")]


def test_batches_fall_back_to_single_points(spark):
    seen = spark.sparkContext.accumulator(0)

    def write(points):
        seen.add(1)
        if any(p["v"] == "bad" for p in points):
            raise ValueError("refused")

    d = spark.createDataFrame([(i, "bad" if i == 3 else "good") for i in range(8)], "k int, v string").coalesce(1)
    assert {r.k: r.error for r in SV.write_points(d, "k", ["v"], write, 4).collect()} == {i: "refused" if i == 3 else None for i in range(8)}
    assert seen.value == 6  # two batches, and the four points of the one that failed


def test_collections_are_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert writers.create_collection(spark, path, "id string", {"dimension": 4}) and not writers.create_collection(spark, path, "id string", {"dimension": 4})
    with pytest.raises(ValueError):
        writers.create_collection(spark, path, "id string", {"dimension": 5})


def test_places_of_a_text(spark):
    source = "Alpha beta; gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho."
    rows = [("beta; gamma", 0), ("beta gamma delta", 0), ("BETA gamma, delta epsilon zeta eta, theta iota kappa lambda mu nu (xi)", 0), ("alpha", 3), ("", 0), (None, 0), ("Alpha beta; gamma", -5), ("...", 0)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "t string, c int").select(T.locate_span(F.lit(source), F.col("t"), F.col("c"))).collect()]
    assert got == [(6, 17, "exact"), (None, None, "missing"), (6, source.index(" xi") + 3, "anchor"), (None, None, "missing"), (None, None, "empty"), (None, None, "empty"), (0, 17, "exact"), (None, None, "missing")]


def test_page_marks(spark):
    d = spark.createDataFrame([("<<<PAGE:3>>>a<<<PAGE:12>>>b <<<PAGE:x>>>",), (None,), ("",)], "t string")
    assert [tuple(r) for r in d.select(T.page_marks(F.col("t")), T.without_page_marks(F.col("t"))).collect()] == [([3, 12], "ab <<<PAGE:x>>>"), (None, None), ([], "")]


def test_overlapping_pieces_find_their_pages(spark):
    from corpusmill.operators.structure import map_pages

    d = spark.createDataFrame([("d", 0, "one two"), ("d", 1, None), ("d", 2, "two three"), ("d", 3, "one two")], "k string, o int, t string")
    got = [(r.o, r.begin, r.how, r.maps) for r in map_pages(d, "k", "o", "t").orderBy("o").collect()]
    assert got == [(0, 0, "exact", True), (1, None, "empty", True), (2, 8, "exact", True), (3, 18, "exact", True)]


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "k int, v string, t int"
    t = incremental.KeyedTable(spark, f"file://{tmp_path}/table", schema, ["k"], "t", buckets=8)
    t.apply(spark.createDataFrame([(i, "a", 1) for i in range(40)], schema), 0)
    t.apply(spark.createDataFrame([(5, "b", 2)], schema), 3)
    where = t._manifest(3)["where"]
    assert sorted(where.values()).count("batch-3") == 1 and len(where) == 8
    for n in (4, 5, 6):
        t.apply(spark.createDataFrame([(i, f"c{n}", n) for i in range(40)], schema), n)
    again = incremental.KeyedTable(spark, f"file://{tmp_path}/table", schema, ["k"], "t", buckets=2)  # the stored number of buckets holds
    assert {r.v for r in again.read().collect()} == {"c6"} and again.read().count() == 40
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if not p.name.startswith(".")) == ["batch-5", "batch-6", "v5.json", "v6.json"]
