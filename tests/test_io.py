"""Readers, writers, and streaming against batch."""

import json

from pyspark.sql import functions as F

from chronocite.sources import readers
from chronocite.streaming import replay

SF = "/root/testdata/sf0.001"


def test_pairs_round_trip(spark, tmp_path):
    row = ("62010CJ0001", "A, \"B\"", 1, "2010-05-01", "line\nbreak", "62009CJ0002", "T", 2, "x", "2009-01-01")
    bad = (*row[:3], "no date", *row[4:])
    df = spark.createDataFrame([row, bad], readers.PAIR_SCHEMA)
    readers.write_pairs(df, f"{tmp_path}/p")
    got = readers.read_pairs(spark, f"{tmp_path}/p").collect()
    assert len(got) == 1 and got[0].TITLE_FROM == row[1] and got[0].TEXT_FROM == row[4] and str(got[0].DATE_FROM) == "2010-05-01"


def test_other_readers(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps({"c1": {"paragraphs": {"1": "a", "2": "b"}, "meta": {"date": "2001-02-03"}}, "c2": {"paragraphs": {"1": "z"}, "meta": {"date": "?"}}}))
    assert sorted((r.celex, r.number, r.text) for r in readers.read_judgments(spark, str(tmp_path / "j.json")).collect()) == [("c1", 1, "a"), ("c1", 2, "b")]
    (tmp_path / "q.tsv").write_text("celex\tn\tq\nc1\t1\thello\nc1\tx\tbad\nc2\t3\n")
    assert [(r.celex, r.number) for r in readers.read_queries(spark, str(tmp_path / "q.tsv")).collect()] == [("c1", 1)]
    (tmp_path / "qrel.txt").write_text("a_b_3 0 c_4 1\nshort row\nx_y 0 z_1 1\n")
    assert [tuple(r) for r in readers.read_qrels(spark, str(tmp_path / "qrel.txt")).collect()] == [("a_b", 3, "c", 4)]
    for k, t in enumerate((" a \n\nb\n", "b\nc")):
        (tmp_path / f"i{k}.txt").write_text(t)
    ids = readers.read_ids(spark, str(tmp_path / "i0.txt"), str(tmp_path / "i1.txt"))
    assert sorted(r.id for r in ids.collect()) == ["a", "b", "c"]
    assert sorted(r.id for r in readers.pending(ids, spark.createDataFrame([("b",)], "id string")).collect()) == ["a", "c"]
    (tmp_path / "r.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    assert readers.read_records(spark, str(tmp_path / "r.json")).count() == 2


def test_files_and_predicates(spark, tmp_path):
    for name in ("62010CJ0001/fra_metadata.xml", "62010CJ0001/eng_metadata.xml", "62011CJ0002/metadata.xml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("<x/>")
    got = {r.celex: r.path.rsplit("/", 1)[1] for r in readers.case_files(spark, str(tmp_path)).collect()}
    assert got == {"62010CJ0001": "eng_metadata.xml", "62011CJ0002": "metadata.xml"}
    pages = spark.createDataFrame([("x Not a Robot",), ("Not a Robot" + " " * 9000,), ("",), (None,)], "c string")
    assert [r.x for r in pages.select(readers.anti_bot(F.col("c")).alias("x")).collect()] == [True, False, False, False]
    best = readers.best_version(spark.createDataFrame([("a", "eng", 0), ("a", "fra", 3), ("a", "deu", 9), ("b", "eng", 1), ("b", "fra", 5)], "celex string, lang string, n int"))
    assert {(r.celex, r.lang) for r in best.collect()} == {("a", "fra"), ("b", "eng")}
    assert readers.resolve(spark.createDataFrame([(1,)], "Celex_From int"), {"from": ("celex_from",)}).columns == ["from"]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    folder = f"{tmp_path}/in"
    e.repartitionByRange(3, "ts").write.parquet(folder)
    q = replay.windowed(replay.events(spark, folder, e.schema, 3)).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = e.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = lambda df: sorted((r.w.start, r.event_type, r.n) for r in df.collect())
    assert rows(spark.table("windows")) == rows(batch)


def test_replay_scores_before_adding(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").limit(200)
    folder = f"{tmp_path}/in"
    for k, part in enumerate(("event_id % 2 = 0", "event_id % 2 = 1")):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{folder}{k}")
    run = replay.Replay(spark, f"{tmp_path}/state", f"{tmp_path}/answers")
    for k in range(2):
        run(spark.read.parquet(f"{folder}{k}").withColumn("ts", F.col("ts").cast("timestamp")), k)
    run(spark.read.parquet(f"{folder}1").withColumn("ts", F.col("ts").cast("timestamp")), 1)  # again, as after a failure
    got = {r.event_id: r.earlier for r in spark.read.parquet(f"{tmp_path}/answers").collect()}
    rows = [(r.event_id, r.user_id, r.ts) for r in e.collect()]
    seen = lambda i, j: j % 2 < i % 2 or j % 2 == i % 2
    assert got == {i: sum(v == u and t < s and seen(i, j) for j, v, t in rows) for i, u, s in rows}


def test_language_mapping_and_judgments(spark, tmp_path):
    (tmp_path / "lang.json").write_text('{"a": {"1": "eng", "2": null}, "b": {}}')
    assert sorted(map(tuple, readers.read_language_mapping(spark, str(tmp_path / "lang.json")).collect())) == [("a", 1, "eng"), ("a", 2, "unknown")]
    rows = spark.createDataFrame([("a", "2001-02-03", 10, "x"), ("a", "2001-02-03", 2, "y"), ("a", "2001-02-03", 2, "z"), ("b", None, None, "n")], "celex string, date string, number int, text string")
    readers.write_judgments(rows.withColumn("date", F.to_date("date")), str(tmp_path / "out"))
    got = [json.loads(line) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert got == [{"celex": "a", "date": "2001-02-03", "paragraphs": {"2": "y", "10": "x"}}]
