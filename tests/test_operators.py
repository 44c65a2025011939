"""Operators: properties, plans, stores and streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import candidates, faces, ingest, labelling, reading, records, review
from quillspark.sources import database, files, jsonl, payloads, sinks
from quillspark.streaming import ingest as stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_partition_the_table(spark):
    df = spark.range(57).select(F.col("id"), (F.col("id") % 3).cast("string").alias("status"))
    got = [r.id for n in range(1, 8) for r in records.page(df, n, 10).collect()]
    assert got == list(range(57))
    assert "TakeOrderedAndProject" in plan(records.page(df, 2, 10))
    assert records.with_status(df, None).count() == records.with_status(df, "").count() == 57
    last, seen = None, []
    while rows := records.page_after(df, last, 10).collect():
        seen += [r.id for r in rows]
        last = seen[-1]
    assert seen == list(range(57))
    with pytest.raises(ValueError):
        records.page(df, 0, 10)


def test_neighbours_are_inverse(spark):
    df = spark.createDataFrame([(x,) for x in (3, 5, 9, 400_000, 1_000_001)], "id bigint")
    rows = {r.id: (r.previous, r.next) for r in records.with_neighbours(df).collect()}
    assert rows == {3: (None, 5), 5: (3, 9), 9: (5, 400_000), 400_000: (9, 1_000_001), 1_000_001: (400_000, None)}
    assert tuple(records.neighbours_of(df, 10).first()) == (9, 400_000)


def test_natural_order(spark):
    names = ["10.jpg", "2.jpg", "a.jpg", "3_mask.jpg", "B.png"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    assert [r.file_name for r in df.orderBy(*records.natural_order(ignore="_mask")).collect()] == ["2.jpg", "3_mask.jpg", "10.jpg", "a.jpg", "B.png"]


def test_resume_pointer(spark):
    f = spark.createDataFrame([(f"{i}.jpg",) for i in range(1, 8)], "file_name string")
    decided = f.where("file_name NOT IN ('2.jpg', '5.jpg')")
    assert [review.resume_at(f, decided, f"{k}.jpg").first().file_name for k in (3, 7, 99)] == ["5.jpg", "2.jpg", "2.jpg"]
    assert review.resume_at(f, f, "3.jpg").first().file_name == ""


def test_decisions(spark):
    log = spark.createDataFrame([("a", "approved", "1"), ("a", "rejected", "2"), ("b", "approved", "1")], "file_name string, status string, reviewed_at string")
    assert {r.file_name: r.status for r in review.latest(log).collect()} == {"a": "rejected", "b": "approved"}
    assert review.decide(log, "a", "approved", "3").count() == 3  # moved already
    assert review.decide(log, "b", "rejected", "3").count() == 4
    there = spark.createDataFrame([("a",), ("c",)], "file_name string")
    s = review.stats(there, review.latest(log)).first()
    assert tuple(s) == (0, 1, 1, 1, 3)


def test_duplicates(spark):
    old = spark.createDataFrame([("/x/A.jpg",), ("/y/b.jpg",)], "image_path string")
    new = spark.createDataFrame([(1, "/z/a.JPG"), (2, "/z/c.jpg"), (3, "/w/C.jpg"), (4, "\\y\\B.jpg"), (5, "/q/d.jpg")], "k int, image_path string")
    df = ingest.without_duplicates(new, old, [F.col("k")])
    # 1 has an old name, 3 the name of 2, and 4 an old path.
    assert sorted(r.k for r in df.collect()) == [2, 5]
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_second_run_has_nothing_to_do(spark):
    sources = spark.createDataFrame([("1.jpg",), ("2.jpg",)], "file_name string")
    outputs = sources.select(ingest.output_name(F.col("file_name"), "crop").alias("file_name"))
    none = sources.where("false")
    done = ingest.processed(none, none, outputs, "crop")
    assert ingest.pending(sources, done, outputs, none, "crop").count() == 0
    assert ingest.pending(sources, done, none, none, "crop").count() == 2


def test_store(spark, tmp_path):
    store = sinks.RecordStore(spark, str(tmp_path / "records"))
    assert store.current().count() == 0
    rows = spark.createDataFrame([("/a.jpg", "{}"), ("/b.jpg", "{}")], "image_path string, extracted_json string")
    ids = sorted(r.id for r in store.insert(rows).collect())
    assert len(set(ids)) == 2
    store.update(spark.createDataFrame([(ids[0], "[]", "reviewed")], "id bigint, reviewed_json string, status string"))
    store.insert_errors(spark.createDataFrame([("/c.jpg", "bad")], "image_path string, error_message string"))
    now = {r.image_path: r for r in store.current().collect()}
    assert (now["/a.jpg"].status, now["/a.jpg"].reviewed_json, now["/a.jpg"].extracted_json) == ("reviewed", "[]", "{}")
    assert (now["/b.jpg"].status, now["/c.jpg"].status, now["/c.jpg"].error_message) == ("ocr_done", "error", "bad")
    assert now["/a.jpg"].updated_at is not None and now["/b.jpg"].updated_at is None
    assert store.compact(str(tmp_path / "compact")).current().count() == 3
    again = store.insert(rows).collect()
    assert len({r.id for r in again} | set(ids)) == 4 and min(r.id for r in again) > max(ids)
    twice = sinks.with_columns(sinks.with_columns(rows, {"x": "string"}), {"x": "string"})
    assert twice.columns == ["image_path", "extracted_json", "x"]


def test_two_writers_never_share_a_number(spark, tmp_path):
    a, b = (sinks.RecordStore(spark, str(tmp_path / "records")) for _ in range(2))
    assert sorted([a._claim(), b._claim(), b._claim(), a._claim()]) == [1, 2, 3, 4]


def test_reviews_are_saved_whole(spark, tmp_path):
    store = sinks.RecordStore(spark, str(tmp_path / "records"))
    key = store.insert(spark.createDataFrame([("/a.jpg", "{}")], "image_path string, extracted_json string")).first().id
    schema = "id bigint, file_name string, status string, fields struct<surname:string>, payload struct<tokens:array<string>,bboxes:array<array<int>>,ner_tags:array<string>>"
    save = lambda status, tags: store.save_review(spark.createDataFrame([(key, "a.jpg", status, ("X",), (["T"], [[1, 5, 31, 25]], tags))], schema))
    save("reviewed", ["O"])
    r = store.current().first()
    assert r.status == "reviewed" and json.loads(json.loads(r.reviewed_json)["ground_truth"]) == {"gt_parse": {"surname": "X"}}
    assert json.loads(r.layoutlm_reviewed_json) == {"tokens": ["T"], "bboxes": [[1, 5, 31, 25]], "ner_tags": ["O"]}
    for status, tags, message in (("reviewed", [], "differ in length"), ("done", ["O"], "not a status")):
        with pytest.raises(Exception, match=message):
            save(status, tags)
    assert store.current().first() == r
    store.turn(spark.createDataFrame([(key, 90, 600, 800)], "id bigint, angle int, image_width int, image_height int"))
    now = store.current().first()
    assert json.loads(now.layoutlm_reviewed_json) == {"tokens": ["T"], "bboxes": [[5, 569, 25, 599]], "ner_tags": ["O"]} and now.layoutlm_json is None


def test_state_as_json(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None)], "done string, failed string")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert json.loads(sinks.state_json(df, ["done", "failed"], at).first().json) == {"done": ["a", "b"], "failed": ["x"], "updated_at_utc": "2024-01-02T03:04:05+00:00"}


def test_database_tables(spark, tmp_path):
    """With the embedded database whose driver Spark brings along."""
    values = {"DB_URL": f"jdbc:derby:{tmp_path}/db;create=true"}
    df = spark.range(50).select(F.col("id"), (F.col("id") % 7).alias("k"))
    database.write_table(df, "t", values)
    assert database.read_table(spark, "t", values).count() == 50
    parts = database.read_table(spark, "t", values, "id", 0, 50, 4)
    assert parts.rdd.getNumPartitions() == 4 and sorted(map(tuple, parts.collect())) == sorted(map(tuple, df.collect()))
    assert "*LessThan" in plan(parts.where("k < 2")) or "PushedFilters" in plan(parts.where("k < 2"))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"file_name": "A.jpg", "k": 1}\n\n[1]\n{"file_name": "a.jpg", "k": 2}\n{"k": 3}\n')
    df = jsonl.lines(spark, str(path))
    got = jsonl.strict(df).collect()
    assert [(r.file_name, json.loads(r.entry)["k"]) for r in got] == [("a.jpg", 2)]
    path.write_text('{"file_name": "A.jpg"}\nnope\n')
    assert jsonl.permissive(jsonl.lines(spark, str(path))).count() == 1
    with pytest.raises(Exception, match="isn't JSON"):
        jsonl.strict(jsonl.lines(spark, str(path))).collect()
    assert jsonl.without(jsonl.permissive(jsonl.lines(spark, str(path))), "A.jpg").count() == 0
    assert jsonl.document(spark, str(tmp_path / "none.json")).select(F.to_json("value").alias("v")).first().v == "{}"
    sinks.write_json_lines(spark.createDataFrame([("é",)], "a string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":"é"}'


def test_logs_by_day(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "s", "AAAA")], "timestamp string, stage string, image string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"), blobs=["image"])
    got = spark.read.json(str(tmp_path / "log")).collect()
    assert len(got) == 2 and got[0].image_length == 4 and str(got[0].date) == "2024-01-02"


def test_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("10.JPG", "2.png", "x.txt", "d/3.webp"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: [r.file_name for r in df.collect()]
    assert names(files.ordered(files.listing(spark, str(tmp_path)))) == ["10.JPG", "2.png"]
    every = files.listing(spark, str(tmp_path), recursive=True)
    assert names(files.ordered(every, natural=True)) == ["2.png", "3.webp", "10.JPG"]
    with pytest.raises(ValueError):
        files.supported(spark, str(tmp_path / "x.txt"), False)


def test_payloads(spark):
    raw = bytes.fromhex("89504E470D0A1A0A00")
    png = base64.b64encode(raw).decode()
    rows = [
        ("x.dat", png, ".png", None), ("", png, ".jpg", None), (None, "data:image/bmp;base64," + png, ".jpg", None), ("x", "data:image/bmp;base64," + png, ".bmp", None), ("x", "data:image/bmp;BASE64;a=b," + png, ".bmp", None),
        ("x", "data:;a=b;base64," + png, ".jpg", None), ("x", "data:image/heic;base64," + png, ".jpg", None), ("x", "data:image/png," + png, ".png", "bad data URI"), ("x", "data:x", ".jpg", "bad data URI"),
        ("a", "", ".jpg", "empty payload"), ("a", None, ".jpg", "empty payload"), ("a", "####", ".jpg", "invalid base64"), ("a", png[:4] + "\n" + png[4:], ".jpg", "invalid base64"), ("a", png.rstrip("=")[:-1], ".jpg", "invalid base64"),
        ("d/A.JPEG", png, ".jpeg", None), ("x", "data:image/png;base64, " + png + " ", ".png", None), ("x", "data:image/png;base64,", ".png", "empty content"),
    ]
    df = spark.createDataFrame([(i, p, n) for i, (n, p, _, _) in enumerate(rows)], "i int, payload string, file_name string")
    got = {r.i: r for r in payloads.decoded(df).collect()}
    assert [(got[i].extension, got[i].error) for i in range(len(rows))] == [(e, x) for _, _, e, x in rows]
    assert all(got[i].content == raw for i, x in enumerate(rows) if x[3] is None)
    blobs = spark.createDataFrame([(r.content_key, r.error) for r in got.values()], "content_key string, error string")
    kept = {r.content_key for r in got.values() if r.error is None}
    assert payloads.new_blobs(blobs, blobs.where("content_key LIKE '%.png'")).count() == len([k for k in kept if not k.endswith(".png")])


def test_settings(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# c\nA = 'x'\nB=yes\nnothing\n")
    values = database.settings(str(path), {"A": "y"})
    assert values == {"A": "y", "B": "yes"} and database.flag(values, "B", False) and database.flag(values, "C", True)
    assert database.connection({"DB_SERVER": "s", "DB_NAME": "d"})[0].startswith("jdbc:sqlserver://s;databaseName=d")


def test_renumbering_passes_over_taken_names(spark):
    f = spark.createDataFrame([("d", p, ".jpg") for p in "abc"], "folder string, path string, suffix string")
    taken = spark.createDataFrame([("d", 2, ".jpg")], "folder string, number int, suffix string")
    assert {r.path: r.new_name for r in sinks.renumbered(f, 1, taken).collect()} == {"a": "1.jpg", "b": "3.jpg", "c": "4.jpg"}
    assert {r.path: r.new_name for r in sinks.renumbered(f).collect()} == {"a": "1.jpg", "b": "2.jpg", "c": "3.jpg"}


def test_suppression(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 2, 50.0, 50.0, 10.0, 10.0, 0.75), (1, 3, 50.0, 50.0, 10.0, 10.0, 0.5), (2, 0, 0.0, 0.0, 10.0, 10.0, 0.7), (3, 0, 0.0, 0.0, 0.4, 10.0, 0.9), (3, 1, 0.9, 0.0, 0.2, 10.9, 0.8)]
    f = spark.createDataFrame(rows, "doc_id bigint, `order` int, `left` double, top double, width double, height double, score double")
    assert sorted((r.doc_id, r.order) for r in faces.suppressed(f).collect()) == [(1, 0), (1, 2), (3, 0)]


def test_reading_order_compares_with_the_lines_first(spark):
    # Each box is a little lower than the one before it: a chain that drifts starts a new line.
    rows = [(1, i, 100 - 10 * i, 8 * i, 110 - 10 * i, 8 * i + 10) for i in range(4)]
    e = spark.createDataFrame(rows, "doc_id int, nth int, `left` int, top int, `right` int, bottom int")
    got = {r.nth: (r.line, r.position) for r in reading.in_reading_order(e).collect()}
    assert got == {1: (1, 1), 0: (1, 2), 3: (2, 3), 2: (2, 4)}


def test_labels(spark):
    box = "struct<left:int,top:int,right:int,bottom:int,width:int,height:int>"
    w = spark.createDataFrame([(1, i, f"w{i}", t, (0, 0, 9, 9, 9, 9)) for i, t in enumerate(["An", "Van An", "01/02/2020"])], f"doc_id bigint, `order` int, id string, text string, bbox {box}")
    f = spark.createDataFrame([(1, "an", "van an", "2020-02-01")], "doc_id bigint, surname string, given_names string, date_of_birth string")
    r = labelling.payloads(w, f).first()
    assert r.tokens == ["AN", "VAN", "AN", "01/02/2020"]
    assert r.ner_tags == ["B-SURNAME", "B-GIVEN_NAMES", "I-GIVEN_NAMES", "B-DOB"]
    assert labelling.TAGS["place_of_birth"] == "POB" and labelling.TAGS["issuing_authority"] == "PLACE_OF_ISSUE" and labelling.TAGS["sex"] == "SEX"
    assert records.tag_vocabulary(["SEX"]) == ["O", "B-SEX", "I-SEX"]


def test_arriving_files_are_taken_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.jpg").write_bytes(b"x")
    run = lambda: stream.run_once(stream.arriving_files(spark, str(source), 2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (source / "3.jpg").write_bytes(b"x")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_lines_in_windows_of_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"at": f"2024-01-01T00:{m:02d}:00", "kind": k}) for m, k in ((1, "x"), (2, "x"), (11, "x"), (3, "y"))))
    rows = stream.arriving_lines(spark, str(tmp_path / "in"), "at timestamp, kind string")
    q = stream.windowed_counts(rows, "at", "kind").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.kind, r.start.minute, r.n) for r in spark.table("counted").collect()) == [("x", 0, 2), ("x", 10, 1), ("y", 0, 1)]


def test_inputs_leave_out_their_own_outputs(spark):
    df = spark.createDataFrame([("/in/a.jpg",), ("/in/out/b.jpg",), ("/in/outer/c.jpg",)], "path string")
    assert [r.path for r in files.inputs(df, "/in/out").collect()] == ["/in/a.jpg", "/in/outer/c.jpg"]


def test_matches_in_per_cent(spark):
    box = "struct<left:int,top:int,right:int,bottom:int,width:int,height:int>"
    df = spark.createDataFrame([((10, 20, 40, 60, 30, 40), 0.123456)], f"bbox {box}, score double")
    r = candidates.serialized(df, F.lit(300), F.lit(400)).first()
    assert tuple(r.bbox) == (3.3333, 5.0, 10.0, 10.0) and r.score == 0.1235


def test_small_expressions(spark):
    from quillspark.functions import geometry, jsonx
    from quillspark.schema import FIELDS

    r = spark.range(1).select(geometry.rectangle(*map(F.lit, (1, 2, 3, 4))).alias("p"), jsonx.trimmed(F.struct(*[F.lit(" x ").alias(f) for f in FIELDS])).alias("t")).first()
    assert r.p == [[1, 2], [3, 2], [3, 4], [1, 4]] and set(r.t) == {"x"}


def test_entries_that_are_no_objects_have_no_new_form(spark):
    from quillspark.functions import jsonx

    entries = ['{"a": 1.5, "file_name": "x", "ground_truth": "{\\"gt_parse\\": {\\"sex\\": null}, \\"v\\": [true]}"}', '{"ground_truth": {"gt_parse": {"personal_number": "1"}}}', '{"ground_truth": "nope", "n": null}', "[1]", None]
    df = spark.createDataFrame(list(enumerate(entries)), "i int, entry string")
    got = {r.i: r.j and json.loads(r.j) for r in df.select("i", jsonx.blanked(F.col("entry"), F.lit("y")).alias("j")).collect()}
    assert json.loads(got[0].pop("ground_truth")) == {"gt_parse": {"sex": None, "personal_number": ""}, "v": [True]}
    assert got == {0: {"a": 1.5, "file_name": "y"}, 1: {"ground_truth": {"gt_parse": {"personal_number": "1"}}, "file_name": "y"}, 2: {"ground_truth": "nope", "n": None, "file_name": "y"}, 3: None, 4: None}
