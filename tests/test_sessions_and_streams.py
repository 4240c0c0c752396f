"""Sides, hot sessions, history, sources, sinks and streams on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from idlens import rules
from idlens.catalog.inputs import relation
from idlens.operators import assemble as A
from idlens.operators import history as H
from idlens.operators import sessions as S
from idlens.operators.classify import keyword_hits
from idlens.operators.crosscheck import verify_registry
from idlens.operators.extract import extract_fields, register_extractor, unregister_extractor
from idlens.operators.layout import exclude_overlaps
from idlens.plans.batch import process_pages, result_columns, run_batch, run_sides
from idlens.plans.verification import session_facts, verify_sessions
from idlens.session import scratch_path
from idlens.sources import readers, sinks
from idlens.streaming import jobs

RESULT = ("session_id int, seq int, document_type string, document_name string,"
          " fields struct<name:string,dob:string,gender:string,address:string>, qr_detected boolean, qr_data string, raw_ocr_text string")


def side(session, seq, kind="aadhaar", name=None, address=None, qr=None):
    return (session, seq, kind, "Card", (name, None, None, address), qr is not None, qr, f"t{seq}")


def plain_merge(rows):
    """The rule for one session, row by row."""
    front = back = None
    for r in rows:
        f = r[4]
        if (f[0] or f[1] or f[2]) and front is None:
            front = r
        elif (f[3] or r[5]) and back is None:
            back = r
    if front and back and front[2] == back[2]:
        merged = tuple(a if a else (b if b else a) for a, b in zip(front[4], back[4]))
        return [(front[1], merged)] + [(r[1], r[4]) for r in rows if r is not front and r is not back]
    return [(r[1], r[4]) for r in rows]


def test_merge_equals_the_plain_loop_with_a_hot_session(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(600):
        session = 0 if seq % 3 == 0 else rng.randrange(1, 60)  # one session holds a third
        rows.append(side(session, seq, rng.choice(["aadhaar", "aadhaar", "visa"]), rng.choice([None, "", f"n{seq}"]),
                         rng.choice([None, f"a{seq}"]), rng.choice([None, None, "q"])))
    got = S.merge_sides(spark.createDataFrame(rows, RESULT)).select("session_id", "seq", "fields").collect()
    want = []
    for session in {r[0] for r in rows}:
        want += [(session, s, f) for s, f in plain_merge([r for r in rows if r[0] == session])]
    assert len(got) == len(want)
    assert {(r.session_id, r.seq): tuple(r.fields) for r in got} == {(a, b): c for a, b, c in want}


def test_merge_leaves_merged_rows_alone(spark):
    rows = spark.createDataFrame([side(1, 1, name="Asha"), side(1, 2, address="Street"), side(1, 3, name="Ravi")], RESULT)
    once = S.merge_sides(rows).drop("back_qr_data")
    assert once.count() == 2
    merged = once.where("seq = 1").first()
    assert (merged.fields.name, merged.fields.address) == ("Asha", "Street")
    assert merged.raw_ocr_text == "t1\n--- BACK SIDE ---\nt2"


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS session_id", "id AS seq")
    plan = S.first_rows(df, ["session_id"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # per input partition, then after the exchange


def test_risk_trend_with_a_hot_holder(spark):
    rng = random.Random(3)
    rows = [(f"h{i:04d}", 0 if i % 3 == 0 else i % 40, i // 4, float(rng.randrange(100))) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, holder int, t int, risk_score double").select(
        "id", "holder", F.timestamp_seconds("t").alias("timestamp"), "risk_score")
    got = {r.id: (r.risk_change, r.running_mean) for r in H.risk_trend(df).collect()}
    seen = {}
    for ident, holder, _, value in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        past = seen.setdefault(holder, [])
        change = value - past[-1] if past else None
        past.append(value)
        assert got[ident][0] == change
        assert got[ident][1] == pytest.approx(sum(past) / len(past))
    assert len(got) == 900


def test_words_to_text(spark):
    rows = [(1, 1, "tesseract", 3, "two", None, 90.0, 0, 1), (1, 1, "tesseract", 1, " one ", None, 80.0, 0, 0),
            (1, 1, "tesseract", 2, " ", None, 70.0, 0, 0), (1, 1, "tesseract", 4, "gone", None, 0.0, 0, 1),
            (1, 1, "tesseract", 5, "three", None, 70.0, 0, 1), (2, 1, "paddleocr", 2, "b", None, 0.0, None, None),
            (2, 1, "paddleocr", 1, "a", None, 50.0, None, None), (3, 1, "tesseract", 1, "", None, 9.0, 0, 0)]
    got = {r.doc_id: r for r in A.assemble_text(spark.createDataFrame(rows, readers.BLOCK_SCHEMA), ["doc_id"]).collect()}
    assert (got[1].raw_text, got[1].confidence_score, got[1].text_blocks_count) == ("one\ntwo three", 80.0, 3)
    assert (got[2].raw_text, got[2].confidence_score) == ("a\nb", 25.0)
    assert (got[3].raw_text, got[3].confidence_score, got[3].text_blocks_count) == ("", 0.0, 0)


def test_engine_preference(spark):
    rows = [(1, "paddleocr", "short", 1.0), (1, "easyocr", "long enough text", 2.0), (1, "tesseract", "also long enough", 3.0),
            (2, "tesseract", "tiny", 4.0)]
    ocr = spark.createDataFrame(rows, "doc_id int, engine string, raw_text string, confidence_score double")
    auto = {r.doc_id: r for r in A.pick_engine(ocr, ["doc_id"]).collect()}
    assert auto[1].engine == "easyocr" and (auto[2].engine, auto[2].raw_text, auto[2].confidence_score) == ("fallback", "", 85.0)
    forced = {r.doc_id: r.engine for r in A.pick_engine(ocr, ["doc_id"], "paddleocr").collect()}
    assert forced == {1: "fallback", 2: "fallback"}


def test_overlapping_boxes_go(spark):
    boxes = spark.createDataFrame([(1, "on", [0, 0, 10, 10]), (1, "off", [50, 50, 60, 60]), (2, "free", [0, 0, 5, 5])],
                                  "doc_id int, n string, bbox array<int>")
    photos = spark.createDataFrame([(1, [0, 0, 10, 4])], "doc_id int, bbox array<int>")
    assert {r.n for r in exclude_overlaps(boxes, photos, ["doc_id"]).collect()} == {"off", "free"}


def test_masked_registry_claims(spark):
    cols = "doc_id int, doc_type string, id_number string, name string, dob string, gender string"
    registry = spark.createDataFrame([
        (0, "aadhaar", "111122223333", "Asha Rao", "d1", "F"), (0, "aadhaar", "999922223333", "Ravi Das", "d2", "M")], cols).drop("doc_id")
    claims = spark.createDataFrame([
        (1, "aadhaar", "XXXX XXXX 3333", "asha rao", "d1", "Female"), (2, "aadhaar", "XXXX XXXX 3333", "asha rao", "d2", "Female"),
        (3, "aadhaar", "1111 2222 3333", "Asha Rao", "d1", "F"), (4, "aadhaar", "000000000000", "Asha Rao", "d1", "F")], cols)
    got = {r.doc_id: r for r in verify_registry(claims, registry, ["doc_id"]).collect()}
    assert got[1].is_verified and got[3].is_verified
    # both facts exist under these digits, but not for one person
    assert got[2].name_verified and got[2].dob_verified and not got[2].is_verified
    assert not got[4].id_found and not got[4].is_verified


def test_custom_extractor(spark):
    register_extractor("pan", lambda text, lines, payload: F.struct(F.get(lines, F.lit(0)).alias("name")))
    try:
        df = spark.createDataFrame([("pan", "Asha\nx")], "document_type string, raw_text string")
        assert extract_fields(df).first().fields.name == "Asha"
    finally:
        unregister_extractor("pan")


def test_two_sides_to_one_record(spark):
    rows = [(1, 1, "front", "GOVERNMENT OF INDIA\nAsha Rao\nDOB: 01/02/1990\nFEMALE\n8366 9639 3224", None),
            (1, 2, "back", "S/O: Mohan Das\nStreet 5", None), (2, 3, "back", "Address: x\nVID: 8366 9639 3224", None)]
    df = spark.createDataFrame(rows, "session_id int, seq int, side string, raw_text string, payload string")
    got = {r.session_id: r for r in run_sides(df).collect()}
    assert got[1].fields.name == "Asha Rao" and got[1].fields.address == "S/O: Mohan Das Street 5"
    assert got[1].validation_status["overall"] == "pass"
    assert got[2].document_type == "aadhaar" and got[2].confidence == 90.0


def test_batch_from_words(spark):
    text = "GOVERNMENT OF INDIA\nAsha Rao\nDOB: 01/02/1990\nFEMALE\n8366 9639 3224"
    rows = [(1, 1, "tesseract", i * 100 + j, w, [0, 0, 1, 1], 90.0, 0, i)
            for i, line in enumerate(text.split("\n")) for j, w in enumerate(line.split(" "))]
    pages = spark.createDataFrame([(1, 1, "a.jpg"), (2, 1, "b.jpg")], "doc_id long, page_number int, file_name string")
    qr = spark.createDataFrame([], "doc_id long, page_number int, payload string, method string")
    got = {r.doc_id: r for r in run_batch(spark.createDataFrame(rows, readers.BLOCK_SCHEMA), pages, qr).collect()}
    assert got[1].raw_ocr_text == text and got[1].fields.name == "Asha Rao" and got[1].text_blocks_count == len(rows)
    assert got[2].raw_ocr_text == "" and got[2].ocr_confidence == 0.0


def test_sides_merge_in_two_scans(spark, tmp_path):
    rows = [(s, q, "aadhaar", "Card", ("A", None, None, None) if q == 1 else (None, None, None, "Street"), False, None, f"t{q}")
            for s in range(20) for q in range(1, 4)]
    schema = ("session_id int, seq int, document_type string, document_name string, "
              "fields struct<name:string,dob:string,gender:string,address:string>, qr_detected boolean, qr_data string, raw_ocr_text string")
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "results"))
    merged = S.merge_sides(spark.read.parquet(str(tmp_path / "results")))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and "WindowGroupLimit" in plan
    got = merged.collect()
    assert len(got) == 40 and sum(r.document_name.endswith(S.MERGED_SUFFIX) and r.fields.address == "Street" for r in got) == 20


def test_batch_takes_a_name_from_its_own_block(spark):
    # below the anchor no line rule looks; the block of the name alone tells it
    lines = ["GOVERNMENT OF INDIA", "DOB: 01/02/1990", "FEMALE", "8366 9639 3224", "Asha Rao"]
    rows = [(d, 1, engine, i, line, [0, 0, 1, 1], 90.0, None, None)
            for d, engine in ((1, "paddleocr"), (2, "fallback")) for i, line in enumerate(lines)]
    rows += [(3, 1, "paddleocr", i, line, [0, 0, 1, 1], 90.0, None, None) for i, line in enumerate(lines[:4])]
    pages = spark.createDataFrame([(d, 1, "in/card.jpg") for d in (1, 2, 3)], "doc_id long, page_number int, file_name string")
    qr = spark.createDataFrame([], "doc_id long, page_number int, payload string, method string")
    results = run_batch(spark.createDataFrame(rows, readers.BLOCK_SCHEMA), pages, qr)
    got = {r.doc_id: r for r in results.collect()}
    assert got[1].fields.name == "Asha Rao" and got[1].document_type == "aadhaar"
    assert got[2].raw_ocr_text == "" and got[2].fields.name is None
    assert got[3].fields.name is None and "name_blocks" not in results.columns


def test_history_keeps_fields_and_paths_but_no_numbers(spark):
    page = spark.createDataFrame([(1, "GOVERNMENT OF INDIA\nAsha Rao\nDOB: 01/02/1990\nFEMALE\n8366 9639 3224", "a.jpg", 1)],
                                 "session_id long, raw_text string, file_name string, page_number int")
    results = process_pages(page.withColumn("payload", F.lit(None).cast("string"))).withColumn("timestamp", F.timestamp_seconds("session_id"))
    none = spark.createDataFrame([], "session_id long, ekyc_verified boolean, ekyc_skipped boolean, face_matched boolean, doc_type string")
    paths = spark.createDataFrame([(1, "image/1.jpg", None)], "session_id long, front_file string, back_file string")
    row = verify_sessions(session_facts(results, none, none, none, paths=paths)).first()
    fields = json.loads(row.extracted_fields)
    assert fields["name"] == "Asha Rao" and fields["aadhaar_number"] == row.identifier == "XXXXXXXX3224"
    assert json.loads(row.saved_paths) == {"front": "image/1.jpg"} and "83669639" not in str(row)


def test_sessions_to_history(spark):
    pages = spark.createDataFrame([
        (1, "GOVERNMENT OF INDIA\nAsha Rao\nDOB: 01/02/1990\nFEMALE\n8366 9639 3224", "a.jpg", 1),
        (2, "INDIAN VISA\nName: Ravi Das", "b.jpg", 1)], "session_id long, raw_text string, file_name string, page_number int")
    results = process_pages(pages.withColumn("payload", F.lit(None).cast("string"))).withColumn("timestamp", F.timestamp_seconds("session_id"))
    ekyc = spark.createDataFrame([(1, True, False)], "session_id long, ekyc_verified boolean, ekyc_skipped boolean")
    faces = spark.createDataFrame([(1, True), (2, True)], "session_id long, face_matched boolean")
    na = spark.createDataFrame([(1, "bank_statement")], "session_id long, doc_type string")
    got = {r.document_type: r for r in verify_sessions(session_facts(results, ekyc, faces, na)).collect()}
    good, bad = got["aadhaar"], got["visa"]
    assert good.risk_level == "LOW" and good.identifier == "XXXXXXXX3224" and good.ekyc_verified
    checks = json.loads(good.result)["checks"]
    assert [c["id"] for c in checks] == ["doc_info", "integrity", "face", "tamper", "ekyc", "na_bank_statement"]
    assert bad.risk_level == "HIGH" and 70 <= bad.risk_score <= 85


def test_manifest_scan(spark, tmp_path):
    for name in ("a.JPG", "b.pdf", "test.txt", "noext"):
        (tmp_path / name).write_text("x")
    got = {r.file_name: r for r in readers.scan_manifest(spark, str(tmp_path)).collect()}
    assert got["a.JPG"].accepted and got["b.pdf"].accepted
    assert not got["test.txt"].accepted and got["test.txt"].error.startswith("Unsupported file format")
    assert not got["noext"].accepted


def test_registry_files(spark, tmp_path):
    (tmp_path / "aadhar.json").write_text(json.dumps({"name": "R S", "aadhaar_number": "XXXX XXXX 7821", "pincode": "411001"}, indent=1))
    (tmp_path / "bad.json").write_text("{ not json")
    got = readers.read_registry(spark, {"aadhaar": str(tmp_path / "aadhar.json"), "visa": str(tmp_path / "bad.json"),
                                        "passport": str(tmp_path / "missing.json")}).collect()
    assert [(r.doc_type, r.id_number, r.attrs) for r in got] == [("aadhaar", "XXXX XXXX 7821", {"pincode": "411001"})]


def test_history_ids_repeat(spark):
    path = scratch_path(spark, "history-test")
    items = spark.createDataFrame([(1, "aadhaar", "836696393224")], "session_id int, document_type string, identifier string")
    first = sinks.append_history(items, path).first()
    again = sinks.append_history(items, path).first()
    assert first.id == again.id and first.identifier == "XXXXXXXX3224"
    assert first.extracted_fields == "{}" and spark.read.parquet(path).count() == 1
    sinks.append_history(items.withColumn("identifier", F.lit("Unknown ID")), path, run="1")
    assert {r.identifier for r in spark.read.parquet(path).collect()} == {"XXXXXXXX3224", "Unknown ID"}
    for _ in range(2):
        sinks.append_users(items.select(F.lit(None).cast("string").alias("name")), path + "-users")
    assert [r.name for r in spark.read.parquet(path + "-users").collect()] == ["Unknown"]


def test_unnamed_batches_add_up(spark):
    path = scratch_path(spark, "batches-test")
    rows = [("1", "a", None, "2024-01-01 00:00:00.000001"), ("2", None, "a", "2024-01-01 00:00:00.000001"), ("2", "a", None, "2024-01-01 00:00:00.000001"),
            ("2", "a", None, "2024-01-01 00:00:00.000002")]
    frames = [spark.createDataFrame([r], "session_id string, document_type string, file_name string, at string").withColumn("at", F.to_timestamp("at")) for r in rows]
    both = frames[0].unionByName(frames[1])
    for batch in (*frames, frames[0], both, frames[1].unionByName(frames[0]).repartition(3)):
        sinks.append_history(batch, f"{path}-history")
        sinks.append_users(batch.withColumnRenamed("document_type", "name"), f"{path}-users")
    # the four rows apart, and the two as a batch of their own
    assert spark.read.parquet(f"{path}-history").count() == spark.read.parquet(f"{path}-users").count() == 6


def test_large_dictionary(spark):
    words = [("t", f"K{i:05}", 1) for i in range(50_000)] + [("u", "zé", 2), ("u", "Q", 3), ("u", "", 9)]
    texts = [(1, "k00007k12345 and k0000"), (2, "ZÉ k49999"), (3, None), (4, "qq"), (4, "qq")]
    hits = keyword_hits(spark.createDataFrame(texts, "id int, raw_text string"), spark.createDataFrame(words, rules.KEYWORD_SCHEMA))
    assert sorted((r.id, r.keyword) for r in hits.collect()) == [(1, "K00007"), (1, "K12345"), (2, "K49999"), (2, "ZÉ"), (4, "Q"), (4, "Q")]


def test_masked_and_bare_numbers(spark):
    schema = "doc_id int, doc_type string, id_number string, name string, dob string, gender string"
    registry = spark.createDataFrame([(0, "visa", "V0001234", "A", "d", "F"), (0, "aadhaar", "111122223333", "A", "d", "F")], schema)
    claims = [(1, "visa", "VX991234", "A", "d", "F"), (2, "aadhaar", "XXXX XXXX 3333", "A", "d", "F"), (3, "visa", None, "A", "d", "F"), (4, None, "V0001234", "A", "d", "F"), (5, "visa", "v000 1234", "A", "d", "F")]
    got = verify_registry(spark.createDataFrame(claims, schema), registry, ["doc_id"]).collect()
    assert {r.doc_id: r.is_verified for r in got} == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_boxes_under_several_photos(spark):
    boxes = spark.createDataFrame([(1, [0, 0, 10, 10]), (1, [50, 50, 60, 60]), (2, [0, 0, 10, 10])], "page int, bbox array<int>")
    photos = spark.createDataFrame([(1, [0, 0, 20, 20]), (1, [100, 100, 120, 120]), (1, [0, 0, 20, 20])], "page int, bbox array<int>")
    assert sorted(map(tuple, exclude_overlaps(boxes, photos, ["page"]).collect())) == [(1, [50, 50, 60, 60]), (2, [0, 0, 10, 10])]


def test_stream_equals_batch(spark, sf_dir):
    batch = relation(spark, sf_dir, "kyc")
    path = scratch_path(spark, "kyc-test")
    batch.repartition(3).write.parquet(path)
    stream = jobs.read_stream(spark, path, batch.schema, files_per_batch=1)
    streamed = jobs.drained(spark, jobs.intake(stream), "intake-test")
    want = result_columns(process_pages(batch))
    cols = ["doc_id", "document_type", "confidence", "fields", "tampered"]
    assert sorted(map(str, streamed.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_replayed_batches_count_once(spark):
    path = scratch_path(spark, "replay-test")
    write = jobs.history_writer(path)
    rows = spark.range(5)
    write(rows, 0)
    write(rows, 0)
    write(rows, 1)
    assert spark.read.parquet(path).count() == 10
