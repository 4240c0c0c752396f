"""Known inputs and their results."""

import pytest
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.checksums import verhoeff_valid
from idlens.functions.numbers import class_confidence, mrz_date
from idlens.operators.classify import classify
from idlens.operators.extract import extract_aadhaar, extract_fields, extract_licence, extract_passport
from idlens.operators.layout import apply_side_rules, layout_subtype
from idlens.operators.mrz import parse_mrz
from idlens.operators.validate import validate
from idlens.plans.batch import process_pages


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id int, raw_text string")


def test_verhoeff(spark):
    cases = {"836696393224": True, "556998868624": True, "123456789012": False, "111111111111": False,
             "000000000000": False, "8366 9639 3224": True, "83669639322": False}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: r.v for r in df.select("u", verhoeff_valid(F.col("u")).alias("v")).collect()}
    assert got == cases


def test_every_wrong_digit_is_found(spark):
    right = "836696393224"
    wrong = [right[:i] + d + right[i + 1:] for i in range(12) for d in "0123456789" if d != right[i]]
    df = spark.createDataFrame([(w,) for w in wrong], "u string")
    assert df.where(verhoeff_valid(F.col("u"))).count() == 0


def test_passport_zone(spark):
    zone = "P<INDTESTER<<JANE<<<<<<<<<<<<<<<<<<<<<<<<<<\nL6027710<4IND8305295M2311241<<<<<<<<<<<<<<8"
    m = parse_mrz(texts(spark, zone)).first().mrz
    assert (m.passport_number, m.surname, m.given_name) == ("L6027710", "TESTER", "JANE")
    assert m.number_ok and m.dob_ok and m.expiry_ok and m.mrz_checksum_lenient
    assert not m.mrz_checksum_valid  # 43 characters: the composite digit is out of place


def test_visa_zone_is_read(spark):
    zone = "VTINDTESTER<<JANE<SMITH<<<<<<<<<<<<<<<<<<<<\nVJDCHCC<<AUS9310140M1706262AUS<<<<<<<<<<<8"
    m = parse_mrz(texts(spark, zone)).first().mrz
    assert m is not None and m.mrz_checksum_lenient and m.surname == "TESTER"


def test_standard_specimen_checks(spark):
    zone = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    m = parse_mrz(texts(spark, zone)).first().mrz
    assert m.mrz_checksum_valid and m.given_name == "ANNA MARIA" and m.dob == "12/08/1974"
    broken = zone.replace("7408122", "7408132")
    assert not parse_mrz(texts(spark, broken)).first().mrz.mrz_checksum_valid


def test_classes(spark):
    cases = [
        ("UNIQUE IDENTIFICATION AUTHORITY OF INDIA Government of India Aadhaar 8366 9639 3224 Male DOB: 20/06/1986", "aadhaar"),
        ("PASSPORT REPUBLIC OF INDIA P<INDDOE<<JOHN<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<< L1234567", "passport"),
        ("UNION DRIVING LICENCE LICENCING AUTHORITY DL NO DL1420110012345 CLASS OF VEHICLE MCWG LMV", "driving_licence"),
        ("INDIAN VISA VISA TYPE TOURIST NO OF ENTRIES SINGLE VTINDDOE<<JOHN", "visa"),
        ("Random unclassified plain text without any document landmarks", "unknown"),
    ]
    rows = classify(texts(spark, *[c[0] for c in cases])).orderBy("doc_id").collect()
    assert [r.document_type for r in rows] == [c[1] for c in cases]
    assert all(r.confidence >= 50 for r in rows[:4]) and rows[4].confidence == 0.0


def test_ties_take_the_earlier_class(spark):
    # 40 points for aadhaar (UID) and for driving_licence (DL)
    row = classify(texts(spark, "uid dl")).first()
    assert row.all_scores["aadhaar"] == row.all_scores["driving_licence"] == 40
    assert row.document_type == "aadhaar"


def test_word_boundary_option(spark):
    loose, strict = (classify(texts(spark, "GUIDE HANDLE"), word_boundary=b).first() for b in (False, True))
    assert loose.document_type == "aadhaar" and strict.document_type == "unknown"


def test_aadhaar_names(spark):
    two_scripts = """
        भारत सरकार
        Government of India
        विलास राखे
        Vilas Rakhe
        जन्म तारीख/DOB: 30/05/1995
        पुरुष/ MALE
        7730 0889 2163
        """
    one_line = """
        Government of India
        अनिल कुमार / Anil Kumar
        DOB: 15/08/1988
        MALE
        8366 9639 3224
        """
    a, b = (r.aadhaar for r in extract_aadhaar(texts(spark, two_scripts, one_line)).orderBy("doc_id").collect())
    assert (a.name, a.aadhaar_number, a.dob, a.gender) == ("Vilas Rakhe", "773008892163", "30/05/1995", "MALE")
    assert b.name == "Anil Kumar"


def test_block_names_are_the_last_resort(spark):
    df = spark.createDataFrame([("12345", [("x9", 1.0), ("Asha Rao", 2.0)])],
                               "raw_text string, blocks array<struct<text:string,confidence:double>>")
    assert extract_aadhaar(df, blocks="blocks").first().aadhaar.name == "Asha Rao"


def test_complete_payload_beats_the_text(spark):
    df = texts(spark, "Name: Someone\n5569 9886 8624\nAddress: x 411001").withColumn(
        "payload", F.lit('<x uid="836696393224" name="Asha Rao" dob="01/02/1990" gender="F"/>'))
    a = extract_aadhaar(df, payload="payload").first().aadhaar
    assert (a.aadhaar_number, a.name, a.dob, a.gender, a.address) == ("836696393224", "Asha Rao", "01/02/1990", "F", None)
    assert a.aadhaar_number_valid


def test_address_keeps_its_pin(spark):
    a = extract_aadhaar(texts(spark, "Address: 12 MG Road,\n  Pune 411001 India")).first().aadhaar
    assert a.address == "Address: 12 MG Road, Pune - 411001"


def test_licence(spark):
    text = """
        INDIAN UNION DRIVING LICENCE
        DL NO TS00820260009319
        Name: Rajesh Varma
        DOB: 10/09/1990
        S/O: Suresh Varma
        """
    x = extract_licence(texts(spark, text)).first().licence
    assert (x.name, x.dl_number, x.relation_name) == ("Rajesh Varma", "TS00820260009319", "Suresh Varma")


def test_passport_without_zone(spark):
    text = """
        PASSPORT REPUBLIC OF INDIA
        Given Name: Garima
        Surname: Thapliyal
        DOB: 01/07/1994
        Sex: F
        """
    x = extract_passport(texts(spark, text)).first().passport
    # surname first; the date without its label
    assert (x.name, x.dob, x.sex, x.nationality) == ("Thapliyal Garima", "01/07/1994", "F", "INDIAN")


@pytest.mark.parametrize("size, face, text, want", [
    ((700, 1000), False, "UNIQUE IDENTIFICATION AUTHORITY OF INDIA ENROLMENT NO", "full_e_aadhaar"),
    ((750, 350), False, "", "cut_out_dual_card"),
    ((550, 600), False, "", "stacked_dual_card"),
    ((480, 300), False, "ADDRESS S/O JOHN DOE PIN 560001", "single_card_back"),
    ((480, 300), True, "ADDRESS S/O JOHN DOE PIN 560001", "single_card_front"),
])
def test_layout(spark, size, face, text, want):
    df = spark.createDataFrame([(*size, face, text)], "w int, h int, f boolean, t string")
    assert df.select(layout_subtype(F.col("w"), F.col("h"), F.col("f"), F.col("t"))).first()[0] == want


def test_side_rules(spark):
    df = spark.createDataFrame([(0, "aadhaar", "front"), (1, "aadhaar", "back"), (2, "passport", "front"),
                                (3, "driving_license", "back"), (4, "pan", "auto"), (5, None, None)],
                               "i int, doc_type string, side string")
    got = {r.i: r for r in apply_side_rules(df, rules.side_rule_frame(spark)).collect()}
    assert got[0].extract_photo and not got[0].extract_qr
    assert not got[1].extract_photo and got[1].extract_qr
    assert not got[2].extract_qr and got[2].extract_mrz
    assert got[3].target_fields == ["address", "vehicle_classes"]
    assert (got[4].rule_type, got[4].rule_side) == ("aadhaar", "full_page") == (got[5].rule_type, got[5].rule_side)


def test_dates_and_confidence(spark):
    df = spark.createDataFrame([("260101", 0), ("250101", 60), ("800101", 65), ("79AB01", 1000)], "d string, s int")
    rows = df.select(mrz_date(F.col("d")).alias("b"), mrz_date(F.col("d"), True).alias("e"),
                     class_confidence(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("01/01/1926", "01/01/2026", 0.0), ("01/01/2025", "01/01/2025", 40.0),
                                        ("01/01/1980", "01/01/1980", 85.0), ("79AB01", "79AB01", 99.0)]


def test_unknown_types_get_passport_rules(spark):
    df = texts(spark, "Surname: Rao\nGiven Name: Asha").withColumn("document_type", F.lit("unknown"))
    assert extract_fields(df).first().fields.name == "Rao Asha"


def test_validation_policies(spark):
    zone = "P<INDTESTER<<JANE<<<<<<<<<<<<<<<<<<<<<<<<<<\nL6027710<4IND8305295M2311241<<<<<<<<<<<<<<8"
    fields = extract_fields(texts(spark, zone).withColumn("document_type", F.lit("passport")))
    assert validate(fields).first().validation_status["overall"] == "fail"
    assert validate(fields, mrz_policy="lenient").first().validation_status["overall"] == "pass"


def test_page_results(spark):
    pages = spark.createDataFrame(
        [("GOVERNMENT OF INDIA\nAsha Rao\nDOB: 01/02/1990\nFEMALE\n8366 9639 3224",
          '<x uid="836696393224" name="Someone Else" dob="01/02/1990"/>', "a.jpg", 1)],
        "raw_text string, payload string, file_name string, page_number int")
    r = process_pages(pages).first()
    assert r.document_type == "aadhaar" and r.validation_status["overall"] == "pass"
    # the payload is complete, so its name is taken and nothing contradicts it
    assert r.fields.name == "Someone Else" and r.qr_check.qr_ocr_match and not r.tampered
    assert 0 <= r.format_verification.format_match_score <= 100
