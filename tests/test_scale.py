"""Work that is done once a row and dealt to all tasks, read off plans over small tables of their own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import REGISTRY
from idlens.catalog.inputs import RELATIONS, check_digit_sql
from idlens.catalog.registry import rel
from idlens.functions.checksums import ICAO_CHARACTERS, ICAO_WEIGHTS


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One file a table, so one task's scan."""
    path = tmp_path_factory.mktemp("tables")
    texts = [(i, f"GOVERNMENT OF INDIA\nAsha Rao {i}\nDOB: 01/02/1990\n" + "second line\n" * (i % 5)) for i in range(40)]
    spark.createDataFrame([(i,) for i in range(1, 121)], "c_custkey bigint").coalesce(1).write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([*texts, (40, None), (41, "")], "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def stages(df) -> int:
    """Tasks that the last stage has."""
    return df.rdd.getNumPartitions()


def test_generic_lines_write_out_the_classes_once(spark, tables):
    found = REGISTRY["srt3_generic_lines"].run(spark, tables)
    light = REGISTRY["ext6_light_rules"].run(spark, tables)
    # a filter pushed below the classes repeated each keyword hundreds of times
    assert len(plan(found)) <= 2 * len(plan(light))
    assert found.where("line IS NULL").count() == 0 and found.count() > 0


@pytest.mark.parametrize("name", ["mth2_icao_digits", "udf1_table_zones", "jn15_zone_repair"])
def test_zone_queries_deal_out_rows_and_stay_small(spark, tables, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = REGISTRY[name].run(spark, tables)
    assert "RepartitionByExpression" in plan(found)  # one row group of customers is no longer one task's work
    assert plan(found).count("instr(") <= 18  # 54 for each text of a zone, more than Spark compiles
    assert rel(spark, tables, "zone").rdd.getNumPartitions() == int(before)


def test_zone_digits_and_checking_sql_stay_as_they_were(spark, tables):
    def digit(text):
        return str(sum(max(ICAO_CHARACTERS.find(c), 0) * ICAO_WEIGHTS[i % 3] for i, c in enumerate(text)) % 10)

    rows = rel(spark, tables, "zone").collect()
    assert len(rows) == 120
    for r in rows:
        right = r.doc_id % 2 == 0
        assert r.number_digit == (digit(r.number9) if right else "0") and r.dob_digit == (digit(r.dob6) if right else "0")
        whole = r.number9 + r.number_digit + r.dob6 + r.dob_digit + "3001019<<<<<<<<<<<<<<<"
        assert r.line2[-1] == (digit(whole) if right else "0")
    assert all(check_digit_sql(t, n) in RELATIONS["zone"].duck for t, n in (("composite", 39), ("number9", 9), ("dob6", 6)))


def test_revalidation_builds_the_shown_fields_once(spark, tables):
    found = plan(REGISTRY["prj6_revalidation_keys"].run(spark, tables))
    assert found.count("map_from_entries(") == 1  # once for each look-up before
    assert "RepartitionByExpression" in found


def test_overall_validity_runs_the_checks_once(spark, tables):
    found = REGISTRY["agg10_overall_validity"].run(spark, tables)
    assert plan(found).count("mrz_check_digits") == 1  # an inferred filter held them all again
    assert "RepartitionByExpression" in plan(found)
    assert found.where("overall = 'pass'").count() > 0 and found.count() == found.select("doc_id").distinct().count()


def test_name_below_header_is_worked_out_once_and_dealt_out(spark, tables):
    found = REGISTRY["win7_name_below_header"].run(spark, tables)
    assert plan(found).count("BHARAT SARKAR") == 1  # the header words, once more in a pushed filter before
    assert "Repartition " in plan(found)
    assert found.where("name_below IS NULL").count() == 0 and found.count() > 0


def test_words_travel_as_runs_and_read_as_before(spark):
    from idlens.operators.assemble import assemble_text, word_runs

    rng, keys = random.Random(5), ["doc_id", "engine"]
    rows = [(d, e, seq, rng.choice(["a", "Bo", " c d ", "", " ", None, "x\ny", "é"]), rng.choice([0.0, 50.0, 81.5, None]), 0, seq // 7)
            for d in (1, 2, None) for e in ("tesseract", "paddleocr") for seq in range(40)]
    rows += [(3, "tesseract", s, "w", 0.0, None, None) for s in range(3)] + [(4, "paddleocr", None, "n", 1.0, 0, 0), (4, "paddleocr", 5, "m", 2.0, 0, 0)]
    rows += rows[:30]  # rows that come twice
    schema = "doc_id int, engine string, seq bigint, text string, confidence double, block_num int, line_num int"
    want = {}
    for d, e, seq, text, conf, _, line in rows:
        lines, stats = want.setdefault((d, e), ({}, []))
        word = (text or "").strip()
        if word and (e != "tesseract" or (conf or 0) > 0):
            lines.setdefault(seq if line is None else line, []).append((-1 if seq is None else seq, word))
            stats.append(conf)
    texts = {k: "\n".join(" ".join(w for _, w in sorted(x)) for _, x in sorted(lines.items(), key=lambda i: (min(s for s, _ in i[1]), i[0]))) for k, (lines, _) in want.items()}
    for mixed in (False, True):
        if mixed:
            rng.shuffle(rows)
        found = assemble_text(spark.createDataFrame(rows, schema).repartition(3) if mixed else spark.createDataFrame(rows, schema).coalesce(1), keys).collect()
        assert len(found) == len(want)
        assert {(r.doc_id, r.engine): (r.raw_text, r.text_blocks_count) for r in found} == {k: (texts[k], len(want[k][1])) for k in want}
    page = spark.range(5000, numPartitions=1).selectExpr("1 AS doc_id", "id AS seq", "'w' AS word", "1D AS confidence", "string(null) AS letters")
    assert word_runs(page, ["doc_id"]).count() <= 2  # 5,000 rows travelled before


def test_grid_join_does_not_shuffle_candidates_to_make_them_distinct(spark):
    from idlens.operators.boxes import exclude_overlaps_by_grid

    rows = [(i % 3, i, [10 * i, 0, 10 * i + 8, 8]) for i in range(30)] * 2 + [(0, 99, None), (None, 98, [0, 0, 5, 5])]
    boxes = spark.createDataFrame(rows, "doc_id int, seq int, bbox array<int>")
    photos = spark.createDataFrame([(0, [0, 0, 100, 100]), (0, [0, 0, 100, 100]), (1, [200, 0, 260, 50])], "doc_id int, bbox array<int>")
    found = exclude_overlaps_by_grid(boxes, photos, ["doc_id"])
    inside = {(0, i) for i in range(0, 10, 3)} | {(1, i) for i in range(20, 26) if i % 3 == 1}
    assert sorted((r.seq for r in found.collect())) == sorted(seq for d, seq, _ in rows if (d, seq) not in inside)
    assert plan(found).count("Aggregate [") == 2  # photos and hits; the candidates too before


def test_few_keywords_are_searched_where_the_texts_lie(spark):
    from idlens import rules
    from idlens.operators import classify

    texts = [(1, "the bank and Bank"), (1, "the bank and Bank"), (2, None), (3, ""), (4, "straße, UN"), (5, "x")]
    words = [("a", "Bank", 5), ("a", "bank", 5), (None, "AND", 1), ("b", "strasse", None), ("b", "", 9), ("b", None, 9), ("c", "un", 2)]
    df = spark.createDataFrame(texts, "id int, raw_text string")
    many = [("z", f"no such word {i}", 1) for i in range(classify.DIRECT)]
    found = [classify.keyword_hits(df, spark.createDataFrame(w, rules.KEYWORD_SCHEMA)) for w in (words, words + many)]
    rows = [sorted(f.collect(), key=str) for f in found]
    want = [(i, t, d, w.upper(), n) for i, t in texts for d, w, n in words if w and t and w.upper() in t.upper()]
    assert len(want) == 8 and rows[0] == rows[1] == sorted(rows[0], key=str) and sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows[0])
    assert found[0].columns == ["id", "raw_text", "doc_type", "keyword", "weight"]
    shuffles = [f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for f in found]
    assert shuffles[0] == 0 < shuffles[1]  # texts and their stretches were shuffled
    assert plan(found[0]).count("Contains(") == 5 or plan(found[0]).count("Contains") == 5  # each searched once
    assert classify.keyword_hits(df, spark.createDataFrame([], rules.KEYWORD_SCHEMA)).count() == 0


def test_zone_letters_are_looked_for_only_in_lines_that_can_hold_them(spark):
    from idlens.operators import mrz

    pieces = ["p", "V", "s", "ſ", "ẗ", "ß", "<", "1", "é", " ", "म", ".", "T", "P"]
    rng = random.Random(5)
    lines = ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(3000)]
    lines += ["a<" + "b" * 27, "a<" + "b" * 25, "Speed", "1. sp", "é p<", "-v.t", "xp<", "\tP 1", "plain prose", "ẗv<"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 4))) for _ in range(1500)] + lines + ["", None]

    def expected(text):
        if text is None:
            return None
        cleaned = [re.sub("[^A-Z0-9<]", "", x.strip(" \t\n\r\f\x0b").upper()) for x in text.split("\n")]
        found = [x for x in cleaned if len(x) >= 28 and "<" in x or re.match(mrz.LINE_STARTS, x)]
        if len(found) >= 2 or "<" not in text:
            return found
        runs = [re.sub("[^A-Z0-9<]", "", x) for x in re.findall(mrz.RUN_PATTERN, text.upper())]
        return list(dict.fromkeys(found + [x for x in runs if "<" in x and len(x) >= 30]))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    found = df.select("i", mrz.candidate_lines(F.col("raw_text")).alias("c"))
    # a text with no such line is not reduced line by line
    assert "\\u017f" in plan(found) and mrz.START_GUARD in plan(found)
    assert {r.i: r.c for r in found.collect()} == {i: expected(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("name, guard", [("passport", "LOOSE_DATE_GUARD"), ("licence", "DATE_GUARD"), ("aadhaar", "DATE_GUARD")])
def test_a_guard_reads_each_text_once(spark, name, guard):
    from idlens.operators import extract

    df = spark.createDataFrame([("x",)], "raw_text string")
    out = {"passport": extract.extract_passport, "licence": extract.extract_licence, "aadhaar": extract.extract_aadhaar}[name](df)
    whole = re.findall(rf"RLIKE\(raw_text#\d+, {re.escape(getattr(extract, guard))}\)", plan(out.select(name)))
    assert len(whole) == 1


def test_a_birth_date_in_parts_is_told_from_a_whole_one(spark):
    from idlens.operators.extract import extract_passport

    texts = {"born 05\n1990": ("05/01/1990", True), "DOB: 01/02/1991\n05\n1990": ("01/02/1991", False), "no date": (None, False),
             "x 03-04-1992 y": ("03/04/1992", False), "A1234567": (None, False), "5 \n\n 1990": (None, False), None: (None, False)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    got = {r.i: (r.dob, r.dob_partial) for r in extract_passport(df).select("i", "passport.dob", "passport.dob_partial").collect()}
    assert got == dict(enumerate(texts.values()))
