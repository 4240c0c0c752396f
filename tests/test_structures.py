"""Lines from boxes, grid join, sketches, VARIANT and table functions on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from idlens.functions.sql import register_sql_functions
from idlens.operators import history as H
from idlens.operators.assemble import assemble_text
from idlens.operators.boxes import exclude_overlaps_by_grid, islands, lines_from_boxes
from idlens.operators.layout import exclude_overlaps
from idlens.operators.sketches import estimates, rolled_up, sketches


@pytest.mark.parametrize("parts", [1, 6])
def test_islands_are_the_plain_rule_with_a_hot_key(spark, parts):
    rng = random.Random(4)
    rows = [(0 if i % 3 else rng.randrange(5), i, float(a := rng.randrange(4000)), float(a + rng.randrange(6))) for i in range(1500)]
    rows += rows[:40]  # equal intervals
    got = islands(spark.createDataFrame(rows, "k int, i int, a double, b double").repartition(4), ["k"], "a", "b", "n", 2.0, parts).collect()
    want = {}
    for k in {r[0] for r in rows}:
        end, n = None, -1
        for _, i, a, b in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3])):
            n += end is None or a > end + 2
            end = b if end is None else max(end, b)
            want[i] = n
    assert len(got) == len(rows) and all(want[r.i] == r.n for r in got)


BLOCKS = "doc_id bigint, page_number int, engine string, text string, bbox array<int>, confidence double"


def page(spark, rows):
    return spark.createDataFrame([(d, 1, "easyocr", t, b, 90.0) for d, t, b in rows], BLOCKS).repartition(3)


def read(spark, rows, **how):
    keys = ["doc_id", "page_number", "engine"]
    return {r.doc_id: r.raw_text for r in assemble_text(lines_from_boxes(page(spark, rows), keys, **how), keys).collect()}


def test_slanted_lines_two_columns_and_reading_order(spark):
    left = [(1, w, [10 + 60 * i, 100 + 3 * i, 60 + 60 * i, 124 + 3 * i]) for i, w in enumerate(("Name:", "Asha", "Rao"))]  # rises word by word
    left += [(1, w, [10 + 60 * i, 128 + 3 * i, 60 + 60 * i, 150 + 3 * i]) for i, w in enumerate(("DOB", "01/01/1990"))]
    right = [(1, "GOVERNMENT", [400, 90, 520, 112]), (1, "OF", [530, 92, 550, 114]), (1, "INDIA", [560, 91, 620, 113]), (1, "अशा", [400, 130, 450, 150])]
    rows = left + right + [(2, "one", [0, 0, 9, 9]), (3, "no box", None), (3, "first", [5, 5, 9, 9]), (4, "", [0, 0, 5, 5])]
    random.Random(1).shuffle(rows)
    got = read(spark, rows)
    assert got == {1: "Name: Asha Rao\nDOB 01/01/1990\nGOVERNMENT OF INDIA\nअशा", 2: "one", 3: "first\nno box", 4: ""}
    assert read(spark, rows, gap=1000.0)[1].startswith("Name: Asha Rao GOVERNMENT OF INDIA\n")  # one column
    assert read(spark, []) == {}


def test_a_page_with_a_third_of_all_boxes(spark):
    rows = [(1, f"w{n}", [50 * (n % 10), 20 * (n // 10), 50 * (n % 10) + 45, 20 * (n // 10) + 14]) for n in range(900)]
    rows += [(2 + n, "x", [0, 0, 5, 5]) for n in range(100)]
    got = read(spark, rows, parts=7)
    assert got[1] == "\n".join(" ".join(f"w{10 * i + j}" for j in range(10)) for i in range(90)) and len(got) == 101


def test_grid_join_equals_the_array_of_photos(spark):
    rng = random.Random(6)
    box = lambda size: [x := rng.randrange(-200, 3000), y := rng.randrange(-200, 3000), x + rng.randrange(-3, size), y + rng.randrange(-3, size)]
    boxes = [(0 if i % 3 else rng.randrange(1, 20), i, box(rng.choice([30, 300, 3000]))) for i in range(900)] + [(0, 5000, None), (0, 900, [0, 0, 10, 10])]
    photos = [(rng.randrange(0, 22), box(rng.choice([20, 200, 2500]))) for _ in range(80)] + [(0, None), (0, [0, 0, 10, 10]), (0, [0, 0, 10, 10])]
    b = spark.createDataFrame(boxes, "doc_id int, i int, bbox array<int>")
    p = spark.createDataFrame(photos, "doc_id int, bbox array<int>")
    kept = lambda f: sorted(r.i for r in f(b, p, ["doc_id"]).collect())
    assert kept(exclude_overlaps_by_grid) == kept(exclude_overlaps) and 900 not in kept(exclude_overlaps_by_grid)
    assert exclude_overlaps_by_grid(b, p.limit(0), ["doc_id"]).count() == len(boxes)


def test_sketches_merge_to_what_the_rows_give(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=rng.randrange(2880)), "a", rng.randrange(5000), rng.random() * 100) for _ in range(20_000)]
    rows += [(start, "b", None, None), (start, "b", 7, 3.0)]
    h = spark.createDataFrame(rows, "timestamp timestamp, document_type string, holder int, risk_score double")
    got = {(r.start.day, r.document_type): r for r in estimates(rolled_up(sketches(h))).collect()}
    for day in (1, 2):
        some = [r for r in rows if r[1] == "a" and r[0].day == day]
        found, values = got[day, "a"], sorted(r[3] for r in some)
        assert found.n_scans == len(some)
        assert abs(found.n_holders / len({r[2] for r in some}) - 1) < 0.05
        assert abs(sum(v <= found.risk_q50 for v in values) / len(values) - 0.5) < 0.02
        assert abs(sum(v <= found.risk_q90 for v in values) / len(values) - 0.9) < 0.02
    assert (got[1, "b"].n_scans, got[1, "b"].n_holders, got[1, "b"].risk_q50) == (2, 1, 3.0)
    assert sketches(h.limit(0)).count() == 0


def test_variant_keeps_unknown_keys_and_broken_text_is_null(spark):
    rows = [(1, '{"new":{"a":[1,"x"]},"riskLevel":"LOW"}'), (2, '{"broken'), (3, None), (4, "[1,2]")]
    v = H.as_variant(spark.createDataFrame(rows, "id int, result string"))
    got = {r.id: (r.level, r.x, r.back) for r in v.select(
        "id", H.at_path("result", "$.riskLevel").alias("level"), H.at_path("result", "$.new.a[1]").alias("x"), F.to_json("result").alias("back")).collect()}
    assert got == {1: ("LOW", "x", '{"new":{"a":[1,"x"]},"riskLevel":"LOW"}'), 2: (None, None, None), 3: (None, None, None), 4: (None, None, "[1,2]")}
    schema = H.variant_schema(v.where("id < 3")).first().schema
    assert "riskLevel" in schema and "new" in schema


def test_table_functions_in_lateral_use(spark):
    register_sql_functions(spark)
    docs = spark.createDataFrame([(1, " a \n\nb\t\n"), (2, ""), (3, None)], "id int, text string")
    got = spark.sql("SELECT d.id, l.line_no, l.line FROM {d} d, LATERAL kyc_lines(d.text) l ORDER BY 1, 2", d=docs).collect()
    assert [tuple(r) for r in got] == [(1, 1, "a"), (1, 2, "b")]
    fields = spark.sql("SELECT * FROM kyc_fields(map_entries(map('name', 'A', 'dob', '', 'sex', cast(null as string))))").collect()
    assert [tuple(r) for r in fields] == [("name", "A")]
    zone = spark.sql("SELECT field, value, digit FROM kyc_zone_fields('A1234567<5IND9001019M3001019<<<<<<<<<<<<<<<0')").collect()
    assert [tuple(r) for r in zone] == [("number", "A1234567", "5"), ("birth", "900101", "9"), ("expiry", "300101", "9"), ("optional", "", "<")]


def plain_lines(rows, gap=40.0):
    """(page, i) -> (column, line, word), one page after another, from the rule alone."""
    got = {}

    def cut(some, low, high, wide):
        out, end = [], None
        for r in sorted(some, key=lambda r: (low(r), high(r))):
            if end is None or low(r) > end + wide:
                out.append([])
            out[-1].append(r)
            end = high(r) if len(out[-1]) == 1 else max(end, high(r))
        return out

    def middle(r):
        y1, y2 = sorted((r[2][1], r[2][3]))
        return y1 + (y2 - y1) / 4, y2 - (y2 - y1) / 4

    for d in {r[0] for r in rows}:
        for c, column in enumerate(cut([r for r in rows if r[0] == d], lambda r: min(r[2][0], r[2][2]), lambda r: max(r[2][0], r[2][2]), gap)):
            for n, line in enumerate(cut(column, lambda r: middle(r)[0], lambda r: middle(r)[1], 0)):
                for w, r in enumerate(sorted(line, key=lambda r: (min(r[2][0], r[2][2]), middle(r)[0]))):
                    got[r[1]] = (c, n, w + 1)
    return got


@pytest.mark.parametrize("batch, stretch, mixed", [(10000, 100000, False), (23, 50, False), (23, 50, True), (23, 400, False)])
def test_boxes_are_packed_where_they_lie_and_numbered_as_by_the_rule(spark, batch, stretch, mixed):
    rng = random.Random(9)
    rows = []
    for i in range(900):  # a hot page, columns apart and lines that touch
        x, y = rng.choice([0, 700, 1500]) + rng.random() * 300, rng.randrange(40) * 30 + rng.random() * 20
        rows.append((0 if i % 3 == 0 else 1 + i // 90, i, [x, y, x + rng.uniform(-30, 30), y + rng.uniform(-15, 15)]))
    rows.sort(key=lambda r: r[0])
    if mixed:
        rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "p int, i int, bbox array<double>")
        found = lines_from_boxes(df.repartition(5) if mixed else df.coalesce(1), ["p"], parts=3, stretch=stretch)
        got = {r.i: (r.block_num, r.line_num, r.seq % (1 << 21)) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_lines(rows) and len(got) == 900
    assert found.columns == ["p", "i", "bbox", "block_num", "line_num", "seq"]


def test_pages_of_one_stretch_are_not_shuffled_for_their_lines(spark):
    from idlens.operators.boxes import line_units

    rows = [(d, f"w{i}", [50 * (i % 10), 20 * (i // 10), 50 * (i % 10) + 45, 20 * (i // 10) + 14]) for d in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "d int, text string, bbox array<int>").coalesce(1)
    found = lines_from_boxes(df, ["d"], boxes=False)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()  # each box was shuffled for columns, lines and places
    assert found.count() == 600 and found.columns == ["d", "text", "block_num", "line_num", "seq"]
    marked = df.selectExpr("*", *[f"double(bbox[{i}]) AS {n}" for i, n in enumerate(("_left", "_top", "_right", "_bottom"))], "0L AS _tie")
    assert line_units(marked, ["d"], 40.0).count() == 60  # a row a line
