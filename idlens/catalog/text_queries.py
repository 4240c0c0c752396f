"""Registered queries: scalar functions, checksums, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from idlens import rules
from idlens.catalog.registry import joined, lines_sql, name_letters_sql, q, register, rel, strip_sql
from idlens.functions import numbers as N
from idlens.functions import text as T
from idlens.functions.checksums import PERMUTATION, PRODUCT, verhoeff_valid
from idlens.operators.assemble import combined_text
from idlens.operators.classify import best_class, class_scores, keyword_scores
from idlens.operators.crosscheck import parse_qr
from idlens.operators.extract import vehicle_classes
from idlens.operators.mrz import candidate_lines, mrz_of, ordered_lines, repaired, two_longest
from idlens.catalog.inputs import check_digit_sql


# --- classifier ------------------------------------------------------------------------


def class_points_sql(rule: rules.ClassRule, text: str = "t") -> str:
    parts = [f"CASE WHEN contains({text}, '{q(k)}') THEN {rule.keyword_points} ELSE 0 END" for k in rule.keywords]
    for bonus in rule.bonuses:
        tests = [f"contains({text}, '{q(x)}')" for x in bonus.literals]
        tests += [f"regexp_matches({text}, '{q(x)}')" for x in bonus.patterns]
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN {bonus.points} ELSE 0 END")
    return "cast(" + " + ".join(parts) + " AS INT)"


SCORED_SQL = """scored AS (SELECT doc_id, {points} FROM (
  SELECT doc_id, upper(concat({text}, ' ', {payload})) AS t FROM {source}) AS x)"""
TYPED_SQL = """typed AS (SELECT doc_id, best,
  CASE WHEN best = 0 THEN 'unknown' WHEN score_aadhaar = best THEN 'aadhaar' WHEN score_passport = best THEN 'passport'
       WHEN score_visa = best THEN 'visa' ELSE 'driving_licence' END AS document_type,
  CASE WHEN best = 0 THEN 'Unknown Document' WHEN score_aadhaar = best THEN 'Aadhaar Card' WHEN score_passport = best THEN 'Indian Passport'
       WHEN score_visa = best THEN 'Indian Visa' ELSE 'Driving Licence' END AS document_name,
  CASE WHEN best = 0 THEN 0::DOUBLE WHEN best > 60 THEN greatest(85::DOUBLE, pct) ELSE pct END AS confidence
  FROM (SELECT *, least(99::DOUBLE, round_even(best / 150::DOUBLE * 100::DOUBLE, 2)) AS pct FROM (
    SELECT *, greatest(score_aadhaar, score_passport, score_visa, score_driving_licence) AS best FROM scored) AS y) AS z)"""


def scored_sql(source: str = "corpus", text: str = "raw_text", payload: str = "payload") -> str:
    points = ", ".join(f"{class_points_sql(r)} AS score_{r.doc_type}" for r in rules.CLASS_RULES)
    return SCORED_SQL.format(points=points, text=text, payload=payload, source=source)


def typed_sql(source: str = "corpus", text: str = "raw_text", payload: str = "payload") -> str:
    return scored_sql(source, text, payload) + ",\n" + TYPED_SQL


@register("agg5_class_scores", "WITH " + scored_sql() + " SELECT * FROM scored", ("corpus",))
def _(spark, sf):
    return class_scores(rel(spark, sf, "corpus"), "raw_text", "payload").drop("raw_text", "payload")


@register("win1_best_class", "WITH " + typed_sql() + " SELECT doc_id, document_type, document_name FROM typed", ("corpus",))
def _(spark, sf):
    scored = class_scores(rel(spark, sf, "corpus"), "raw_text", "payload")
    return best_class(scored).select("doc_id", "document_type", "document_name")


@register("mth3_class_confidence", "WITH " + typed_sql() + """
SELECT confidence, count(*) AS n_docs FROM typed GROUP BY confidence""", ("corpus",))
def _(spark, sf):
    scored = class_scores(rel(spark, sf, "corpus"), "raw_text", "payload")
    return best_class(scored).groupBy("confidence").agg(F.count(F.lit(1)).alias("n_docs"))


@register("agg5_class_counts", "WITH " + typed_sql() + """
SELECT document_type, count(*) AS n_docs, round_even(avg(confidence), 4) AS mean_confidence FROM typed GROUP BY document_type""", ("corpus",))
def class_counts(spark, sf):
    scored = class_scores(rel(spark, sf, "corpus"), "raw_text", "payload")
    return best_class(scored).groupBy("document_type").agg(
        F.count(F.lit(1)).alias("n_docs"), N.round_even(F.avg("confidence"), 4).alias("mean_confidence"))


_USER_WORDS = [("finance", "BANK", 5), ("finance", "ACCOUNT", 7), ("people", "AND", 1), ("people", "UN", 2)]


def _keywords_sql() -> str:
    rows = [(r.doc_type, k, r.keyword_points) for r in rules.CLASS_RULES for k in r.keywords] + _USER_WORDS
    return "kw(doc_type, keyword, weight) AS (VALUES " + ", ".join(f"('{t}', '{q(k)}', {w})" for t, k, w in rows) + ")"


@register("jn1_keyword_join", f"""WITH {_keywords_sql()}
SELECT doc_id, doc_type, cast(sum(weight) AS BIGINT) AS score, count(*) AS n_hits
FROM corpus JOIN kw ON contains(upper(raw_text), keyword) GROUP BY doc_id, doc_type""", ("corpus",))
def _(spark, sf):
    words = rules.keyword_frame(spark).unionByName(spark.createDataFrame(_USER_WORDS, rules.KEYWORD_SCHEMA))
    return keyword_scores(rel(spark, sf, "corpus"), words, ["doc_id"])


@register("udf2_rule_tables", f"""WITH {_keywords_sql()}
SELECT doc_type, cast(sum(weight) AS BIGINT) AS points, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs
FROM documents JOIN kw ON contains(upper(text), keyword) GROUP BY doc_type""")
def _(spark, sf):
    from idlens.session import scratch_path

    path = scratch_path(spark, "keyword-rules")
    spark.createDataFrame(_USER_WORDS, rules.KEYWORD_SCHEMA).write.json(path)
    hits = keyword_scores(rel(spark, sf, "documents"), rules.read_keyword_rules(spark, path), ["doc_id"], "text")
    return hits.groupBy("doc_type").agg(
        F.sum("score").alias("points"), F.sum("n_hits").alias("n_hits"), F.count(F.lit(1)).alias("n_docs"))


@register("prj2_combined_text", """
SELECT doc_id, concat_ws(chr(10), raw_text, coalesce(payload, ''), file_name) AS combined FROM kyc""", ("kyc",))
def _(spark, sf):
    return rel(spark, sf, "kyc").select(
        "doc_id", combined_text(F.col("raw_text"), F.col("payload"), F.col("file_name")).alias("combined"))


# --- text functions -----------------------------------------------------------------------


@register("txt1_lines", f"""
SELECT doc_id, len({lines_sql('raw_text')}) AS n_lines, array_to_string({lines_sql('raw_text')}, '|') AS lines FROM corpus""", ("corpus",))
def _(spark, sf):
    return rel(spark, sf, "corpus").select("doc_id", T.text_lines(F.col("raw_text")).alias("l")).select(
        "doc_id", F.size("l").cast("bigint").alias("n_lines"), joined(F.col("l")).alias("lines"))


_FORBIDDEN = "|".join(rules.NAME_FORBIDDEN)
NAME_OK_SQL = f"length(c) BETWEEN 3 AND 35 AND len(string_split(c, ' ')) <= 4 AND NOT regexp_matches(upper(c), '{_FORBIDDEN}')"


@register("txt2_name_test", f"""
SELECT doc_id, line_num, c AS cleaned, {NAME_OK_SQL} AS is_name FROM (
  SELECT doc_id, cast(seq AS BIGINT) AS line_num, {name_letters_sql('text')} AS c FROM line_blocks) AS x""", ("line_blocks",))
def _(spark, sf):
    return rel(spark, sf, "line_blocks").select(
        "doc_id", F.col("seq").alias("line_num"), T.name_letters(F.col("text")).alias("cleaned")).withColumn(
        "is_name", T.looks_like_name(F.col("cleaned")))


@register("txt3_date_separators", """
SELECT doc_id, translate(replace(dob, '/', CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '.' END), '-.', '//') AS dob FROM base""", ("base",))
def _(spark, sf):
    loose = F.translate("dob", "/", "-")
    return rel(spark, sf, "base").select("doc_id", T.slash_dates(
        F.when(F.col("doc_id") % 2 == 0, loose).otherwise(F.translate("dob", "/", "."))).alias("dob"))


@register("txt4_identifier_cleanup", """
SELECT doc_id, upper(regexp_replace(id_number, '[-\\s]', '', 'g')) AS id_number FROM claims""", ("claims",))
def _(spark, sf):
    return rel(spark, sf, "claims").select("doc_id", T.clean_identifier(F.col("id_number")).alias("id_number"))


@register("txt5_title_labels", """
SELECT doc_type, array_to_string(list_transform(string_split(doc_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, count(*) AS n
FROM checklist GROUP BY doc_type""", ("checklist",))
def _(spark, sf):
    return rel(spark, sf, "checklist").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")).select(
        "doc_type", T.title_label(F.col("doc_type")).alias("label"), "n")


@register("txt6_file_names", """
SELECT seq, concat_ws('_', regexp_replace(lower(file_name), '[^a-z0-9_]', '_', 'g'), lower(side)) AS stored,
  concat_ws('_', CASE WHEN seq % 2 = 0 THEN regexp_replace(file_name, '[^a-z0-9_]', '_', 'g') ELSE lower(doc_type) END, lower(side)) AS base_name,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(concat('_', file_name, '?'), '[^a-zA-Z0-9_\\-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), ''), file_name) AS review_name
FROM captures""", ("captures",))
def _(spark, sf):
    custom = F.when(F.col("seq") % 2 == 0, F.col("file_name"))
    return rel(spark, sf, "captures").select(
        "seq", F.concat_ws("_", T.safe_token(F.col("file_name")), T.safe_token(F.col("side"))).alias("stored"),
        T.base_name(F.col("doc_type"), F.col("side"), custom).alias("base_name"),
        T.safe_review_name(F.concat(F.lit("_"), F.col("file_name"), F.lit("?"))).alias("review_name"))


@register("txt7_mrz_padding", """
SELECT doc_id, rpad(upper(nm), 44, '<') AS padded, rpad(raw_text, 44, '<') AS cut FROM kyc""", ("kyc",))
def _(spark, sf):
    return rel(spark, sf, "kyc").select(
        "doc_id", T.pad_mrz(F.upper("nm")).alias("padded"), T.pad_mrz(F.col("raw_text")).alias("cut"))


@register("txt8_mutual_substring", """
SELECT c.doc_id, contains(lower(trim(c.name)), lower(r.name)) OR contains(lower(r.name), lower(trim(c.name))) AS same_name
FROM claims c JOIN registry r ON upper(regexp_replace(c.id_number, '[-\\s]', '', 'g')) = upper(regexp_replace(r.id_number, '[-\\s]', '', 'g')) AND c.doc_type = r.doc_type""",
          ("claims", "registry"))
def _(spark, sf):
    c = rel(spark, sf, "claims").select("doc_id", "doc_type", T.clean_identifier(F.col("id_number")).alias("i"), "name")
    r = rel(spark, sf, "registry").select("doc_type", T.clean_identifier(F.col("id_number")).alias("i"), F.col("name").alias("r"))
    return c.join(r, ["doc_type", "i"]).select("doc_id", T.mutually_contained(
        F.lower(T.strip(F.col("name"))), F.lower(F.col("r"))).alias("same_name"))


def _qr_sql(key: str) -> str:
    return f"""nullif({strip_sql(f"regexp_extract(payload, '(?i){key}=" + '"([^"]+)"' + "', 1)")}, '')"""


@register("txt9_qr_attributes", f"""
SELECT doc_id, {', '.join(f'{_qr_sql(k)} AS {k}' for k in rules.QR_ATTRIBUTES)},
  CASE WHEN {' AND '.join(f'{_qr_sql(k)} IS NULL' for k in rules.QR_ATTRIBUTES)} THEN payload END AS raw_payload
FROM kyc WHERE payload IS NOT NULL""", ("kyc",))
def _(spark, sf):
    parsed = parse_qr(rel(spark, sf, "kyc").where("payload is not null"))
    return parsed.select("doc_id", *[
        F.try_element_at("parsed_qr_fields", F.lit(k)).alias(k) for k in (*rules.QR_ATTRIBUTES, "raw_payload")])


# --- dates, numbers, checksums -----------------------------------------------------------------


def mrz_date_sql(x: str, expiry: bool = False) -> str:
    yy = f"try_cast(substr({x}, 1, 2) AS INT)"
    year = f"CASE WHEN {yy} < 80 THEN {yy} + 2000 ELSE {yy} + 1900 END" if expiry else \
        f"CASE WHEN {yy} > 25 THEN {yy} + 1900 ELSE {yy} + 2000 END"
    return (f"CASE WHEN regexp_matches({x}, '^[0-9]{{6}}$') THEN concat_ws('/', substr({x}, 5, 2), substr({x}, 3, 2), "
            f"cast({year} AS VARCHAR)) ELSE {x} END")


@register("dat1_mrz_dates", f"""
SELECT o_orderkey, {mrz_date_sql('d')} AS born, {mrz_date_sql('d', True)} AS expires FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'AB12' ELSE lpad(cast((o_orderkey * 7) % 100 AS VARCHAR), 2, '0') || strftime(o_orderdate, '%m%d') END AS d FROM orders) AS x""")
def _(spark, sf):
    d = F.when(F.col("o_orderkey") % 13 == 0, "AB12").otherwise(F.concat(
        F.lpad(((F.col("o_orderkey") * 7) % 100).cast("string"), 2, "0"), F.date_format("o_orderdate", "MMdd")))
    return rel(spark, sf, "orders").select("o_orderkey", d.alias("d")).select(
        "o_orderkey", N.mrz_date(F.col("d")).alias("born"), N.mrz_date(F.col("d"), True).alias("expires"))


@register("dat2_expiry_age", """
SELECT doc_id, try_strptime(date_of_expiry, '%d/%m/%Y')::DATE >= DATE '2025-06-30' AS valid,
  cast(CASE WHEN d IS NOT NULL THEN date_part('year', DATE '2025-06-30') - date_part('year', d)
    - CASE WHEN strftime(d, '%m%d') > '0630' THEN 1 ELSE 0 END END AS INT) AS age
FROM (SELECT *, try_strptime(dob, '%d/%m/%Y')::DATE AS d FROM field_wide) AS x""", ("field_wide",))
def _(spark, sf):
    as_of = F.lit("2025-06-30").cast("date")
    return rel(spark, sf, "field_wide").select(
        "doc_id", N.not_expired(F.col("date_of_expiry"), as_of).alias("valid"), N.age_years(F.col("dob"), as_of).alias("age"))


@register("dat3_epoch_millis", "SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def _(spark, sf):
    return rel(spark, sf, "events").select("event_id", N.epoch_millis(F.col("ts")).alias("millis"))


def verhoeff_sql(digits: str) -> str:
    state = "0"
    for i in range(12):
        digit = f"cast(substr({digits}, {12 - i}, 1) AS INT)"
        state = f"({PRODUCT})[{state} * 10 + ({PERMUTATION[i % 8]})[{digit} + 1] + 1]"
    return f"({state} = 0)"


@register("mth1_verhoeff", f"""
SELECT doc_id, uid, {verhoeff_sql('uid')} AS valid FROM base""", ("base",))
def _(spark, sf):
    return rel(spark, sf, "base").select("doc_id", "uid", verhoeff_valid(F.col("uid")).alias("valid"))


def zone_checks_sql(line2: str = "line2") -> str:
    def part(a: int, b: int) -> str:
        return f"substr({line2}, {a + 1}, {b - a})"

    comp = f"concat({part(0, 10)}, {part(13, 20)}, {part(21, 43)})"
    opt = f"({check_digit_sql(part(28, 42), 14)} = {part(42, 43)} OR ({part(42, 43)} = '<' AND replace({part(28, 42)}, '<', '') = ''))"
    return (f"{check_digit_sql(part(0, 9), 9)} = {part(9, 10)} AS number_ok, {check_digit_sql(part(13, 19), 6)} = {part(19, 20)} AS dob_ok, "
            f"{check_digit_sql(part(21, 27), 6)} = {part(27, 28)} AS expiry_ok, {opt} AS optional_ok, "
            f"{check_digit_sql(comp, 39)} = {part(43, 44)} AS composite_ok")


@register("mth2_icao_digits", f"""
SELECT doc_id, {zone_checks_sql('l2')} FROM (SELECT doc_id, rpad(line2, 44, '<') AS l2 FROM zone) AS x""", ("zone",))
def _(spark, sf):
    from idlens.operators.mrz import mrz_struct

    zone = rel(spark, sf, "zone").select("doc_id", mrz_struct(
        T.pad_mrz(F.col("line1")), T.pad_mrz(F.col("line2"))).alias("z"))
    return zone.select("doc_id", *[f"z.{c}" for c in ("number_ok", "dob_ok", "expiry_ok", "optional_ok", "composite_ok")])


@register("mth4_clamped_scores", """
SELECT event_id, round_even(least(100::DOUBLE, greatest(0::DOUBLE, floor(value * 4::DOUBLE) / 4::DOUBLE - 20)), 1) AS score FROM events""")
def _(spark, sf):
    return rel(spark, sf, "events").select("event_id", N.clamp_percent(F.floor(F.col("value") * 4) / 4 - 20, 1).alias("score"))


@register("mth5_quality", """
SELECT event_id, cast(CASE WHEN floor(((event_id % 101) / 100::DOUBLE) * 100 + 0.5::DOUBLE) = 0 THEN 98
  ELSE floor(((event_id % 101) / 100::DOUBLE) * 100 + 0.5::DOUBLE) END AS INT) AS quality FROM events""")
def _(spark, sf):
    return rel(spark, sf, "events").select(
        "event_id", N.quality_score((F.col("event_id") % 101) / F.lit(100.0)).alias("quality"))


_CODES = "[" + ", ".join(f"'{c}'" for c in rules.VEHICLE_CLASSES) + "]"


@register("arr1_vehicle_classes", f"""
SELECT doc_id, CASE WHEN len(f) > 0 THEN array_to_string(f, ',') END AS classes FROM (
  SELECT doc_id, list_filter({_CODES}, lambda c: contains(upper(raw_text), c)) AS f FROM corpus) AS x""", ("corpus",))
def _(spark, sf):
    return rel(spark, sf, "corpus").select(
        "doc_id", joined(vehicle_classes(F.col("raw_text")), ",").alias("classes"))


# --- machine-readable zones -----------------------------------------------------------------------

MRZ_SQL = f"""mrz_a AS (SELECT doc_id, raw_text, list_filter(list_transform({lines_sql('raw_text')}, lambda l: regexp_replace(upper(l), '[^A-Z0-9<]', '', 'g')),
    lambda l: (length(l) >= 28 AND contains(l, '<')) OR regexp_matches(l, '^(?:P<|V<|VT|SP|P1|P2)')) AS lines,
  list_filter(list_transform(regexp_extract_all(upper(raw_text), '[P|VA-Z0-9<]{{30,44}}'), lambda l: regexp_replace(l, '[^A-Z0-9<]', '', 'g')),
    lambda l: contains(l, '<') AND length(l) >= 30) AS runs FROM kyc),
mrz_b AS (SELECT doc_id, raw_text, CASE WHEN len(lines) < 2 THEN list_concat(lines, list_filter(runs, lambda r, i: NOT list_contains(lines, r) AND list_position(runs, r) = i)) ELSE lines END AS cand FROM mrz_a),
mrz_c AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, i) AS rn FROM (
  SELECT doc_id, cand[i] AS line, i FROM (SELECT doc_id, cand, unnest(range(1, len(cand) + 1)) AS i FROM mrz_b WHERE len(cand) >= 2) AS u) AS v),
mrz_d AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN line END) AS a, max(CASE WHEN rn = 2 THEN line END) AS b FROM mrz_c WHERE rn <= 2 GROUP BY doc_id),
mrz_e AS (SELECT doc_id, CASE WHEN contains(b, '<') AND NOT contains(a, '<') THEN b ELSE a END AS a, CASE WHEN contains(b, '<') AND NOT contains(a, '<') THEN a ELSE b END AS b FROM mrz_d),
mrz_f AS (SELECT doc_id, CASE WHEN regexp_matches(b, '^[PV]<') AND NOT regexp_matches(a, '^[PV]<') THEN b ELSE a END AS a,
  CASE WHEN regexp_matches(b, '^[PV]<') AND NOT regexp_matches(a, '^[PV]<') THEN a ELSE b END AS b FROM mrz_e),
mrz_g AS (SELECT f.doc_id, a AS line_a, b AS line_b, regexp_matches(b, '^[0-9]{{6,8}}<') AS broken,
  coalesce(nullif(regexp_extract(raw_text, '\\b([A-Z])' || substr(b, 1, 7), 1), ''), upper(nullif(regexp_extract(raw_text, '\\b([A-PR-WYa-pr-wy])[0-9]{{7}}\\b', 1), '')), '') AS letter
  FROM mrz_f f JOIN kyc k ON f.doc_id = k.doc_id),
mrz_h AS (SELECT doc_id, rpad(line_a, 44, '<') AS line1, rpad(CASE WHEN broken THEN letter || line_b ELSE line_b END, 44, '<') AS line2, broken, letter FROM mrz_g),
mrz_i AS (SELECT doc_id, line1, line2, replace(substr(line1, 1, 2), '<', '') AS zone_type, replace(substr(line1, 3, 3), '<', '') AS country,
  {strip_sql("replace(string_split(substr(line1, 6, 39), '<<')[1], '<', ' ')")} AS surname,
  {strip_sql("replace(coalesce(string_split(substr(line1, 6, 39), '<<')[2], ''), '<', ' ')")} AS given_name,
  replace(substr(line2, 1, 9), '<', '') AS passport_number, replace(substr(line2, 11, 3), '<', '') AS nationality,
  {mrz_date_sql('substr(line2, 14, 6)')} AS dob, CASE WHEN substr(line2, 21, 1) IN ('M', 'F') THEN substr(line2, 21, 1) ELSE '' END AS sex,
  {mrz_date_sql('substr(line2, 22, 6)', True)} AS expiry_date, {zone_checks_sql('line2')} FROM mrz_h),
mrz AS (SELECT *, number_ok AND dob_ok AND expiry_ok AND optional_ok AND composite_ok AS strict FROM mrz_i)"""

_ZONE_COLUMNS = ("country", "surname", "given_name", "passport_number", "nationality", "dob", "sex", "expiry_date",
                 "number_ok", "dob_ok", "expiry_ok", "optional_ok", "composite_ok")


def over_corpus(sql: str) -> str:
    """The same SQL over identity texts and prose."""
    return sql.replace("kyc", "corpus")


@register("ext5_mrz_blocks", over_corpus(f"""WITH {MRZ_SQL}
SELECT doc_id, line1, line2, zone_type, {', '.join(_ZONE_COLUMNS)}, strict AS checksum_strict FROM mrz"""), ("corpus",))
def _(spark, sf):
    z = rel(spark, sf, "corpus").select("doc_id", mrz_of(F.col("raw_text")).alias("z")).where("z is not null")
    return z.select(
        "doc_id", F.col("z.mrz_raw")[0].alias("line1"), F.col("z.mrz_raw")[1].alias("line2"),
        F.col("z.document_type").alias("zone_type"), *[f"z.{c}" for c in _ZONE_COLUMNS],
        F.col("z.mrz_checksum_valid").alias("checksum_strict"))


@register("win3_two_longest_lines", over_corpus(f"""WITH {MRZ_SQL}
SELECT doc_id, a AS longest, b AS second FROM mrz_d"""), ("corpus",))
def _(spark, sf):
    two = rel(spark, sf, "corpus").select("doc_id", two_longest(candidate_lines(F.col("raw_text"))).alias("t"))
    return two.where(F.size("t") == 2).select("doc_id", F.col("t")[0].alias("longest"), F.col("t")[1].alias("second"))


_LONGEST = f"""SELECT doc_id, line, rn FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, i) AS rn FROM (
  SELECT doc_id, l[i] AS line, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {lines_sql('raw_text')} AS l FROM corpus) AS a) AS b) AS c) AS d WHERE rn <= 2"""


@register("srt4_longest_strings", _LONGEST, ("corpus",))
def _(spark, sf):
    two = rel(spark, sf, "corpus").select("doc_id", two_longest(T.text_lines(F.col("raw_text"))).alias("t"))
    return two.select("doc_id", F.posexplode("t").alias("p", "line")).select(
        "doc_id", "line", (F.col("p") + 1).cast("bigint").alias("rn"))


@register("jn15_mrz_repair", f"""WITH {MRZ_SQL}
SELECT doc_id, letter, line2 FROM mrz_h WHERE broken""", ("kyc",))
def _(spark, sf):
    pairs = rel(spark, sf, "kyc").select("doc_id", "raw_text", ordered_lines(F.col("raw_text")).alias("p"))
    read = pairs.where(F.size("p") == 2).select("doc_id", "raw_text", F.col("p")[1].alias("read"))
    fixed = read.where(F.col("read").rlike("^[0-9]{6,8}<")).withColumn(
        "fixed", repaired(F.col("read"), F.col("raw_text")))
    gained = F.length("fixed") - F.length("read")
    return fixed.select("doc_id", F.left("fixed", gained).alias("letter"), T.pad_mrz(F.col("fixed")).alias("line2"))


@register("set3_mrz_candidates", over_corpus(f"""WITH {MRZ_SQL}
SELECT doc_id, array_to_string(cand, '|') AS candidates FROM mrz_b WHERE len(cand) > 0"""), ("corpus",))
def _(spark, sf):
    c = rel(spark, sf, "corpus").select("doc_id", candidate_lines(F.col("raw_text")).alias("c"))
    return c.where(F.size("c") > 0).select("doc_id", joined(F.col("c")).alias("candidates"))
