"""Registered queries: identity groups, face search, registry over time, zone repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from idlens.catalog.inputs import ALPHABET
from idlens.catalog.registry import register, rel
from idlens.operators.asof import verify_registry_as_of
from idlens.operators.faces import search_faces
from idlens.operators.groups import identity_groups, record_tokens
from idlens.operators.mrz_repair import COMPOSITE, FIELDS, LOOK_ALIKES, repair_zones

# --- identity groups ---------------------------------------------------------------------


@register("agg16_identity_groups", r"""WITH RECURSIVE tokens AS (
  SELECT user_id, 'id|' || doc_type || '|' || upper(regexp_replace(id_number, '[-\s]', '', 'g')) AS token FROM tied_records WHERE id_number <> ''
  UNION SELECT user_id, 'person|' || lower(regexp_replace(name, '\s+', ' ', 'g')) || '|' || dob FROM tied_records WHERE dob <> ''),
centres AS (SELECT token, min(user_id) AS centre FROM tokens GROUP BY token),
ties AS (SELECT t.user_id AS a, c.centre AS b FROM tokens t JOIN centres c USING (token) UNION SELECT c.centre, t.user_id FROM tokens t JOIN centres c USING (token)),
reached(user_id, other) AS (SELECT id, id FROM users UNION SELECT r.user_id, t.b FROM reached r JOIN ties t ON r.other = t.a),
named AS (SELECT user_id, min(other) AS group_id FROM reached GROUP BY user_id)
SELECT user_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM named""", ("users", "tied_records"))
def _(spark, sf):
    return identity_groups(rel(spark, sf, "users"), record_tokens(rel(spark, sf, "tied_records")))


# --- faces -----------------------------------------------------------------------------------


@register("jn10_face_search", """WITH stored AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
scores AS (SELECT p.probe_id, s.vec_id, list_dot_product(p.embedding, s.e) / (sqrt(list_dot_product(p.embedding, p.embedding)) * sqrt(list_dot_product(s.e, s.e))) * 100 AS score
  FROM probes p CROSS JOIN stored s)
SELECT probe_id, arg_max(vec_id, score) AS vec_id, round(max(score), 3) AS match_score, max(score) > 90 AS matched FROM scores GROUP BY probe_id""", ("probes",))
def _(spark, sf):
    found = search_faces(rel(spark, sf, "probes"), rel(spark, sf, "embeddings"))
    return found.withColumn("match_score", F.round("match_score", 3))


# --- registry over time ------------------------------------------------------------------------


@register("jn9_registry_as_of", r"""WITH c AS (SELECT doc_id, upper(regexp_replace(id_number, '[-\s]', '', 'g')) AS id, lower(trim(name)) AS n, dob AS b, upper(substr(gender, 1, 1)) AS g, captured_at FROM dated_claims),
v AS (SELECT *, true AS there FROM (SELECT upper(regexp_replace(id_number, '[-\s]', '', 'g')) AS id, lower(trim(name)) AS n, dob AS b, upper(substr(gender, 1, 1)) AS g, valid_from, valid_until,
  row_number() OVER (PARTITION BY upper(regexp_replace(id_number, '[-\s]', '', 'g')), valid_from ORDER BY n DESC, b DESC, g DESC, valid_until DESC NULLS LAST) AS rn FROM registry_versions) AS x WHERE rn = 1),
m AS (SELECT c.*, v.there IS NOT NULL AS id_found, v.valid_from, coalesce(v.valid_until < c.captured_at, false) AS expired,
  coalesce(c.n = v.n, false) AS name_verified, coalesce(c.b = v.b, false) AS dob_verified, coalesce(c.g = v.g, false) AS gender_verified
  FROM c ASOF LEFT JOIN v ON c.id = v.id AND c.captured_at >= v.valid_from)
SELECT doc_id, cast(valid_from AS VARCHAR) AS valid_from, id_found, expired, name_verified, dob_verified, gender_verified,
  id_found AND NOT expired AND name_verified AND dob_verified AND gender_verified AS is_verified FROM m""", ("dated_claims", "registry_versions"))
def _(spark, sf):
    found = verify_registry_as_of(rel(spark, sf, "dated_claims"), rel(spark, sf, "registry_versions"), ["doc_id"])
    return found.withColumn("valid_from", F.col("valid_from").cast("string"))


# --- zone repair: the checking SQL lists every reading ---------------------------------------------


def _value_sql(c: str) -> str:
    return f"greatest(instr('{ALPHABET}', {c}) - 1, 0)"


def _sum_sql(text: str, length: int) -> str:
    return "((" + " + ".join(f"{_value_sql(f'substr({text}, {i + 1}, 1)')} * {(7, 3, 1)[i % 3]}" for i in range(length)) + ") % 10)"


_LETTERS, _DIGITS = ("".join(pair[i] for pair in LOOK_ALIKES) for i in (0, 1))
_DIGIT = f"translate({{0}}, '{_LETTERS}', '{_DIGITS}')"


def _ok_sql(line: str) -> str:
    parts = []
    for start, length, _ in FIELDS:
        digit, data = f"substr({line}, {start + length + 1}, 1)", f"substr({line}, {start + 1}, {length})"
        check = f"{_sum_sql(data, length)}::VARCHAR = {digit}"
        parts.append(f"({check} OR {digit} = '<' AND {data} = '{'<' * length}')" if start == 28 else check)
    composite = " || ".join(f"substr({line}, {s + 1}, {n})" for s, n in COMPOSITE)
    return " AND ".join([f"length({line}) = 44", *parts, f"{_sum_sql(f'({composite})', 39)}::VARCHAR = substr({line}, 44, 1)"])


_FIELD_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS field, substr(line2, {s + 1}, {n}) AS data, substr(line2, {s + n + 1}, 1) AS digit, {n} AS size, {k == 'mixed'} AS mixed FROM todo" for i, (s, n, k) in enumerate(FIELDS))
_REPAIR_SQL = f"""WITH RECURSIVE judged AS (SELECT doc_id, printed, line2, {_ok_sql('line2')} AS valid FROM misread_zones),
todo AS (SELECT * FROM judged WHERE NOT valid AND length(line2) = 44),
fields AS ({_FIELD_ROWS}),
readings(doc_id, field, data, digit, size, mixed, pos, made, cost) AS (
  SELECT doc_id, field, data, digit, size, mixed, 0, '', 0 FROM fields
  UNION ALL SELECT doc_id, field, data, digit, size, mixed, pos + 1, made || to_c, cost + (to_c <> from_c)::INT FROM (
    SELECT r.*, substr(data, pos + 1, 1) AS from_c, unnest(list_distinct(CASE WHEN mixed THEN [substr(data, pos + 1, 1), translate(substr(data, pos + 1, 1), '{_LETTERS}{_DIGITS}', '{_DIGITS}{_LETTERS}')]
      ELSE [{_DIGIT.format('substr(data, pos + 1, 1)')}] END)) AS to_c FROM readings r WHERE pos < size) AS x WHERE mixed OR to_c SIMILAR TO '[0-9<]'),
fitting AS (SELECT *, CASE size WHEN 9 THEN {_sum_sql('made', 9)} WHEN 6 THEN {_sum_sql('made', 6)} ELSE {_sum_sql('made', 14)} END AS total FROM readings WHERE pos = size),
best AS (SELECT doc_id, field, made || {_DIGIT.format('digit')} AS made, cost + ({_DIGIT.format('digit')} <> digit)::INT AS cost,
  row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc_id, field, cost) AS ways FROM fitting WHERE total::VARCHAR = {_DIGIT.format('digit')} OR field = 3 AND digit = '<' AND data = repeat('<', 14) WINDOW w AS (PARTITION BY doc_id, field ORDER BY cost)),
parts AS (SELECT doc_id, max(made) FILTER (field = 0) AS a, max(made) FILTER (field = 1) AS b, max(made) FILTER (field = 2) AS c, max(made) FILTER (field = 3) AS d, sum(cost) AS cost
  FROM best WHERE rn = 1 AND ways = 1 GROUP BY doc_id HAVING count(*) = 4),
whole AS (SELECT t.doc_id, p.a || substr(t.line2, 11, 3) || p.b || substr(t.line2, 21, 1) || p.c || p.d || {_DIGIT.format('substr(t.line2, 44, 1)')} AS line,
  p.cost + ({_DIGIT.format('substr(t.line2, 44, 1)')} <> substr(t.line2, 44, 1))::INT AS changes FROM todo t JOIN parts p USING (doc_id)),
good AS (SELECT * FROM whole WHERE {_ok_sql('line')})
SELECT j.doc_id, coalesce(g.line, j.line2) AS line, coalesce(g.changes, 0)::INT AS changes, CASE WHEN valid THEN 'valid' WHEN g.line IS NOT NULL THEN 'repaired' ELSE 'unrepaired' END AS state,
  coalesce(g.line, j.line2) = j.printed AS as_printed
FROM judged j LEFT JOIN good g USING (doc_id)"""


@register("jn15_zone_repair", _REPAIR_SQL, ("misread_zones",))
def _(spark, sf):
    found = repair_zones(rel(spark, sf, "misread_zones"))
    return found.select("doc_id", "repair.line", "repair.changes", "repair.state", (F.col("repair.line") == F.col("printed")).alias("as_printed"))
