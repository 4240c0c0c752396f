"""Registered queries: extraction, validation, format, cross-checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from idlens import rules
from idlens.catalog.inputs import FIELD_COLUMNS
from idlens.catalog.registry import (
    field_frame,
    joined,
    kind_sql,
    lines_sql,
    name_letters_sql,
    q,
    register,
    rel,
    rx,
    squeeze_sql,
    strip_sql,
)
from idlens.catalog.text_queries import MRZ_SQL, NAME_OK_SQL, over_corpus, typed_sql, verhoeff_sql
from idlens.functions import text as T
from idlens.operators import extract as X
from idlens.operators.classify import classify
from idlens.operators.crosscheck import containment_rate, cross_check, match_faces, verify_registry
from idlens.operators.format_report import format_report, format_rollup, with_profile
from idlens.operators.validate import (
    overall_from_long,
    validate,
    validation_errors,
    verdict,
)

D = "[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}"
LD = "[0-9]{2}[-/. ][0-9]{2}[-/. ][0-9]{4}"
DAY, MON = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])"
NC = r"[A-Za-z\s.'-]"


def first_line_sql(x: str) -> str:
    return f"string_split({strip_sql(x)}, chr(10))[1]"


def slash(x: str) -> str:
    return f"translate({x}, '-.', '//')"


def address_sql(text: str, labels: str) -> str:
    body = rf"(?is)((?:{labels})\s*[:\s]*.+?)"
    near = f"regexp_extract({text}, '{body}(?:\\b[0-9]{{6}}\\b.{{0,14}}|\\z)', 0)"
    full = strip_sql(f"regexp_extract({text}, '{body}(?:\\b[0-9]{{6}}\\b|\\z)', 1)")
    pin = f"regexp_extract({near}, '\\b[0-9]{{6}}\\b', 0)"
    return (f"nullif({squeeze_sql(f'concat({full}, CASE WHEN {pin} <> {chr(39)}{chr(39)} AND NOT contains({full}, {pin}) THEN concat({chr(39)} - {chr(39)}, {pin}) ELSE {chr(39)}{chr(39)} END)')}, '')")


# --- name rules over lines ------------------------------------------------------------------

_ANCHOR = rf"DOB|BIRTH|YOB|MALE|TRANSGENDER|\b{D}\b"
_HEADER = "GOVERNMENT OF INDIA|BHARAT SARKAR|UNIQUE IDENTIFICATION"


def names_sql(source: str, text: str = "raw_text") -> str:
    """CTEs: per document the cleaned lines, anchor and header positions (1-based)."""
    return f"""nl AS (SELECT doc_id, l, list_transform(l, lambda x: {name_letters_sql('x')}) AS c,
  coalesce(list_position(list_transform(l, lambda x: regexp_matches(upper(x), '{_ANCHOR}')), true), 0) AS anchor,
  coalesce(list_position(list_transform(l, lambda x: regexp_matches(upper(x), '{_HEADER}')), true), 0) AS header
  FROM (SELECT doc_id, {lines_sql(text)} AS l FROM {source}) AS s),
nn AS (SELECT doc_id, l, anchor, header, list_transform(c, lambda c: CASE WHEN {NAME_OK_SQL} THEN c END) AS n FROM nl),
above AS (SELECT doc_id, CASE WHEN anchor > 1 THEN coalesce(n[anchor - 1], CASE WHEN anchor > 2 THEN n[anchor - 2] END, CASE WHEN anchor > 3 THEN n[anchor - 3] END) END AS name_above,
  list_filter(n[greatest(header, 1):CASE WHEN anchor > 1 THEN anchor - 1 ELSE len(n) END], lambda x: x IS NOT NULL)[1] AS name_below FROM nn)"""


@register("win6_name_above_anchor", f"""WITH {names_sql('corpus')}
SELECT doc_id, name_above FROM above WHERE name_above IS NOT NULL""", ("corpus",))
def _(spark, sf):
    c = rel(spark, sf, "corpus").select("doc_id", T.let(
        X.line_facts(F.col("raw_text")), lambda s: X.name_above_anchor(s["lines"], s["anchor"])).alias("name_above"))
    return c.where("name_above is not null")


@register("win7_name_below_header", f"""WITH {names_sql('corpus')}
SELECT doc_id, name_below FROM above WHERE name_below IS NOT NULL""", ("corpus",))
def _(spark, sf):
    name = T.let(
        X.line_facts(F.col("raw_text")), lambda s: X.name_below_header(s["lines"], s["anchor"], s["header"]))
    # a filter on the name would be pushed below it and work it out twice
    return rel(spark, sf, "corpus").select("doc_id", F.explode(F.array_compact(F.array(name))).alias("name_below"))


_LICENCE_WORDS = "|".join(rules.LICENCE_NAME_FORBIDDEN)
_RELATION = "S/O|D/O|W/O|SON OF|DAUGHTER OF|WIFE OF|DOB:"
LICENCE_LINE_SQL = f"""ll AS (SELECT doc_id, l, list_transform(l, lambda x: {name_letters_sql('x')}) AS c FROM (SELECT doc_id, {lines_sql('raw_text')} AS l FROM {{source}}) AS s),
lw AS (SELECT doc_id, list_filter(list_transform(range(1, len(l)), lambda i: CASE WHEN regexp_matches(upper(l[i + 1]), '{_RELATION}') AND length(c[i]) BETWEEN 3 AND 35
  AND NOT regexp_matches(upper(c[i]), '{_LICENCE_WORDS}') THEN c[i] END), lambda x: x IS NOT NULL)[1] AS line_name FROM ll)"""


@register("win8_line_before_relation", f"WITH {LICENCE_LINE_SQL.format(source='corpus')}" + """
SELECT doc_id, line_name FROM lw WHERE line_name IS NOT NULL""", ("corpus",))
def _(spark, sf):
    c = rel(spark, sf, "corpus").select(
        "doc_id", T.let(T.text_lines(F.col("raw_text")), X.name_before_relation).alias("line_name"))
    return c.where("line_name is not null")


# --- extractors ---------------------------------------------------------------------------------


def hindi(word: str, text: str = "raw_text") -> str:
    return f"regexp_matches({text}, '(?:^|[^\\p{{L}}\\p{{M}}]){word}(?:[^\\p{{L}}\\p{{M}}]|$)')"


def aadhaar_sql(source: str, last_name: str = "") -> str:
    """`last_name`: one more name column of the source, for where all other rules fail."""
    t = "raw_text"
    prefixed = f"nullif({first_line_sql(rf'''regexp_extract(raw_text, '{q(rf'(?i)(?:Name|To|Holder)\s*[:\s]+\s*({NC}{{3,35}})')}', 1)''')}, '')"
    bad = "|".join(rules.NAME_FORBIDDEN)
    dob_label = rf"(?i)(?:DOB|Date of Birth|DOB:)\s*[:\s]*({D})"
    yob_label = r"(?i)(?:YOB|Year of Birth|Birth Year)\s*[:\s]*([0-9]{4})"
    year = r"\b(19[0-9]{2}|20[0-2][0-9])\b"
    any_date = rf"\b({D})\b"
    return f"""{names_sql(source)},
aq AS (SELECT k.*, name_above, name_below, {rx('payload', 'uid="([0-9]{12})"')} AS q_uid, {rx('payload', 'name="([^"]+)"')} AS q_name,
  {rx('payload', 'dob="([^"]+)"')} AS q_dob, {rx('payload', 'gender="([^"]+)"')} AS q_gender,
  regexp_replace({rx(t, r'\b([0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4})\b')}, '[-\\s]', '', 'g') AS plain,
  {rx(t, r'(?i)\b([X0-9]{4}[-\s]?[X0-9]{4}[-\s]?[0-9]{4})\b')} AS masked, {prefixed} AS prefixed
  FROM {source} k JOIN above a ON k.doc_id = a.doc_id),
ar AS (SELECT *, q_uid IS NOT NULL AND q_name IS NOT NULL AND q_dob IS NOT NULL AS complete,
  CASE WHEN q_uid IS NOT NULL THEN q_name END AS t_name, CASE WHEN q_uid IS NOT NULL THEN q_dob END AS t_dob, CASE WHEN q_uid IS NOT NULL THEN q_gender END AS t_gender FROM aq),
az AS (SELECT *, CASE WHEN complete THEN q_uid ELSE coalesce(plain, masked, q_uid) END AS number, NOT complete AND plain IS NULL AND masked IS NOT NULL AS is_masked FROM ar),
aadhaar AS (SELECT doc_id, number AS aadhaar_number,
  CASE WHEN is_masked THEN true WHEN number IS NULL THEN false ELSE {verhoeff_sql('number')} END AS aadhaar_number_valid,
  coalesce(t_dob, {slash(rx(t, dob_label))}, {slash(rx(t, any_date))}, {rx(t, yob_label)}, {rx(t, year)}) AS dob,
  coalesce(t_gender, CASE WHEN complete THEN NULL WHEN regexp_matches(raw_text, '(?i)\\bMALE\\b') OR {hindi('पुरुष')} THEN 'MALE'
    WHEN regexp_matches(raw_text, '(?i)\\bFEMALE\\b') OR {hindi('महिला')} THEN 'FEMALE' WHEN regexp_matches(raw_text, '(?i)\\bTRANSGENDER\\b') THEN 'TRANSGENDER' END) AS gender,
  coalesce(t_name, {strip_sql(rx(t, '(?i)name="([^"]+)"'))}, CASE WHEN NOT regexp_matches(upper(prefixed), '{bad}') THEN prefixed END, name_above, name_below{last_name and ', ' + last_name}) AS name,
  CASE WHEN NOT complete THEN {address_sql(t, 'Address|पता|S/O|C/O|W/O|D/O')} END AS address FROM az)"""


_AADHAAR_COLUMNS = ("aadhaar_number", "aadhaar_number_valid", "dob", "gender", "name", "address")


@register("ext1_aadhaar", f"WITH {aadhaar_sql('kyc')} SELECT * FROM aadhaar", ("kyc",))
def _(spark, sf):
    x = X.extract_aadhaar(rel(spark, sf, "kyc"), payload="payload")
    return x.select("doc_id", *[f"aadhaar.{c}" for c in _AADHAAR_COLUMNS])


@register("ext1_aadhaar_documents", f"""WITH doc AS (SELECT doc_id, text AS raw_text, cast(NULL AS VARCHAR) AS payload FROM documents),
{aadhaar_sql('doc')} SELECT * FROM aadhaar""")
def _(spark, sf):
    docs = rel(spark, sf, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return X.extract_aadhaar(docs).select("doc_id", *[f"aadhaar.{c}" for c in _AADHAAR_COLUMNS])


def licence_sql(source: str) -> str:
    t = "raw_text"
    shapes = (
        r"(?i)\b([A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7})\b",
        r"(?i)\b([A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{11})\b",
        r"(?i)\b([A-Z]{2}[-\s]?[0-9]{12,14})\b",
        r"(?i)\b(?:DL\s*NO|LICENCE\s*NO|DL)\.?\s*[:\s]*([A-Z0-9/\-\s]{10,20})\b",
    )
    cleaned = [f"upper(regexp_replace({rx(t, s)}, '[-\\s]', '', 'g'))" for s in shapes]
    number = "coalesce(" + ", ".join(f"CASE WHEN length({c}) >= 10 THEN {c} END" for c in cleaned) + ")"
    label = rx(t, rf"(?i)(?:Name|Holder|Name of Holder)\s*[:\s]*({NC}{{2,35}})")

    def dated(labels: str) -> str:
        return slash(rx(t, rf"(?i)(?:{labels})\s*[:\s]*({D})"))

    codes = "[" + ", ".join(f"'{c}'" for c in rules.VEHICLE_CLASSES) + "]"
    found = f"list_filter({codes}, lambda c: contains(upper(raw_text), c))"
    relation_name = strip_sql(rx(t, rf"(?i)(?:S/O|D/O|W/O|Son of|Daughter of|Wife of)\s*[:\s]*({NC}{{2,35}})"))
    any_date = rf"\b({D})\b"
    return f"""{LICENCE_LINE_SQL.format(source=source)},
licence AS (SELECT k.doc_id, {number} AS dl_number, coalesce({dated('DOB|Date of Birth|Birth')}, {slash(rx(t, any_date))}) AS dob,
  CASE WHEN {label} IS NOT NULL THEN CASE WHEN length({first_line_sql(label)}) >= 2 THEN {first_line_sql(label)} END ELSE line_name END AS name,
  {dated('Issue Date|DOI|Issued')} AS issue_date, {dated('Validity|Valid Till|NT')} AS validity_nt,
  CASE WHEN len({found}) > 0 THEN array_to_string({found}, ', ') END AS vehicle_classes,
  {rx(t, r'(?i)(?:Blood Group|BG)\s*[:\s]*([ABO][+-])')} AS blood_group, nullif({relation_name}, '') AS relation_name,
  {address_sql(t, 'Address|Add')} AS address FROM {source} k JOIN lw ON k.doc_id = lw.doc_id)"""


_LICENCE_COLUMNS = ("dl_number", "dob", "name", "issue_date", "validity_nt", "blood_group", "relation_name", "address")


@register("ext4_licence", f"WITH {licence_sql('corpus')} SELECT * FROM licence", ("corpus",))
def _(spark, sf):
    x = X.extract_licence(rel(spark, sf, "corpus"))
    return x.select("doc_id", *[f"licence.{c}" for c in _LICENCE_COLUMNS],
                    joined(F.col("licence.vehicle_classes"), ", ").alias("vehicle_classes"))


def passport_sql() -> str:
    """Over kyc joined to its zones (CTE mrz)."""
    t = "raw_text"

    def line_after(labels: str, chars: str) -> str:
        return strip_sql(first_line_sql(rx(t, rf"(?i)(?:{labels})[\s.:]*({chars})")))

    def viz(x: str) -> str:
        return f"replace({slash(x)}, ' ', '')"

    name_chars = NC + "{2,35}"
    seen = f"""upper(coalesce({rx(t, r'\b([A-PR-WYa-pr-wy][0-9]{7})\b')}, {rx(t, r'(?i)(?:Passport\s*No|Passport\s*Number)[\s.:]*([A-Z0-9]{8,9})')}))"""
    dob_l = viz(rx(t, rf"(?i)(?:Date\s*of\s*Birth|Date\s*de\s*naissance|DOB|5\.\s*जन्मतिथि)[\s.:]*({LD})"))
    dob_p = viz(rx(t, rf"\b({DAY}[-/. ]{MON}[-/. ](?:19[0-9]{{2}}|20[0-2][0-9]))\b"))
    split = rf"\b({DAY})\s*\n\s*(19[0-9]{{2}}|20[0-2][0-9])\b"
    dob_s = f"{rx(t, split, 1)} || '/01/' || {rx(t, split, 2)}"
    part = rf"\b({MON})[-/. ](20[12][0-9])\b"
    issued = (f"coalesce({viz(rx(t, rf'(?i)(?:Date\s*of\s*Issue|Date\s*de\s*d[ée]livrance|Issue|8\.\s*जारी)[\s.:]*({LD})'))}, "
              f"{viz(rx(t, rf'\b({DAY}[-/. ]{MON}[-/. ]20[12][0-9])\b'))}, '01/' || {rx(t, part, 1)} || '/' || {rx(t, part, 2)})")
    exp_label = rf"(?i)(?:Date\s*of\s*Expiry|Date\s*d'expiration|Expiry|9\.\s*समाप्ति)[\s.:]*({LD})"
    exp_plain = rf"\b({DAY}[-/. ]{MON}[-/. ]20[2-4][0-9])\b"
    expires = f"coalesce({viz(rx(t, exp_label))}, nullif(m.expiry_date, ''), {viz(rx(t, exp_plain))})"
    cities = "|".join(rules.BIRTH_CITIES)
    born = (f"coalesce({line_after(r'Place\s*of\s*Birth|Lieu\s*de\s*naissance|7\.\s*जन्म\s*स्थान', r'[A-Za-z\s,]+')}, "
            f"{rx(t, r'\b([A-Z]{3,15}\s*,\s*IND)\b')}, upper({rx(t, rf'(?i)\b({cities})\b')}) || ', IND')")
    issue_at = (f"coalesce({line_after(r'Place\s*of\s*Issue|10\.\s*जारी\s*करने\s*का\s*स्थान', r'[A-Za-z\s]+')}, "
                f"{rx(t, r'(?i)\b(RPO\s+[A-Za-z]+)\b')})")
    sex_label = r"(?i)(?:Sex|Sexe|6\.\s*लिंग)[\s.:]*"
    return f"""pa AS (SELECT k.doc_id, k.raw_text, m.line1, m.line2, m.strict, m.passport_number AS zone_number, m.country, m.sex AS zone_sex,
  nullif(m.nationality, '') AS nation, m.surname AS zs, m.given_name AS zg,
  coalesce(nullif(m.surname, ''), {line_after(r'Surname|Nom|1\.\s*उपनाम', name_chars)}, m.surname) AS surname,
  coalesce(nullif(m.given_name, ''), {line_after(r'Given\s*Name[s]?|Pr[ée]nom|2\.\s*दिया\s*गया\s*नाम', name_chars)}, m.given_name) AS given_name,
  {seen} AS seen, coalesce({dob_l}, nullif(m.dob, ''), {dob_p}) AS full_dob, {dob_s} AS split_dob, {issued} AS date_of_issue, {expires} AS date_of_expiry,
  {born} AS place_of_birth, {issue_at} AS place_of_issue,
  {strip_sql(rx(t, r'(?i)(?:TAM|TAMIL|HINDI|स्थानीय\s*भाषा)[\s.:]*[^\n]+', 0))} AS name_in_local_language,
  {line_after(r'Signature|11\.\s*हस्ताक्षर', r'[A-Za-z\s]+')} AS signature, {line_after('Name|Holder', name_chars)} AS labelled_name,
  coalesce(nullif(m.sex, ''), CASE WHEN regexp_matches(raw_text, '{sex_label}F\\b') OR regexp_matches(raw_text, '(?i)\\bFEMALE\\b') THEN 'F'
    WHEN regexp_matches(raw_text, '{sex_label}M\\b') OR regexp_matches(raw_text, '(?i)\\bMALE\\b') THEN 'M' END) AS sex
  FROM kyc k LEFT JOIN mrz m ON k.doc_id = m.doc_id),
passport AS (SELECT doc_id,
  CASE WHEN regexp_matches(zone_number, '^[A-Z][0-9]{{7}}$') THEN zone_number ELSE coalesce(seen, zone_number) END AS passport_number,
  surname, given_name,
  CASE WHEN surname <> '' AND given_name <> '' THEN surname || ' ' || given_name ELSE coalesce(nullif({strip_sql("concat_ws(' ', zs, zg)")}, ''), labelled_name) END AS name,
  CASE WHEN (nation IS NULL OR nation = 'ND8') AND contains(upper(raw_text), 'IND') THEN 'INDIAN' ELSE nation END AS nationality,
  CASE WHEN nation IS NULL OR nation = 'ND8' THEN 'IND' ELSE coalesce(nullif(country, ''), 'IND') END AS issuing_country,
  coalesce(full_dob, split_dob) AS dob, full_dob IS NULL AND split_dob IS NOT NULL AS dob_partial, sex, date_of_issue, date_of_expiry,
  place_of_birth, place_of_issue, name_in_local_language, signature, coalesce(strict, false) AS mrz_checksum_valid,
  line1 IS NOT NULL AS mrz_checksum_lenient, line1 || chr(10) || line2 AS mrz_raw FROM pa)"""


_PASSPORT_COLUMNS = (
    "passport_number", "surname", "given_name", "name", "nationality", "issuing_country", "dob", "dob_partial", "sex",
    "date_of_issue", "date_of_expiry", "place_of_birth", "place_of_issue", "name_in_local_language", "signature",
    "mrz_checksum_valid", "mrz_checksum_lenient",
)


@register("ext2_passport", over_corpus(f"WITH {MRZ_SQL}, {passport_sql()} SELECT * FROM passport"), ("corpus",))
def _(spark, sf):
    x = X.extract_passport(rel(spark, sf, "corpus"))
    return x.select("doc_id", *[f"passport.{c}" for c in _PASSPORT_COLUMNS],
                    joined(F.col("passport.mrz_raw"), "\n").alias("mrz_raw"))


def visa_sql() -> str:
    t = "raw_text"
    label = first_line_sql(rx(t, rf"(?i)(?:Name|Nom|Nombre|Bearer)\s*[:\s]*({NC}+)"))
    return f"""visa AS (SELECT k.doc_id, {rx(t, r'(?i)(?:VISA\s*NO|VISA|NUMBER)\s*[:\s]*([A-Z0-9]{6,12})')} AS visa_number, m.passport_number,
  coalesce(nullif({strip_sql("concat_ws(' ', m.given_name, m.surname)")}, ''), {label}) AS name, m.surname, m.given_name, m.nationality, m.dob, m.sex,
  m.expiry_date AS date_of_expiry,
  CASE WHEN contains(upper(raw_text), 'TOURIST') THEN 'TOURIST' WHEN contains(upper(raw_text), 'BUSINESS') THEN 'BUSINESS'
       WHEN contains(upper(raw_text), 'STUDENT') THEN 'STUDENT' WHEN contains(upper(raw_text), 'EMPLOYMENT') THEN 'EMPLOYMENT' END AS visa_type,
  CASE WHEN contains(upper(raw_text), 'MULT') THEN 'MULTIPLE' WHEN contains(upper(raw_text), 'SINGLE') THEN 'SINGLE'
       WHEN contains(upper(raw_text), 'DOUBLE') THEN 'DOUBLE' END AS no_of_entries,
  coalesce(m.strict, false) AS mrz_checksum_valid, m.line1 || chr(10) || m.line2 AS mrz_raw FROM kyc k LEFT JOIN mrz m ON k.doc_id = m.doc_id)"""


_VISA_COLUMNS = ("visa_number", "passport_number", "name", "surname", "given_name", "nationality", "dob", "sex",
                 "date_of_expiry", "visa_type", "no_of_entries", "mrz_checksum_valid")


@register("ext3_visa", over_corpus(f"WITH {MRZ_SQL}, {visa_sql()} SELECT * FROM visa"), ("corpus",))
def _(spark, sf):
    x = X.extract_visa(rel(spark, sf, "corpus"))
    return x.select("doc_id", *[f"visa.{c}" for c in _VISA_COLUMNS],
                    joined(F.col("visa.mrz_raw"), "\n").alias("mrz_raw"))


def _pick(column: str, have: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN t.document_type = '{k}' THEN {v}.{column}" for k, v in have.items()) + " END"


# columns of the dispatched struct and the extractors that fill them
_DISPATCH = {
    "aadhaar_number": "a", "aadhaar_number_valid": "a", "passport_number": "pv", "visa_number": "v", "dl_number": "l", "name": "apvl",
    "surname": "pv", "given_name": "pv", "dob": "apvl", "gender": "a", "sex": "pv", "nationality": "pv",
    "issuing_country": "p", "date_of_issue": "p", "date_of_expiry": "pv", "place_of_birth": "p", "visa_type": "v",
    "no_of_entries": "v", "issue_date": "l", "validity_nt": "l", "vehicle_classes": "l", "address": "al",
    "mrz_checksum_valid": "pv", "mrz_raw": "pv",
}


def fields_sql(typed: str | None = None, last_name: str = "") -> str:
    """Over kyc; types by the text unless a relation (doc_id, document_type) gives them."""
    kinds = {"a": ["aadhaar"], "p": ["passport", "unknown"], "v": ["visa"], "l": ["driving_licence"]}
    cols = ", ".join(
        f"{_pick(c, {k: s for s in sources for k in kinds[s]})} AS {c}" for c, sources in _DISPATCH.items())
    head = "" if typed else typed_sql("kyc", "raw_text", "coalesce(payload, '')") + ", "
    return f"""{head}{aadhaar_sql('kyc', last_name)}, {licence_sql('kyc')}, {MRZ_SQL}, {passport_sql()}, {visa_sql()},
fields AS (SELECT t.doc_id, t.document_type, {cols} FROM {typed or 'typed'} t JOIN aadhaar a ON t.doc_id = a.doc_id JOIN licence l ON t.doc_id = l.doc_id
  JOIN passport p ON t.doc_id = p.doc_id JOIN visa v ON t.doc_id = v.doc_id)"""


def extracted(spark, sf, source="kyc"):
    typed = classify(rel(spark, sf, source), "raw_text", "payload")
    return X.extract_fields(typed, payload="payload")


def dispatched(fields):
    """The columns of a dispatched struct, lists as text."""
    return [(X.field_text(fields, c) if X.FIELD_TYPES[c].startswith("array") else fields[c]).alias(c) for c in _DISPATCH]


@register("ext7_dispatch", over_corpus(f"WITH {fields_sql()} SELECT * FROM fields"), ("corpus",))
def _(spark, sf):
    return extracted(spark, sf, "corpus").select("doc_id", "document_type", *dispatched(F.col("fields")))


@register("udf1_custom_extractor", f"""
SELECT doc_id, CASE WHEN starts_with(raw_text, 'plain') THEN {rx('raw_text', 'note ([0-9]+)')} END AS number,
  CASE WHEN starts_with(raw_text, 'plain') THEN {lines_sql('raw_text')}[2] END AS name,
  {verhoeff_sql('uid')} AS uid_ok FROM kyc""", ("kyc",))
def _(spark, sf):
    from idlens.functions.sql import register_sql_functions

    register_sql_functions(spark)
    X.register_extractor("note", lambda text, lines, payload: F.struct(
        T.first_match(text, "note ([0-9]+)").alias("passport_number"), F.get(lines, F.lit(1)).alias("name")))
    try:
        kind = F.when(F.col("raw_text").startswith("plain"), "note").otherwise("none")
        out = X.extract_fields(rel(spark, sf, "kyc").withColumn("document_type", kind))
    finally:
        X.unregister_extractor("note")
    note = F.col("document_type") == "note"
    return out.select(
        "doc_id", F.when(note, F.col("fields.passport_number")).alias("number"),
        F.when(note, F.col("fields.name")).alias("name"), F.expr("kyc_verhoeff(uid)").alias("uid_ok"))


_LIGHT_ID = {
    "aadhaar": [r"\b([0-9]{4}\s[0-9]{4}\s[0-9]{4})\b", r"\b([X0-9]{4}\s[X0-9]{4}\s[0-9]{4})\b"],
    "passport": [r"\b([A-PR-WYa-pr-wy][0-9]{7})\b"],
    "driving_licence": [r"(?i)\b([A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4,7})\b"],
    "visa": [r"(?i)\b(V[0-9]{7,9})\b"],
}


def light_sql() -> str:
    ids = " ".join(f"WHEN document_type = '{k}' THEN upper(coalesce({', '.join(rx('raw_text', p) for p in ps)}, NULL))" for k, ps in _LIGHT_ID.items())
    heads = "|".join(rules.LIGHT_HEADERS)
    return f"""{typed_sql('kyc', 'raw_text', "coalesce(payload, '')")},
la AS (SELECT k.doc_id, coalesce({rx('raw_text', r'\b([0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4})\b')},
    {rx('raw_text', r'(?i)(?:DOB|D\.O\.B|Birth|Year)[\s:]*([0-9]{2}[/\-][0-9]{2}[/\-][0-9]{4}|[0-9]{4})')}) AS date_of_birth,
  CASE WHEN regexp_matches(raw_text, '(?i)\\b(FEMALE|WOMAN)\\b') THEN 'Female' WHEN regexp_matches(raw_text, '(?i)\\b(MALE|MAN)\\b') THEN 'Male' END AS gender,
  CASE {ids} END AS identifier, list_filter({lines_sql('raw_text')}, lambda x: length(x) > 2) AS l FROM kyc k JOIN typed t ON k.doc_id = t.doc_id),
lb AS (SELECT *, list_filter(l, lambda x: NOT regexp_matches(x, '(?i){heads}') AND regexp_matches(x, '^[A-Za-z\\s.]{{3,35}}$'))[1] AS name FROM la),
light AS (SELECT doc_id, date_of_birth, gender, identifier, name,
  CASE WHEN (date_of_birth IS NOT NULL)::INT + (gender IS NOT NULL)::INT + (identifier IS NOT NULL)::INT + (name IS NOT NULL)::INT < 2 THEN l[1:4] ELSE [] END AS lines FROM lb)"""


def light_frame(spark, sf):
    return X.extract_light(classify(rel(spark, sf, "corpus"), "raw_text", "payload"))


@register("ext6_light_rules", over_corpus(f"""WITH {light_sql()}
SELECT doc_id, date_of_birth, gender, identifier, name FROM light"""), ("corpus",))
def _(spark, sf):
    return light_frame(spark, sf).select(
        "doc_id", F.col("light.dateOfBirth").alias("date_of_birth"), "light.gender", "light.identifier", "light.name")


@register("srt3_generic_lines", over_corpus(f"""WITH {light_sql()}
SELECT doc_id, i AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM light) AS u"""), ("corpus",))
def _(spark, sf):
    # the outer form: for the inner one the optimizer infers a filter on the lines, and pushes
    # it below the classes, which it then writes out anew wherever a rule names one
    return light_frame(spark, sf).select("doc_id", F.posexplode_outer("light.lines").alias("p", "line")).where("p IS NOT NULL").select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


_NON_EMPTY = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS key, {c} AS value FROM field_wide WHERE {c} <> ''" for c in FIELD_COLUMNS)


@register("map1_long_and_wide", f"""WITH long AS ({_NON_EMPTY})
SELECT doc_id, count(*) AS n_fields, max(CASE WHEN key = 'name' THEN value END) AS name, max(CASE WHEN key = 'dob' THEN value END) AS dob FROM long GROUP BY doc_id""", ("field_wide",))
def _(spark, sf):
    # (doc, fields) to rows and back
    long = X.fields_long(field_frame(spark, sf), ["doc_id"])
    wide = X.fields_wide(long, ["doc_id"], ["name", "dob"])
    return wide.select("doc_id", F.size("fields_map").cast("bigint").alias("n_fields"), "name", "dob")


@register("agg13_field_counts", f"""WITH long AS ({_NON_EMPTY}) SELECT doc_id, count(*) AS n_fields FROM long GROUP BY doc_id""", ("field_wide",))
def _(spark, sf):
    from idlens.operators.fields import fields_per_document

    return fields_per_document(X.fields_long(field_frame(spark, sf), ["doc_id"]), ["doc_id"])


# --- validation ---------------------------------------------------------------------------------------


def checks_sql(source: str = "field_wide") -> str:
    kind = kind_sql("doc_type")
    bare = "replace(aadhaar_number, ' ', '')"
    return f"""kinds AS (SELECT *, {kind} AS kind FROM {source}),
checks AS (SELECT *,
  CASE WHEN kind = 'aadhaar' THEN CASE WHEN contains(upper({bare}), 'X') THEN 'pass' WHEN regexp_matches({bare}, '^[0-9]{{12}}$') AND {verhoeff_sql(bare)} THEN 'pass' ELSE 'fail' END END AS c_uid,
  CASE WHEN kind = 'aadhaar' AND dob <> '' THEN 'pass' END AS c_dob,
  CASE WHEN kind IN ('passport', 'visa') THEN CASE WHEN mrz_checksum_valid = 'true' THEN 'pass' WHEN mrz_checksum_valid = 'false' THEN 'fail' WHEN mrz_raw IS NOT NULL THEN 'pass' ELSE 'fail' END END AS c_mrz,
  CASE WHEN kind IN ('passport', 'visa') THEN CASE WHEN passport_number <> '' OR visa_number <> '' THEN 'pass' ELSE 'fail' END END AS c_doc,
  CASE WHEN kind = 'driving_licence' THEN CASE WHEN length(dl_number) >= 10 THEN 'pass' ELSE 'fail' END END AS c_dl,
  CASE WHEN kind IN ('aadhaar', 'driving_licence') AND name <> '' THEN 'pass' END AS c_name FROM kinds),
verdicts AS (SELECT *, CASE WHEN coalesce(c_uid = 'fail', false) OR coalesce(c_mrz = 'fail', false) OR coalesce(c_doc = 'fail', false) OR coalesce(c_dl = 'fail', false)
  OR coalesce(c_uid, c_dob, c_mrz, c_doc, c_dl, c_name) IS NULL THEN 'fail' ELSE 'pass' END AS overall FROM checks)"""


def checked(spark, sf):
    return validate(field_frame(spark, sf), "doc_type")


_CHECKS = {"val1_aadhaar_checks": ("aadhaar", {"aadhaar_number": "c_uid", "dob": "c_dob", "name": "c_name"}),
           "val2_travel_checks": ("passport', 'visa", {"mrz_check_digits": "c_mrz", "document_number": "c_doc"}),
           "val3_licence_checks": ("driving_licence", {"dl_number": "c_dl", "name": "c_name"})}


def _register_checks(name: str, kinds: str, columns: dict[str, str]) -> None:
    picked = ", ".join(f"{c} AS {k}_check" for k, c in columns.items())

    @register(name, f"WITH {checks_sql()} SELECT doc_id, {picked}, overall FROM verdicts WHERE kind IN ('{kinds}')", ("field_wide",))
    def _(spark, sf):
        wanted = [k.strip("' ") for k in kinds.split(",")]
        rows = checked(spark, sf).where(T.normal_doc_type(F.col("doc_type")).isin(*wanted))
        s = F.col("validation_status")
        return rows.select("doc_id", *[F.try_element_at(s, F.lit(k)).alias(f"{k}_check") for k in columns],
                           s["overall"].alias("overall"))


for _name, (_kinds, _columns) in _CHECKS.items():
    _register_checks(_name, _kinds, _columns)

_ERR = ", ".join(
    f"CASE WHEN {c} = 'fail' THEN '{label} validation failed' END" for c, label in
    (("c_uid", "Aadhaar Number"), ("c_mrz", "Mrz Check Digits"), ("c_doc", "Document Number"), ("c_dl", "Dl Number")))
_ERRORS_SQL = f"array_to_string(list_filter([{_ERR}], lambda x: x IS NOT NULL), '|')"


@register("agg11_validation_errors", f"WITH {checks_sql()} SELECT doc_id, {_ERRORS_SQL} AS errors FROM verdicts", ("field_wide",))
def _(spark, sf):
    return checked(spark, sf).select("doc_id", joined(validation_errors(F.col("validation_status"))).alias("errors"))


@register("val4_api_verdict", f"""WITH {checks_sql()} SELECT doc_id, overall = 'pass' AS is_valid,
  CASE WHEN kind IN ('passport', 'visa') THEN coalesce(mrz_checksum_valid = 'true', false) ELSE true END AS mrz_valid,
  CASE WHEN kind = 'aadhaar' THEN c_uid = 'pass' ELSE true END AS checksum_valid,
  coalesce(try_strptime(coalesce(date_of_expiry, validity_nt), '%d/%m/%Y')::DATE >= DATE '2025-06-30', true) AS expiry_valid,
  {_ERRORS_SQL} AS errors FROM verdicts""", ("field_wide",))
def _(spark, sf):
    v = verdict(checked(spark, sf), F.lit("2025-06-30").cast("date"), "doc_type")
    return v.select("doc_id", "is_valid", "mrz_valid", "checksum_valid", "expiry_valid", joined(F.col("errors")).alias("errors"))


@register("agg10_overall_validity", f"""WITH {checks_sql()},
long AS (SELECT doc_id, unnest([c_uid, c_dob, c_mrz, c_doc, c_dl, c_name]) AS status FROM checks)
SELECT doc_id, CASE WHEN bool_and(status <> 'fail') THEN 'pass' ELSE 'fail' END AS overall, count(*) AS n_checks FROM long WHERE status IS NOT NULL GROUP BY doc_id""", ("field_wide",))
def _(spark, sf):
    # the outer form: for the inner one the optimizer infers a filter that runs all checks again
    rows = checked(spark, sf).select("doc_id", F.explode_outer("validation_status").alias("check", "status"))
    return overall_from_long(rows.where("check <> 'overall'"), ["doc_id"])


# --- QR against text -------------------------------------------------------------------------------------

_QKEYS = {k: rf'(?i){k}="([^"]+)"' for k in ("name", "dob")}


def cross_sql(fields: str = "field_wide", pages: str = "kyc") -> str:
    number = "coalesce(nullif(aadhaar_number, ''), nullif(dl_number, ''), nullif(passport_number, ''))"
    return f"""qx AS (SELECT f.*, k.payload, nullif({strip_sql(rx('payload', _QKEYS['name']))}, '') AS qn, nullif({strip_sql(rx('payload', _QKEYS['dob']))}, '') AS qd,
  contains(payload, '="') AS has_attributes, {number} AS number FROM {fields} f JOIN {pages} k ON f.doc_id = k.doc_id),
qy AS (SELECT *, CASE WHEN qn <> '' AND name <> '' THEN contains(lower(qn), lower({strip_sql('name')})) OR contains(lower({strip_sql('name')}), lower(qn)) END AS name_ok,
  CASE WHEN qd <> '' AND dob <> '' THEN contains(qd, dob) OR contains(dob, qd) END AS dob_ok,
  coalesce(contains(replace(payload, ' ', ''), regexp_replace(number, '\\s+', '', 'g')), false) AS number_ok FROM qx),
cross_checked AS (SELECT doc_id, payload IS NOT NULL AS qr_detected, payload AS qr_data,
  CASE WHEN payload IS NULL THEN 0 ELSE coalesce(name_ok, false)::INT + coalesce(dob_ok, false)::INT + number_ok::INT END AS matches,
  CASE WHEN payload IS NULL THEN ['QR code not detected on document'] ELSE list_filter([
    CASE WHEN NOT name_ok THEN 'Name mismatch: QR=''' || qn || ''', OCR=''' || name || '''' END,
    CASE WHEN NOT dob_ok THEN 'DOB mismatch: QR=''' || qd || ''', OCR=''' || dob || '''' END], lambda x: x IS NOT NULL) END AS mismatches,
  has_attributes FROM qy)"""


def qr_frame(spark, sf):
    """Two decodes per payload: the page's own and a second reading to be ignored."""
    own = rel(spark, sf, "kyc").where("payload is not null").select("doc_id", "payload", F.lit("pyzbar").alias("method"))
    again = own.select("doc_id", F.concat(F.lit("again "), "payload").alias("payload"), F.lit("opencv").alias("method"))
    return own.unionByName(again)


@register("jn2_qr_cross_check", f"""WITH {cross_sql()}
SELECT doc_id, qr_detected, qr_data, array_to_string(mismatches, '|') AS mismatches FROM cross_checked""", ("field_wide", "kyc"))
def _(spark, sf):
    c = cross_check(field_frame(spark, sf), qr_frame(spark, sf), ["doc_id"])
    return c.select("doc_id", "qr_check.qr_detected", "qr_check.qr_data", joined(F.col("qr_check.mismatches")).alias("mismatches"))


@register("agg14_qr_verdict", f"""WITH {cross_sql()}
SELECT doc_id, cast(matches AS INT) AS matches, CASE WHEN qr_detected THEN len(mismatches) = 0 AND (matches > 0 OR NOT has_attributes) END AS qr_ocr_match FROM cross_checked""", ("field_wide", "kyc"))
def _(spark, sf):
    c = cross_check(field_frame(spark, sf), qr_frame(spark, sf), ["doc_id"])
    return c.select("doc_id", "qr_check.matches", "qr_check.qr_ocr_match")


_LIST = "list_filter([" + ", ".join("f." + c for c in FIELD_COLUMNS) + "], lambda x: x <> '')"


@register("jn3_containment", f"""
SELECT doc_id, round_even(rate, 2) AS confidence_score, rate <= 85 AS tamper_detected FROM (
  SELECT doc_id, CASE WHEN len(v) = 0 THEN 0::DOUBLE ELSE len(list_filter(v, lambda x: contains(lower(payload), lower(x)))) / len(v)::DOUBLE * 100 END AS rate FROM (
    SELECT f.doc_id, {_LIST} AS v, coalesce(k.payload, '') AS payload FROM field_wide f JOIN kyc k ON f.doc_id = k.doc_id) AS a) AS b""", ("field_wide", "kyc"))
def _(spark, sf):
    return containment_rate(field_frame(spark, sf), qr_frame(spark, sf), ["doc_id"])


# --- registry and faces -------------------------------------------------------------------------------------


def registry_sql() -> str:
    return f"""WITH r AS (SELECT doc_type, upper(regexp_replace(id_number, '[-\\s]', '', 'g')) AS id, lower(trim(name)) AS n, dob AS b, upper(substr(gender, 1, 1)) AS g FROM registry),
c AS (SELECT doc_id, doc_type, upper(regexp_replace(id_number, '[-\\s]', '', 'g')) AS id, lower({strip_sql('name')}) AS n, dob AS b, upper(substr(gender, 1, 1)) AS g FROM claims)
SELECT c.doc_id, r.id IS NOT NULL AS id_found, coalesce(c.n = r.n, false) AS name_verified, coalesce(c.b = r.b, false) AS dob_verified, coalesce(c.g = r.g, false) AS gender_verified,
  coalesce(c.n = r.n AND c.b = r.b AND c.g = r.g, false) AS is_verified FROM c LEFT JOIN r ON c.doc_type = r.doc_type AND c.id = r.id WHERE c.id IS NULL OR NOT regexp_full_match(c.id, 'X{{4,}}[0-9]{{4}}')
UNION ALL
SELECT c.doc_id, count(r.id) > 0, coalesce(bool_or(r.n = c.n), false), coalesce(bool_or(r.b = c.b), false), coalesce(bool_or(r.g = c.g), false),
  coalesce(bool_or(r.n = c.n AND r.b = c.b AND r.g = c.g), false)
FROM c LEFT JOIN r ON c.doc_type = r.doc_type AND right(r.id, 4) = right(c.id, 4) WHERE regexp_full_match(c.id, 'X{{4,}}[0-9]{{4}}') GROUP BY c.doc_id"""


@register("jn9_registry", registry_sql(), ("claims", "registry"))
def _(spark, sf):
    return verify_registry(rel(spark, sf, "claims"), rel(spark, sf, "registry"), ["doc_id"])


@register("jn10_face_match", """
SELECT pair_id, round(score, 3) AS match_score, score > 20 AS matched FROM (
  SELECT p.pair_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) * 100 AS score
  FROM pairs p JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a ON p.left_id = a.vec_id JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON p.right_id = b.vec_id) AS s""", ("pairs",))
def _(spark, sf):
    m = match_faces(rel(spark, sf, "pairs"), rel(spark, sf, "embeddings"), threshold=20.0)
    return m.select("pair_id", F.round("match_score", 3).alias("match_score"), "matched")


# --- format ---------------------------------------------------------------------------------------------------


def _array(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def format_sql(pages: str = "kyc", fields: str = "field_wide", columns=FIELD_COLUMNS) -> str:
    """Over typed texts and their field columns, type decided by the text (CTE typed)."""
    branches = []
    for p in rules.FORMAT_PROFILES:
        present = ", ".join(
            f"CASE WHEN {'f.' + k if k in columns else 'NULL'} IS NOT NULL THEN '{k}' END" for k in p.key_fields)
        branches.append(f"""SELECT k.doc_id, t.document_type, '{p.title}' AS title, {len(p.headers)} AS nh, {p.min_headers} AS mh, {len(p.key_fields)} AS nk,
  list_filter({_array(p.headers)}, lambda h: contains(upper(k.raw_text), h)) AS hs, list_filter([{present}], lambda x: x IS NOT NULL) AS ks,
  regexp_matches(upper(k.raw_text), '{p.number_pattern}') OR coalesce(f.aadhaar_number <> '', false) OR coalesce(f.passport_number <> '', false) OR coalesce(f.dl_number <> '', false) AS number_ok,
  {str(p.has_mrz).lower()} AS has_mrz, {str(p.has_qr).lower()} AS has_qr, coalesce(f.mrz_checksum_valid = 'true', false) OR f.mrz_raw IS NOT NULL AS zone_ok, k.payload IS NOT NULL AS qr_ok
  FROM {pages} k JOIN typed t ON k.doc_id = t.doc_id JOIN {fields} f ON k.doc_id = f.doc_id WHERE t.document_type = '{p.doc_type}'""")
    return "fa AS (" + "\nUNION ALL\n".join(branches) + """),
fb AS (SELECT *, round_even(len(hs) / nh::DOUBLE * 35, 2) + CASE WHEN number_ok THEN 25 ELSE 0 END + round_even(len(ks) / nk::DOUBLE * 25, 2)
  + CASE WHEN has_mrz THEN CASE WHEN zone_ok THEN 15 ELSE 0 END WHEN has_qr THEN CASE WHEN qr_ok THEN 15 ELSE 10 END ELSE 15 END AS points FROM fa),
fc AS (SELECT *, round_even(points, 1) AS score, len(hs) >= mh AS h_ok, len(ks) >= greatest(1, nk // 2) AS k_ok, NOT has_mrz OR zone_ok AS s_ok FROM fb),
report AS (SELECT doc_id, document_type, score, CASE WHEN score >= 80 THEN 'FORMAT_VERIFIED' WHEN score >= 50 THEN 'PARTIAL_MATCH' ELSE 'FORMAT_ANOMALY' END AS status, title,
  array_to_string([h_ok::VARCHAR, number_ok::VARCHAR, k_ok::VARCHAR, s_ok::VARCHAR], ',') AS passed,
  concat('Matched ', len(hs), ' of ', nh, ' standard headers (', CASE WHEN len(hs) > 0 THEN array_to_string(hs, ', ') ELSE 'None' END, ')') AS header_details,
  array_to_string(list_filter([CASE WHEN NOT h_ok THEN 'Header keyword mismatch: missing standard ' || upper(document_type) || ' layout headers.' END,
    CASE WHEN NOT number_ok THEN 'Document number does not match expected format pattern.' END,
    CASE WHEN NOT k_ok THEN 'Missing core feature fields expected in standard ' || upper(document_type) || ' format.' END,
    CASE WHEN NOT s_ok THEN 'Passport/Visa format requires valid MRZ zone.' END], lambda x: x IS NOT NULL), '|') AS anomalies FROM fc
UNION ALL SELECT t.doc_id, document_type, 0, 'UNKNOWN_FORMAT', 'Generic Document Profile', '', NULL, 'Unknown or unclassified document format specification.' FROM typed t WHERE document_type = 'unknown')"""


def reported(spark, sf):
    typed = classify(rel(spark, sf, "kyc"), "raw_text", "payload").select("doc_id", "raw_text", "payload", "document_type")
    both = typed.join(field_frame(spark, sf).select("doc_id", "fields"), "doc_id").withColumn(
        "qr_seen", F.col("payload").isNotNull())
    return format_report(both, qr_detected="qr_seen")


_TYPED_KYC = typed_sql("kyc", "raw_text", "coalesce(payload, '')")


@register("agg9_format_report", f"WITH {_TYPED_KYC}, {format_sql()} SELECT * FROM report", ("kyc", "field_wide"))
def _(spark, sf):
    v = F.col("format_verification")
    return reported(spark, sf).select(
        "doc_id", "document_type", v["format_match_score"].alias("score"), v["format_status"].alias("status"),
        v["sample_format_name"].alias("title"),
        joined(F.transform(v["format_checks"], lambda c: c["passed"].cast("string")), ",").alias("passed"),
        F.get(v["format_checks"], F.lit(0))["details"].alias("header_details"), joined(v["format_anomalies"]).alias("anomalies"))


@register("agg9_format_rollup", f"""WITH {_TYPED_KYC}, {format_sql()}
SELECT document_type, status AS format_status, count(*) AS n_docs, round_even(avg(score), 4) AS mean_score FROM report GROUP BY ALL""", ("kyc", "field_wide"))
def _(spark, sf):
    return format_rollup(reported(spark, sf))


@register("jn7_profile_lookup", f"""WITH p(doc_type, title) AS (VALUES {', '.join(f"('{p.doc_type}', '{p.title}')" for p in rules.FORMAT_PROFILES)})
SELECT c.seq, coalesce(p.title, 'Generic Document Profile') AS sample_format_name, CASE WHEN p.title IS NULL THEN 'UNKNOWN_FORMAT' ELSE 'PROFILED' END AS profile_status
FROM captures c LEFT JOIN p ON {kind_sql('c.doc_type')} = p.doc_type""", ("captures",))
def _(spark, sf):
    return with_profile(rel(spark, sf, "captures"), rules.profile_frame(spark), "doc_type").select(
        "seq", "sample_format_name", "profile_status")
