"""Input relations derived from the given tables by SQL.

The test tables hold no identity documents, so documents, captures, registries
and histories are computed from their columns, over all their rows. The text
runs unchanged in Spark and in the checking engine, unless a relation gives a
second text for the latter (only array explosion differs).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_digit_sql(text: str, length: int) -> str:
    """ICAO check digit of a SQL text expression, as SQL."""
    terms = [
        f"greatest(instr('{ALPHABET}', substr({text}, {i + 1}, 1)) - 1, 0) * {(7, 3, 1)[i % 3]}"
        for i in range(length)
    ]
    return f"cast(({' + '.join(terms)}) % 10 AS STRING)"


def check_digit_spark(text: str, length: int) -> str:
    """The same digit for Spark, as one fold: a term for each character, in several digits of
    several texts, outgrows what Spark compiles for a stage, which then runs interpreted."""
    return (
        f"get(transform(array({text}), t -> cast(aggregate(sequence(1, {length}), 0, (total, i) -> total"
        f" + greatest(instr('{ALPHABET}', substr(t, i, 1)) - 1, 0) * get(array(1, 7, 3), i % 3)) % 10 AS STRING)), 0)"
    )


@dataclass(frozen=True)
class Relation:
    needs: tuple[str, ...]
    sql: str
    duck: str | None = None
    #: Tables whose rows take long work here, with the key to deal them out by (None: by turns).
    spread: tuple[tuple[str, str | None], ...] = ()


BASE = """
SELECT c_custkey AS doc_id,
  lpad(cast((c_custkey * 7919 + 234567890123) % 1000000000000 AS STRING), 12, '0') AS uid,
  concat(CASE c_custkey % 5 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Ravi' WHEN 2 THEN 'Meena' WHEN 3 THEN 'Imran' ELSE 'Leela' END, ' ',
         CASE c_custkey % 3 WHEN 0 THEN 'Rao' WHEN 1 THEN 'Das' ELSE 'Khan' END) AS nm,
  concat(lpad(cast(c_custkey % 28 + 1 AS STRING), 2, '0'), '/', lpad(cast(c_custkey % 12 + 1 AS STRING), 2, '0'), '/',
         cast(1950 + c_custkey % 55 AS STRING)) AS dob,
  CASE WHEN c_custkey % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS sex,
  lpad(cast(c_custkey % 10000000 AS STRING), 7, '0') AS n7
FROM {customer}
"""

# zone lines with right digits for half of the documents, and for some a lost letter
def zone_sql(check_digit) -> str:
    return f"""
SELECT doc_id, number9, number_digit, dob6, dob_digit, sex1, line1,
  concat(CASE WHEN doc_id % 17 = 3 THEN substr(number9, 2, 8) ELSE number9 END, number_digit, 'IND', dob6, dob_digit, sex1,
         '3001019<<<<<<<<<<<<<<<',
         CASE WHEN doc_id % 2 = 0 THEN {check_digit("composite", 39)} ELSE '0' END) AS line2
FROM (
  SELECT *, concat(number9, number_digit, dob6, dob_digit, '3001019<<<<<<<<<<<<<<<') AS composite
  FROM (
    SELECT *,
      CASE WHEN doc_id % 2 = 0 THEN {check_digit("number9", 9)} ELSE '0' END AS number_digit,
      CASE WHEN doc_id % 2 = 0 THEN {check_digit("dob6", 6)} ELSE '0' END AS dob_digit
    FROM (
      SELECT doc_id, concat('A', n7, '<') AS number9,
        concat(substr(dob, 9, 2), substr(dob, 4, 2), substr(dob, 1, 2)) AS dob6, substr(sex, 1, 1) AS sex1,
        rpad(concat(CASE WHEN doc_id % 5 = 2 THEN 'V<IND' ELSE 'P<IND' END,
             upper(split_part(nm, ' ', 2)), '<<', upper(split_part(nm, ' ', 1)), '<'), 44, '<') AS line1
      FROM {{base}}) AS a) AS b) AS c
"""


ZONE, ZONE_DUCK = zone_sql(check_digit_spark), zone_sql(check_digit_sql).replace("{base}", "base")

KYC = """
SELECT b.doc_id, 1 AS page_number, b.uid, b.nm, b.dob, b.sex, b.n7,
  concat('scan_', cast(b.doc_id AS STRING), CASE b.doc_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.pdf'
         WHEN 3 THEN '.txt' WHEN 4 THEN '.webp' ELSE '' END) AS file_name,
  CASE WHEN b.doc_id % 3 <> 0 THEN cast(NULL AS STRING)
       WHEN b.doc_id % 21 = 3 THEN concat('PLAIN ', b.uid)
       WHEN b.doc_id % 7 = 0 THEN concat('<x uid="', b.uid, '" name="Someone Else" dob="', b.dob, '"/>')
       WHEN b.doc_id % 2 = 0 THEN concat('<x uid="', b.uid, '" name="', b.nm, '" dob="', b.dob, '" gender="', substr(b.sex, 1, 1), '"/>')
       ELSE concat('<x name="', b.nm, '" dob="', b.dob, '" pc="411001"/>') END AS payload,
  CASE b.doc_id % 5
  WHEN 0 THEN concat_ws(chr(10), 'GOVERNMENT OF INDIA',
    CASE WHEN b.doc_id % 2 = 0 THEN 'भारत सरकार' END,
    CASE b.doc_id % 7 WHEN 0 THEN concat('Name: ', b.nm) WHEN 1 THEN concat('विलास / ', b.nm) ELSE b.nm END,
    CASE b.doc_id % 11 WHEN 0 THEN concat('Year of Birth: ', substr(b.dob, 7, 4))
                       WHEN 1 THEN concat(replace(b.dob, '/', '-'), ' ') ELSE concat('DOB: ', b.dob) END,
    CASE WHEN b.doc_id % 13 = 0 THEN 'TRANSGENDER' WHEN b.doc_id % 13 = 1 THEN 'पुरुष' ELSE concat('x/ ', b.sex) END,
    CASE WHEN b.doc_id % 9 = 0 THEN concat('XXXX XXXX ', substr(b.uid, 9, 4))
         WHEN b.doc_id % 9 = 1 THEN b.uid
         WHEN b.doc_id % 9 = 2 THEN 'no number'
         ELSE concat(substr(b.uid, 1, 4), ' ', substr(b.uid, 5, 4), ' ', substr(b.uid, 9, 4)) END,
    CASE b.doc_id % 4 WHEN 0 THEN concat('Address: 12 MG Road,', chr(10), 'Pune 411001 Maharashtra')
                      WHEN 1 THEN concat('S/O: Mohan Das', chr(10), 'Street  5') END)
  WHEN 1 THEN concat_ws(chr(10), 'PASSPORT REPUBLIC OF INDIA',
    CASE WHEN b.doc_id % 7 = 0 THEN concat('Passport No: A', b.n7) END,
    concat('Surname: ', split_part(b.nm, ' ', 2)), concat('Given Name: ', split_part(b.nm, ' ', 1)),
    CASE WHEN b.doc_id % 11 = 0 THEN concat('born ', substr(b.dob, 1, 2), chr(10), substr(b.dob, 7, 4)) ELSE concat('DOB: ', b.dob) END,
    concat('Sex: ', substr(b.sex, 1, 1)),
    CASE WHEN b.doc_id % 4 = 0 THEN 'Date of Issue: 01.02.2015' WHEN b.doc_id % 4 = 1 THEN 'issued 03.2016' END,
    CASE WHEN b.doc_id % 6 = 1 THEN 'Date of Expiry: 31-01-2025' END,
    CASE WHEN b.doc_id % 9 = 1 THEN 'Place of Birth: NASHIK' WHEN b.doc_id % 9 = 2 THEN 'MADURAI, IND' WHEN b.doc_id % 9 = 3 THEN 'chennai' END,
    CASE WHEN b.doc_id % 8 = 1 THEN 'Place of Issue: MUMBAI' WHEN b.doc_id % 8 = 2 THEN 'RPO Pune' END,
    CASE WHEN b.doc_id % 10 = 1 THEN 'TAMIL: abc' WHEN b.doc_id % 10 = 6 THEN 'Signature: Someone' END,
    CASE WHEN b.doc_id % 3 <> 0 THEN concat(z.line1, chr(10), z.line2) END)
  WHEN 2 THEN concat_ws(chr(10), 'INDIAN VISA', concat('VISA TYPE ', CASE b.doc_id % 4 WHEN 0 THEN 'TOURIST' WHEN 1 THEN 'BUSINESS' WHEN 2 THEN 'STUDENT' ELSE 'OTHER' END),
    concat('Name: ', b.nm), concat('NO OF ENTRIES ', CASE b.doc_id % 3 WHEN 0 THEN 'MULTIPLE' WHEN 1 THEN 'SINGLE' ELSE 'DOUBLE' END),
    CASE WHEN b.doc_id % 7 <> 0 THEN concat('VISA NO: V', b.n7) END,
    CASE WHEN b.doc_id % 2 = 0 THEN concat(z.line2, chr(10), z.line1) END)
  WHEN 3 THEN concat_ws(chr(10), 'UNION DRIVING LICENCE',
    CASE b.doc_id % 4 WHEN 0 THEN concat('DL NO TS0082020', b.n7) WHEN 1 THEN concat('MH-12-2011-', b.n7)
                      WHEN 2 THEN concat('DL No: GJ/', b.n7, '/77') ELSE concat('no ', b.n7) END,
    CASE WHEN b.doc_id % 3 = 0 THEN concat('Name: ', b.nm) ELSE b.nm END,
    concat('DOB: ', b.dob), 'S/O: Suresh Varma',
    CASE WHEN b.doc_id % 2 = 0 THEN 'Issue Date: 05-06-2012' END,
    CASE WHEN b.doc_id % 7 < 4 THEN concat('Validity: 04.06.', cast(2020 + b.doc_id % 15 AS STRING)) END,
    CASE WHEN b.doc_id % 6 = 0 THEN 'Blood Group: B+' WHEN b.doc_id % 6 = 3 THEN 'BG AB+' END,
    CASE WHEN b.doc_id % 4 < 2 THEN 'MCWG LMV' END,
    CASE WHEN b.doc_id % 8 = 3 THEN concat('Address: 7 Hill St', chr(10), '500001') END)
  ELSE concat('plain note ', b.n7, chr(10), 'second line', chr(10), 'ok', chr(10), 'third line here', chr(10), 'fourth', chr(10), 'fifth one') END AS raw_text
FROM {base} b JOIN {zone} z ON b.doc_id = z.doc_id
"""

CORPUS = """
SELECT doc_id, raw_text, coalesce(payload, '') AS payload FROM {kyc}
UNION ALL
SELECT doc_id + 1000000000000 AS doc_id, text AS raw_text, '' AS payload FROM {documents}
"""

_BLOCK_COLUMNS = """
  doc_id, 1 AS page_number, 'tesseract' AS engine, cast(line_num AS BIGINT) * 100000 + pos AS seq, word AS text,
  cast((doc_id * 31 + (cast(line_num AS BIGINT) * 100000 + pos) * 17) % 101 AS DOUBLE) AS confidence,
  cast(floor(line_num / 10) AS INT) AS block_num, cast(line_num AS INT) AS line_num
"""

BLOCKS = f"""
SELECT {_BLOCK_COLUMNS} FROM (
  SELECT doc_id, line_num, pos, word FROM {{documents}}
  LATERAL VIEW posexplode(split(text, chr(10))) l AS line_num, line
  LATERAL VIEW posexplode(split(line, ' ')) w AS pos, word) AS t
"""
BLOCKS_DUCK = f"""
SELECT {_BLOCK_COLUMNS} FROM (
  SELECT doc_id, line_num, pos, words[pos + 1] AS word FROM (
    SELECT doc_id, line_num, words, unnest(range(len(words))) AS pos FROM (
      SELECT doc_id, line_num, string_split(lines[line_num + 1], ' ') AS words FROM (
        SELECT doc_id, lines, unnest(range(len(lines))) AS line_num FROM (
          SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) AS a) AS b) AS c) AS d) AS t
"""

# one block per line, without line ids
LINE_BLOCKS = """
SELECT doc_id, 1 AS page_number, 'paddleocr' AS engine, cast(line_num AS BIGINT) AS seq, line AS text,
  cast((doc_id * 7 + line_num * 13) % 101 AS DOUBLE) AS confidence, cast(NULL AS INT) AS block_num, cast(NULL AS INT) AS line_num
FROM {documents} LATERAL VIEW posexplode(split(text, chr(10))) l AS line_num, line
"""
LINE_BLOCKS_DUCK = """
SELECT doc_id, 1 AS page_number, 'paddleocr' AS engine, cast(i AS BIGINT) AS seq, lines[i + 1] AS text,
  cast((doc_id * 7 + i * 13) % 101 AS DOUBLE) AS confidence, cast(NULL AS INT) AS block_num, cast(NULL AS INT) AS line_num
FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) AS a) AS t
"""

# what a batch job takes in: identity texts, some with the name where only its own block tells it, and prose
INBOX = """
SELECT doc_id, 1 AS page_number, concat('in/', file_name) AS file_name, payload, CASE WHEN doc_id % 35 = 10
  THEN concat_ws(chr(10), 'GOVERNMENT OF INDIA', concat('DOB: ', dob), sex, uid, nm) ELSE raw_text END AS raw_text FROM {kyc}
UNION ALL
SELECT doc_id + 1000000000000 AS doc_id, 1 AS page_number, concat('doc', cast(doc_id AS STRING), '.jpg') AS file_name, cast(NULL AS STRING) AS payload, text AS raw_text FROM {documents}
"""
# words of one engine, and for every other page whole lines of a better one
INBOX_BLOCKS = BLOCKS.replace("{documents}", "{inbox}").replace("split(text", "split(raw_text") + """
UNION ALL
SELECT doc_id, 1 AS page_number, 'paddleocr' AS engine, cast(line_num AS BIGINT) AS seq, line AS text,
  cast((doc_id * 7 + line_num * 13) % 101 AS DOUBLE) AS confidence, cast(NULL AS INT) AS block_num, cast(NULL AS INT) AS line_num
FROM {inbox} LATERAL VIEW posexplode(split(raw_text, chr(10))) l AS line_num, line WHERE doc_id % 2 = 0
"""
INBOX_BLOCKS_DUCK = BLOCKS_DUCK.replace("FROM documents", "FROM inbox").replace("split(text", "split(raw_text") + """
UNION ALL
SELECT doc_id, 1 AS page_number, 'paddleocr' AS engine, cast(i AS BIGINT) AS seq, lines[i + 1] AS text,
  cast((doc_id * 7 + i * 13) % 101 AS DOUBLE) AS confidence, cast(NULL AS INT) AS block_num, cast(NULL AS INT) AS line_num
FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (
  SELECT doc_id, string_split(raw_text, chr(10)) AS lines FROM inbox WHERE doc_id % 2 = 0) AS a) AS t
"""

# scanned sides: fronts, some scanned twice, some missing; backs with the address, some with a payload
SIDE_SCANS = """
SELECT doc_id AS session_id, doc_id * 10 + 1 AS seq, 'front' AS side, raw_text, cast(NULL AS STRING) AS payload, concat('image/', cast(doc_id AS STRING), '_front.jpg') AS file_name
FROM {kyc} WHERE doc_id % 11 <> 4
UNION ALL
SELECT doc_id AS session_id, doc_id * 10 + 2 AS seq, 'back' AS side,
  concat_ws(chr(10), 'Unique Identification', CASE WHEN doc_id % 2 = 0 THEN concat('Address: 5 Lake View', chr(10), 'Nagpur 440001') END, concat('MH-12-2011-', n7),
    CASE WHEN doc_id % 4 = 1 THEN 'Blood Group: O+' END) AS raw_text,
  payload, concat('image/', cast(doc_id AS STRING), '_back.jpg') AS file_name
FROM {kyc} WHERE doc_id % 7 <> 5
UNION ALL
SELECT doc_id AS session_id, doc_id * 10 + 3 AS seq, 'front' AS side, 'GOVERNMENT OF INDIA' AS raw_text, cast(NULL AS STRING) AS payload, 'image/again.jpg' AS file_name
FROM {kyc} WHERE doc_id % 6 = 1
"""

OCR = """
SELECT doc_id, 1 AS page_number, 'paddleocr' AS engine, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN ' too short' ELSE text END AS raw_text, cast(doc_id % 100 AS DOUBLE) AS confidence_score FROM {documents}
UNION ALL
SELECT doc_id, 1 AS page_number, 'easyocr' AS engine, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'ten chars.' ELSE text END AS raw_text, cast(doc_id % 90 AS DOUBLE) AS confidence_score FROM {documents}
UNION ALL
SELECT doc_id, 1 AS page_number, 'tesseract' AS engine, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 7 = 1 THEN 'eleven char' ELSE text END AS raw_text, cast(doc_id % 80 AS DOUBLE) AS confidence_score FROM {documents}
"""

BOXES = """
SELECT l_orderkey AS doc_id, 1 AS page_number, cast(l_linenumber AS BIGINT) AS seq,
  CASE l_partkey % 7 WHEN 0 THEN 'Address' WHEN 1 THEN 'Pin 560001' WHEN 2 THEN 'P<INDRAO<<ASHA' WHEN 3 THEN 'ABCDEFGH1234'
       WHEN 4 THEN 'hello' WHEN 5 THEN 'S/O Ram' ELSE 'कुछ' END AS text,
  cast((l_partkey * 7) % 700 AS INT) AS x1, cast((l_suppkey * 11 + l_linenumber * 131) % 900 AS INT) AS y1,
  cast((l_partkey * 7) % 700 + 20 + l_linenumber * 15 AS INT) AS x2,
  cast((l_suppkey * 11 + l_linenumber * 131) % 900 + 12 + l_quantity % 40 AS INT) AS y2
FROM {lineitem}
"""
BOX_PAGES = """
SELECT o_orderkey AS doc_id, 1 AS page_number, cast(500 + o_orderkey % 400 AS INT) AS width, cast(500 + o_custkey % 600 AS INT) AS height,
  CASE o_orderkey % 5 WHEN 0 THEN 'full_e_aadhaar' WHEN 1 THEN 'cut_out_dual_card' WHEN 2 THEN 'stacked_dual_card'
       WHEN 3 THEN 'single_card_back' ELSE 'single_card_front' END AS subtype
FROM {orders}
"""
PHOTOS = """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS doc_id, cast(o_custkey % 400 AS INT) AS x1, cast(o_custkey % 500 AS INT) AS y1,
  cast(o_custkey % 400 + 180 AS INT) AS x2, cast(o_custkey % 500 + 240 AS INT) AS y2
FROM {orders}
UNION ALL
SELECT o_orderkey AS doc_id, 420 AS x1, 520 AS y1, 600 AS x2, cast(700 + o_custkey % 100 AS INT) AS y2 FROM {orders} WHERE o_orderkey % 3 = 1
"""

PAGE_SIZES = """
SELECT p_partkey AS doc_id, cast(300 + p_partkey % 700 AS INT) AS width, cast(300 + p_size * 13 AS INT) AS height,
  p_partkey % 3 = 0 AS has_face,
  CASE p_partkey % 6 WHEN 0 THEN 'Enrolment No 12' WHEN 1 THEN 'S/O Ram PIN 1' WHEN 2 THEN 'to: someone' ELSE p_name END AS raw_text,
  CASE p_partkey % 4 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'Passport' WHEN 2 THEN 'visa' ELSE 'dl' END AS doc_type
FROM {part}
"""

CAPTURES = """
SELECT user_id AS session_id, concat('c', cast(event_id AS STRING)) AS capture_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'passport' WHEN 'signup' THEN 'aadhaar' WHEN 'click' THEN 'dl' WHEN 'error' THEN 'visa' ELSE 'bank_statement' END AS doc_type,
  CASE event_id % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'front' WHEN 2 THEN 'back' WHEN 3 THEN 'front' ELSE 'back' END AS side,
  concat('File ', cast(event_id % 97 AS STRING), '-', event_type) AS file_name,
  event_id % 11 = 0 OR user_id % 7 = 0 AS suspicious, cast(floor(value) % 101 AS INT) AS quality, cast(ts AS TIMESTAMP) AS captured_at
FROM {events}
"""

CHECKLIST = """
SELECT user_id AS session_id,
  CASE event_id % 8 WHEN 0 THEN 'passport' WHEN 1 THEN 'proof_of_address' WHEN 2 THEN 'bank_statement' WHEN 3 THEN 'employment_letter'
       WHEN 4 THEN 'tax_documents' WHEN 5 THEN 'birth_certificate' WHEN 6 THEN 'visa' ELSE 'residence_permit' END AS doc_type,
  CASE event_type WHEN 'view' THEN 'scanned' WHEN 'signup' THEN 'na' WHEN 'purchase' THEN 'scanned' ELSE 'unchecked' END AS status,
  concat('doc_', cast(event_id AS STRING)) AS file_name
FROM {events}
"""

# page results of sessions, for merging sides
SIDE_RESULTS = """
SELECT user_id AS session_id, event_id AS seq,
  CASE WHEN user_id % 2 = 0 THEN 'aadhaar' WHEN event_id % 4 = 0 THEN 'driving_licence' ELSE 'aadhaar' END AS document_type,
  'Card' AS document_name,
  CASE WHEN event_id % 3 = 0 THEN concat('Name ', cast(event_id AS STRING)) WHEN event_id % 3 = 1 THEN '' END AS name,
  CASE WHEN event_id % 6 = 0 THEN '01/01/1990' END AS dob,
  CASE WHEN event_id % 9 = 0 THEN 'MALE' END AS gender,
  CASE WHEN event_id % 4 = 1 OR event_id % 6 = 0 THEN concat('Street ', cast(event_id AS STRING)) END AS address,
  event_id % 10 = 3 AS qr_detected,
  CASE WHEN event_id % 10 = 3 THEN concat('qr', cast(event_id AS STRING)) END AS qr_data,
  concat('text ', cast(event_id AS STRING)) AS raw_ocr_text
FROM {events}
"""

HISTORY = """
SELECT concat('h', lpad(cast(event_id AS STRING), 12, '0')) AS id, user_id AS holder,
  CASE event_type WHEN 'view' THEN 'passport' WHEN 'signup' THEN 'aadhaar' WHEN 'click' THEN 'driving_licence' WHEN 'error' THEN 'visa' ELSE 'unknown' END AS document_type,
  CASE WHEN value < 40 THEN 'LOW' WHEN value < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  value AS risk_score, cast(ts AS TIMESTAMP) AS timestamp,
  concat('{{"riskLevel":"', CASE WHEN value < 40 THEN 'ACCEPTED' ELSE 'REVIEW REQUIRED' END, '","riskScore":', cast(event_id % 100 AS STRING),
         ',"checks":[{{"id":"ocr","title":"OCR extracted","status":"passed","detail":"d"}},{{"id":"face","title":"Face","status":"',
         CASE WHEN event_id % 3 = 0 THEN 'warning' ELSE 'passed' END, '","detail":"d"}}',
         CASE WHEN event_id % 5 = 0 THEN ',{{"id":"doc","title":"Doc","status":"failed","detail":"d"}}' ELSE '' END, ']}}') AS result,
  concat('{{"name":"n', cast(user_id AS STRING), '","k":"', cast(event_id % 7 AS STRING), '"}}') AS extracted_fields,
  concat('{{"front":"image/', cast(event_id AS STRING), '.jpg"}}') AS saved_paths
FROM {events}
"""

USERS = """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM {customer}
"""
RECORDS = """
SELECT o_orderkey AS record_id, o_custkey AS user_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'passport' WHEN 2 THEN 'visa' ELSE 'dl' END AS doc_type,
  concat('id-', cast(o_orderkey % 5000 AS STRING)) AS id_number,
  CASE WHEN o_custkey % 3 = 0 THEN concat('Person  ', cast(o_custkey AS STRING)) ELSE concat('Person ', cast(o_custkey + o_orderkey % 2 AS STRING)) END AS name,
  concat('01/01/', cast(1960 + (o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) % 40 AS STRING)) AS dob,
  o_totalprice % 100 AS risk_score, cast(o_orderdate AS DATE) AS issue_date, o_orderstatus = 'F' AS is_verified
FROM {orders}
"""

REGISTRY = """
SELECT CASE doc_id % 5 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'passport' WHEN 2 THEN 'visa' ELSE 'driving_licence' END AS doc_type,
  concat(CASE doc_id % 5 WHEN 0 THEN uid WHEN 1 THEN concat('A', n7) WHEN 2 THEN CASE WHEN doc_id % 10 = 2 THEN concat('V', n7) ELSE concat('VX', n7) END
    ELSE concat('TS-0082020-', n7) END, CASE WHEN doc_id % 4 = 0 THEN 'Q' ELSE '' END) AS id_number,
  CASE WHEN doc_id % 9 = 0 THEN 'Other Person' ELSE nm END AS name, dob,
  CASE WHEN doc_id % 10 = 0 THEN 'Female' ELSE sex END AS gender, 'VALID' AS status
FROM {base}
"""
CLAIMS = """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'passport' WHEN 2 THEN 'visa' ELSE 'driving_licence' END AS doc_type,
  CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN concat('XXXX XXXX ', substr(uid, 9, 4)) ELSE concat(substr(uid, 1, 4), ' ', substr(uid, 5, 8)) END
       WHEN 1 THEN CASE WHEN doc_id % 11 <> 3 THEN concat('a', n7) END WHEN 2 THEN concat('VX', n7) ELSE concat('TS0082020', n7) END AS id_number,
  concat(' ', upper(nm)) AS name, dob, sex AS gender
FROM {base}
"""

# extracted values, one column per field
FIELD_WIDE = """
SELECT c.doc_id, CASE WHEN c.doc_type = 'driving_licence' THEN 'driving_license' ELSE c.doc_type END AS doc_type,
  CASE WHEN c.doc_id % 7 = 0 THEN '' WHEN c.doc_id % 7 = 1 THEN cast(NULL AS STRING) ELSE b.nm END AS name,
  CASE WHEN c.doc_id % 8 <> 0 THEN b.dob END AS dob,
  CASE WHEN c.doc_type = 'aadhaar' THEN b.sex END AS gender,
  CASE WHEN c.doc_type = 'passport' THEN substr(b.sex, 1, 1) END AS sex,
  CASE WHEN c.doc_type = 'aadhaar' AND c.doc_id % 9 <> 2 THEN CASE WHEN c.doc_id % 9 = 1 THEN concat('XXXX XXXX ', substr(b.uid, 9, 4)) ELSE b.uid END END AS aadhaar_number,
  CASE WHEN c.doc_type = 'passport' AND c.doc_id % 9 <> 2 THEN concat('A', b.n7) END AS passport_number,
  CASE WHEN c.doc_type = 'visa' AND c.doc_id % 9 <> 2 THEN concat('V', b.n7) END AS visa_number,
  CASE WHEN c.doc_type = 'driving_licence' AND c.doc_id % 9 <> 2 THEN concat('TS', substr(b.n7, 1, CASE WHEN c.doc_id % 2 = 0 THEN 7 ELSE 5 END), CASE WHEN c.doc_id % 9 = 3 THEN '' ELSE '2020' END) END AS dl_number,
  CASE WHEN c.doc_type = 'passport' AND c.doc_id % 3 = 0 THEN 'PUNE' END AS place_of_birth,
  CASE WHEN c.doc_type = 'passport' AND c.doc_id % 4 = 1 THEN '01/02/2015' END AS date_of_issue,
  CASE WHEN c.doc_type = 'driving_licence' AND c.doc_id % 4 = 1 THEN '03/02/2015' END AS issue_date,
  CASE WHEN c.doc_type = 'driving_licence' THEN concat('05/06/', cast(2015 + c.doc_id % 20 AS STRING)) END AS validity_nt,
  CASE WHEN c.doc_type IN ('passport', 'visa') AND c.doc_id % 5 <> 4 THEN concat('31/12/', cast(2015 + c.doc_id % 20 AS STRING)) END AS date_of_expiry,
  CASE WHEN c.doc_type IN ('passport', 'visa') AND c.doc_id % 3 = 1 THEN concat('P<IND', chr(10), 'A', b.n7) END AS mrz_raw,
  CASE WHEN c.doc_id % 3 = 2 THEN '12 MG Road' END AS address,
  CASE WHEN c.doc_type = 'visa' THEN 'TOURIST' END AS visa_type,
  CASE WHEN c.doc_type = 'visa' AND c.doc_id % 2 = 0 THEN 'MULTIPLE' END AS no_of_entries,
  CASE WHEN c.doc_id % 5 = 1 AND c.doc_id % 2 = 0 THEN 'true' WHEN c.doc_id % 5 = 1 THEN 'false' END AS mrz_checksum_valid,
  CASE WHEN c.doc_type = 'driving_licence' AND c.doc_id % 6 = 3 THEN 'B+' END AS blood_group
FROM {claims} c JOIN {base} b ON c.doc_id = b.doc_id
"""
FIELD_COLUMNS = (
    "name", "dob", "gender", "sex", "aadhaar_number", "passport_number", "visa_number", "dl_number",
    "place_of_birth", "date_of_issue", "issue_date", "validity_nt", "date_of_expiry", "mrz_raw", "address",
    "visa_type", "no_of_entries", "mrz_checksum_valid", "blood_group",
)

PAIRS = """
SELECT vec_id AS pair_id, vec_id AS left_id, vec_id + 1 AS right_id FROM {embeddings}
"""

# users tied by records: a third share one number, the others hang together in chains of sixteen
TIED_RECORDS = """
SELECT c_custkey AS user_id, 'aadhaar' AS doc_type,
  CASE WHEN c_custkey % 3 = 0 THEN 'hot-1 1' ELSE concat('a ', cast(floor(c_custkey / 3) AS INT)) END AS id_number,
  concat('Person ', c_custkey) AS name, '01/01/1980' AS dob
FROM {customer}
UNION ALL
SELECT c_custkey AS user_id, 'passport' AS doc_type, cast(NULL AS STRING) AS id_number,
  concat('Chain  ', cast(floor(c_custkey / 3) AS INT) + c_custkey % 3 - 1) AS name, '02/02/1990' AS dob
FROM {customer} WHERE c_custkey % 3 = 1 AND cast(floor(c_custkey / 3) AS INT) % 8 <> 0 OR c_custkey % 3 = 2
UNION ALL
SELECT c_custkey AS user_id, 'visa' AS doc_type, '' AS id_number, 'No Date' AS name, cast(NULL AS STRING) AS dob FROM {customer} WHERE c_custkey % 5 = 0
"""

# another picture of the same face: the stored vector with a quarter of the next one
PROBES = """
SELECT a.vec_id AS probe_id, zip_with(a.embedding, b.embedding, (x, y) -> cast(x AS DOUBLE) + 0.25D * cast(y AS DOUBLE)) AS embedding
FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1
"""
PROBES_DUCK = """
SELECT a.vec_id AS probe_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] + 0.25::DOUBLE * z[2]) AS embedding
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""

# registry rows that replace one another; a third of them under one number
REGISTRY_VERSIONS = """
SELECT 'passport' AS doc_type, CASE WHEN doc_id % 3 = 0 THEN 'HOT-0001' ELSE concat('A-', n7) END AS id_number,
  CASE WHEN (doc_id + v) % 4 = 0 THEN 'Other Person' ELSE nm END AS name, dob, sex AS gender,
  DATE '2020-01-01' + cast((doc_id * 37 + v * 411) % 1500 AS INT) AS valid_from,
  CASE WHEN doc_id % 5 = 0 THEN DATE '2020-04-01' + cast((doc_id * 37 + v * 411) % 1500 AS INT) END AS valid_until
FROM {base} CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 AS v UNION ALL SELECT 2 AS v) AS w
"""
DATED_CLAIMS = """
SELECT doc_id, 'passport' AS doc_type, CASE WHEN doc_id % 3 = 0 THEN 'hot 0001' WHEN doc_id % 31 <> 1 THEN concat('a', n7) END AS id_number,
  concat(' ', upper(nm)) AS name, dob, sex AS gender,
  CASE WHEN doc_id % 29 <> 0 THEN DATE '2020-01-01' + cast((doc_id * 53) % 1600 AS INT) END AS captured_at
FROM {base}
"""

# zones with look-alikes in place of what was printed
MISREAD_ZONES = """
SELECT doc_id, line2 AS printed, CASE doc_id % 12
  WHEN 2 THEN concat(substr(line2, 1, 1), translate(substr(line2, 2, 3), '0158', 'OISB'), substr(line2, 5))
  WHEN 4 THEN concat(substr(line2, 1, 13), translate(substr(line2, 14, 6), '0158', 'OISB'), substr(line2, 20))
  WHEN 6 THEN concat(substr(line2, 1, 21), translate(substr(line2, 22, 7), '01', 'OI'), substr(line2, 29))
  WHEN 8 THEN concat(translate(substr(line2, 1, 10), '18', 'IB'), substr(line2, 11, 33), translate(substr(line2, 44, 1), '0158', 'OISB'))
  WHEN 10 THEN concat(substr(line2, 1, 43), CASE WHEN substr(line2, 44, 1) = '3' THEN '4' ELSE '3' END)
  ELSE line2 END AS line2
FROM {zone}
"""

# history whose JSON has keys that no schema knows, and every thirteenth text cut short
LOOSE_HISTORY = """
SELECT id, document_type, CASE WHEN cast(substr(id, 2) AS BIGINT) % 13 = 0 THEN substr(result, 1, 40)
  ELSE concat(substr(result, 1, length(result) - 1), ',"extra":{{"deep":[1,{{"k":"', id, '"}}]}}}}') END AS result
FROM {history}
"""

RELATIONS: dict[str, Relation] = {
    "base": Relation(("customer",), BASE, spread=(("customer", "c_custkey"),)),
    "zone": Relation(("base",), ZONE, ZONE_DUCK),
    "kyc": Relation(("base", "zone"), KYC),
    "corpus": Relation(("kyc", "documents"), CORPUS, spread=(("documents", None),)),
    "blocks": Relation(("documents",), BLOCKS, BLOCKS_DUCK),
    "line_blocks": Relation(("documents",), LINE_BLOCKS, LINE_BLOCKS_DUCK),
    "inbox": Relation(("kyc", "documents"), INBOX, spread=(("documents", None),)),
    "inbox_blocks": Relation(("inbox",), INBOX_BLOCKS, INBOX_BLOCKS_DUCK),
    "side_scans": Relation(("kyc",), SIDE_SCANS),
    "ocr": Relation(("documents",), OCR),
    "boxes": Relation(("lineitem",), BOXES),
    "box_pages": Relation(("orders",), BOX_PAGES),
    "photos": Relation(("orders",), PHOTOS),
    "page_sizes": Relation(("part",), PAGE_SIZES),
    "captures": Relation(("events",), CAPTURES),
    "checklist": Relation(("events",), CHECKLIST),
    "side_results": Relation(("events",), SIDE_RESULTS),
    "history": Relation(("events",), HISTORY),
    "users": Relation(("customer",), USERS),
    "records": Relation(("orders",), RECORDS),
    "registry": Relation(("base",), REGISTRY),
    "claims": Relation(("base",), CLAIMS),
    "field_wide": Relation(("claims", "base"), FIELD_WIDE),
    "pairs": Relation(("embeddings",), PAIRS),
    "loose_history": Relation(("history",), LOOSE_HISTORY),
    "tied_records": Relation(("customer",), TIED_RECORDS),
    "probes": Relation(("embeddings",), PROBES, PROBES_DUCK),
    "registry_versions": Relation(("base",), REGISTRY_VERSIONS),
    "dated_claims": Relation(("base",), DATED_CLAIMS),
    "misread_zones": Relation(("zone",), MISREAD_ZONES),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """The rows dealt to as many tasks as a shuffle has. A file of one row group is one task's
    scan, and without this all work on its rows would be that task's."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key) if key else df.repartition(parts)


def relation(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table or a derived relation as a DataFrame (lazy, one plan)."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    known = {} if known is None else known  # each relation is built once a call
    rel = RELATIONS[name]
    for n in rel.needs:
        if n not in known:
            known[n] = relation(spark, sf_dir, n, known)
    inputs = {n: known[n] for n in rel.needs} | {n: spread(known[n], key) for n, key in rel.spread}
    return spark.sql(rel.sql, **inputs)


def with_relations(*names: str) -> str:
    """The same relations as a WITH clause of the checking SQL."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        rel = RELATIONS[name]
        for n in rel.needs:
            add(n)
        done[name] = rel.duck or rel.sql.format(**{n: n for n in rel.needs})

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in done.items())
