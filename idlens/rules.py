"""Rule data: fixed values that results depend on, plus loaders for user rules.

Everything here is small and constant (tens of rows), so it is compiled into
expressions or broadcast; it never grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: document classes, in tie-breaking order ---------------------


@dataclass(frozen=True)
class Bonus:
    """Points added once when any of the literals or patterns occurs."""

    points: int
    literals: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ClassRule:
    doc_type: str
    title: str
    keyword_points: int
    keywords: tuple[str, ...]
    bonuses: tuple[Bonus, ...] = field(default_factory=tuple)


CLASS_RULES = (
    ClassRule(
        "aadhaar",
        "Aadhaar Card",
        20,
        (
            "UNIQUE IDENTIFICATION AUTHORITY OF INDIA",
            "GOVERNMENT OF INDIA",
            "BHARAT SARKAR",
            "ENROLMENT",
            "VID:",
            "AADHAAR",
            "HELP@UIDAI",
            "MERA AADHAAR",
            "AMADHAAR",
            "DOB:",
            "MALE",
            "FEMALE",
        ),
        (
            Bonus(50, (), (r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b", r"\b[X0-9]{4}\s?[X0-9]{4}\s?[0-9]{4}\b")),
            Bonus(40, ("AADHAAR", "UID")),
        ),
    ),
    ClassRule(
        "passport",
        "Indian Passport",
        20,
        (
            "PASSPORT",
            "PASSPORT NO",
            "REPUBLIC OF INDIA",
            "TYPE P",
            "CODE IND",
            "GIVEN NAME",
            "SURNAME",
            "PLACE OF BIRTH",
            "PLACE OF ISSUE",
            "P<IND",
        ),
        (
            Bonus(60, ("P<IND", "PASSPORT"), (r"\bP<[A-Z0-9<]{3}",)),
            Bonus(40, (), (r"\b[A-Z]{1,2}[0-9]{7}\b",)),
            Bonus(40, ("PASSPORT",)),
        ),
    ),
    ClassRule(
        "visa",
        "Indian Visa",
        25,
        (
            "INDIAN VISA",
            "VISA TYPE",
            "NO OF ENTRIES",
            "SPECIAL ENDORSEMENT",
            "DATE OF ISSUE",
            "DATE OF EXPIRY",
            "TOURIST",
            "VTIND",
            "V<IND",
            "CHANGE OF PURPOSE NOT ALLOWED",
        ),
        (Bonus(60, ("VTIND", "V<IND", "INDIAN VISA")), Bonus(40, ("VISA",))),
    ),
    ClassRule(
        "driving_licence",
        "Driving Licence",
        25,
        (
            "DRIVING LICENCE",
            "UNION DRIVING LICENCE",
            "LICENCING AUTHORITY",
            "CLASS OF VEHICLE",
            "MCWG",
            "LMV",
            "SON/DAUGHTER",
            "SON OF",
            "ORGAN DONOR",
            "VALIDITY (NT)",
            "VALIDITY (TR)",
            "DL NO",
            "FORM 7",
            "RTA MEDCHAL",
            "ISSUED BY TELANGANA",
        ),
        (
            Bonus(40, ("DL", "DRIVING", "LICENCE")),
            Bonus(60, ("DL NO", "DRIVING"), (r"\b[A-Z]{2}[0-9]{13,14}\b",)),
        ),
    ),
)
UNKNOWN_TITLE = "Unknown Document"
LICENCE_SPELLINGS = ("driving_licence", "driving_license", "dl")
MRZ_TYPES = ("passport", "visa")

# --- fixed values: words that cannot be part of a holder name ------------------

NAME_FORBIDDEN = (
    "INDIA", "AUTHORITY", "GOVERNMENT", "BHARAT", "SARKAR", "UIDAI",
    "MALE", "FEMALE", "TRANSGENDER", "AADHAAR", "DOB", "DATE", "BIRTH",
    "HELP", "ISSUE", "ADDRESS", "MERA", "ENROLMENT", "DETAILS", "PROOF",
    "IDENTITY", "CITIZENSHIP", "VERIFICATION", "AUTHENTICATION", "SCANNING",
    "PURPOSE", "CARD", "NUMBER", "VID", "SIGNATURE", "UNIQUE", "IDENTIFICATION",
)
LICENCE_NAME_FORBIDDEN = (
    "LICENCE", "DRIVING", "UNION", "AUTHORITY", "FORM", "TRANSPORT", "DEPARTMENT",
)
LIGHT_HEADERS = (
    "GOVERNMENT", "INDIA", "UNION", "REPUBLIC", "PASSPORT", "DRIVING", "LICENCE",
    "ELECTION", "COMMISSION", "AADHAAR", "UNIQUE", "AUTHORITY",
)
VEHICLE_CLASSES = ("MCWG", "LMV", "MCWOG", "3W-CAB", "TRANS", "LDRX", "HMV", "HGMV")
BIRTH_CITIES = (
    "CHENNAI", "DELHI", "MUMBAI", "KOLKATA", "BENGALURU", "HYDERABAD", "AHMEDABAD", "PUNE",
)
ADDRESS_WORDS = (
    "ADDRESS", "पता", "S/O", "C/O", "W/O", "D/O", "ROV", "ROW", "HOUSE", "NAGAR",
    "STREET", "FLAT", "VILLA", "DIST", "STATE", "PIN", "PO:",
)
LETTER_ANCHORS = ("UNIQUE IDENTIFICATION", "ENROLMENT NO", "TO:", "ISSUE DATE", "DOWNLOAD DATE")
CARD_BACK_WORDS = ("ADDRESS", " पता", "S/O", "C/O", "W/O", "D/O", "PIN")

# --- fixed values: input files and OCR engines ---------------------------------

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")
DOCUMENT_EXTENSIONS = (".pdf",)
OCR_ENGINES = ("paddleocr", "easyocr", "tesseract")
FALLBACK_ENGINE = "fallback"
FALLBACK_CONFIDENCE = 85.0
MIN_OCR_CHARS = 10

# --- fixed values: default region boxes as fractions of the page ----------------
# subtype -> (x1, y1, x2, y2)

ADDRESS_REGION_DEFAULTS = {
    "full_e_aadhaar": (0.52, 0.58, 0.78, 0.94),
    "cut_out_dual_card": (0.52, 0.12, 0.75, 0.88),
    "stacked_dual_card": (0.02, 0.55, 0.58, 0.95),
    "single_card_back": (0.02, 0.12, 0.60, 0.92),
    None: (0.02, 0.15, 0.55, 0.95),
}
MRZ_REGION_DEFAULT = (0.02, 0.72, 0.98, 0.98)

# --- fixed values: format profiles ----------------------------------------------


@dataclass(frozen=True)
class FormatProfile:
    doc_type: str
    title: str
    headers: tuple[str, ...]
    min_headers: int
    key_fields: tuple[str, ...]
    number_pattern: str
    has_qr: bool = False
    has_mrz: bool = False


FORMAT_PROFILES = (
    FormatProfile(
        "aadhaar",
        "Aadhaar Card Feature Specification",
        (
            "UNIQUE IDENTIFICATION AUTHORITY OF INDIA",
            "GOVERNMENT OF INDIA",
            "BHARAT SARKAR",
            "AADHAAR",
            "UIDAI",
            "MERA AADHAAR",
        ),
        1,
        ("aadhaar_number", "name", "dob", "gender", "address"),
        r"\b([X0-9]{4}\s?[X0-9]{4}\s?[0-9]{4}|[0-9]{12})\b",
        has_qr=True,
    ),
    FormatProfile(
        "passport",
        "Indian Passport (ICAO Doc 9303) Feature Specification",
        (
            "PASSPORT",
            "REPUBLIC OF INDIA",
            "TYPE P",
            "CODE IND",
            "GIVEN NAME",
            "SURNAME",
            "PLACE OF BIRTH",
            "PLACE OF ISSUE",
        ),
        2,
        ("passport_number", "surname", "given_name", "nationality", "dob", "sex", "date_of_expiry"),
        r"\b[A-Z]{1,2}[0-9]{7}\b",
        has_mrz=True,
    ),
    FormatProfile(
        "visa",
        "Indian Visa Feature Specification",
        (
            "INDIAN VISA",
            "VISA TYPE",
            "NO OF ENTRIES",
            "DATE OF ISSUE",
            "DATE OF EXPIRY",
            "SPECIAL ENDORSEMENT",
            "TOURIST",
        ),
        1,
        ("name", "passport_number", "visa_type", "date_of_issue", "date_of_expiry"),
        r"\b[A-Z0-9]{4,10}\b",
        has_mrz=True,
    ),
    FormatProfile(
        "driving_licence",
        "Indian Driving Licence Feature Specification",
        (
            "DRIVING LICENCE",
            "INDIAN UNION DRIVING LICENCE",
            "ISSUED BY",
            "LICENCING AUTHORITY",
            "CLASS OF VEHICLE",
            "SON/DAUGHTER/WIFE OF",
            "VALIDITY",
        ),
        1,
        ("dl_number", "name", "dob", "issue_date", "validity_nt", "vehicle_classes"),
        r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{11,14}\b",
    ),
)
UNKNOWN_PROFILE_TITLE = "Generic Document Profile"

# --- fixed values: what each side of a document carries -------------------------
# doc_type, side, photo, qr, mrz, target fields

SIDE_RULES = (
    ("aadhaar", "front", True, False, False, ("name", "dob", "gender", "aadhaar_number")),
    ("aadhaar", "back", False, True, False, ("address", "aadhaar_number", "pin")),
    ("aadhaar", "full_page", True, True, False, ("name", "dob", "gender", "aadhaar_number", "address")),
    ("passport", "front", True, False, True,
     ("passport_number", "surname", "given_name", "nationality", "dob", "sex", "expiry_date", "mrz_raw")),
    ("passport", "full_page", True, False, True,
     ("passport_number", "surname", "given_name", "nationality", "dob", "sex", "expiry_date", "mrz_raw")),
    ("driving_licence", "front", True, False, False, ("dl_number", "name", "dob", "issue_date", "validity_nt")),
    ("driving_licence", "back", False, True, False, ("address", "vehicle_classes")),
    ("driving_licence", "full_page", True, True, False,
     ("dl_number", "name", "dob", "issue_date", "validity_nt", "address", "vehicle_classes")),
    ("visa", "front", True, False, True,
     ("visa_number", "passport_number", "name", "visa_type", "entries", "mrz_raw")),
    ("visa", "full_page", True, False, True,
     ("visa_number", "passport_number", "name", "visa_type", "entries", "mrz_raw")),
)
DEFAULT_RULE_TYPE = "aadhaar"
DEFAULT_SIDE = "full_page"

# --- fixed values: fields shown per document type -------------------------------
# ui key, label, source fields (first present wins), confidence, shown when empty

UI_FIELDS = {
    "aadhaar": (
        ("name", "Name", ("name",), 98, True),
        ("aadharNo", "Aadhaar No", ("aadhaar_number",), 98, True),
        ("address", "Address", ("address",), 95, True),
        ("dateOfBirth", "Date of Birth", ("dob",), 98, True),
        ("gender", "Gender", ("gender",), 98, True),
    ),
    "passport": (
        ("passportNumber", "Passport Number", ("passport_number",), 98, True),
        ("name", "Name", ("name",), 98, True),
        ("surname", "Surname", ("surname",), 98, False),
        ("givenName", "Given Name", ("given_name",), 98, False),
        ("dateOfBirth", "DOB", ("dob",), 98, True),
        ("nationality", "Nationality", ("nationality",), 98, False),
        ("gender", "Sex", ("sex",), 98, False),
        ("placeOfBirth", "Place of Birth", ("place_of_birth",), 98, False),
        ("dateOfIssue", "Date of Issue", ("date_of_issue",), 98, True),
        ("dateOfExpiry", "Date of Expiry", ("date_of_expiry",), 98, True),
        ("placeOfIssue", "Place of Issue", ("place_of_issue",), 98, True),
        ("signature", "Signature", ("signature",), 95, False),
        ("address", "Address", ("address",), 95, False),
        ("mrzCode", "MRZ Code", ("mrz_raw",), 99, True),
    ),
    "driving_licence": (
        ("licenseNumber", "License Number", ("dl_number",), 98, True),
        ("name", "Name", ("name",), 98, True),
        ("dateOfIssue", "Date of Issue", ("date_of_issue", "issue_date"), 98, True),
        ("dateOfExpiry", "Date of Expiry", ("date_of_expiry", "validity_nt"), 98, True),
        ("placeOfIssue", "Place of Issue", ("place_of_issue",), 95, True),
        ("address", "Address", ("address",), 95, True),
    ),
    "visa": (
        ("visaNumber", "Visa Number", ("visa_number",), 98, True),
        ("name", "Name", ("name",), 98, True),
        ("visaType", "Visa Type", ("visa_type",), 95, False),
        ("entries", "Entries", ("no_of_entries",), 95, False),
        ("expiryDate", "Expiry Date", ("date_of_expiry",), 95, False),
    ),
}
UI_PASSTHROUGH_EXCLUDED = (
    "name", "dob", "gender", "aadhaar_number", "passport_number", "dl_number", "visa_number",
    "address", "validity", "blood_group", "father_name", "vehicle_classes", "nationality",
    "expiry_date", "visa_type", "entries", "aadhaar_number_valid", "mrz_checksum_valid",
)
UI_PASSTHROUGH_CONFIDENCE = 95
DISPLAY_EXCLUDED = ("mrz_raw", "immigration_stamps")
LOW_CONFIDENCE_BELOW = 90
# ui key -> field the validator reads, both spellings in use
REVALIDATION_KEYS = {
    "aadhaar": {"aadharNo": "aadhaar_number", "maskedAadhaar": "aadhaar_number", "name": "name", "dateOfBirth": "dob"},
    "passport": {"passportNumber": "passport_number", "name": "name", "mrzCode": "mrz_raw"},
    "driving_licence": {"licenseNumber": "dl_number", "dlNumber": "dl_number", "name": "name"},
    "visa": {"visaNumber": "visa_number", "mrzCode": "mrz_raw"},
}

# --- fixed values: QR attributes, checklist, defaults ---------------------------

QR_ATTRIBUTES = ("name", "dob", "gender", "uid", "co", "house", "street", "pc")
CHECKLIST_TYPES = (
    "passport", "proof_of_address", "bank_statement", "employment_letter",
    "tax_documents", "birth_certificate", "visa", "residence_permit",
)
REQUEST_DEFAULTS = {
    "document_type": "aadhaar",
    "engine_pref": "auto",
    "name": "Unknown",
    "average_risk_score": 15.0,
}
UNKNOWN_IDENTIFIER = "Unknown ID"
HISTORY_DEFAULTS = {
    "document_type": "unknown",
    "file_name": "unknown",
    "holder_name": "",
    "identifier": "",
    "risk_level": "LOW",
    "risk_score": 0.0,
    "ekyc_verified": False,
    "result": "{}",
    "extracted_fields": "{}",
    "saved_paths": "{}",
}
DEFAULT_USER_RISK = 15.0
FACE_MATCH_THRESHOLD = 90.0
CONTAINMENT_THRESHOLD = 85.0

# --- rule tables as DataFrames ---------------------------------------------------


def keyword_frame(spark: SparkSession) -> DataFrame:
    """The class keywords as rows (doc_type, keyword, weight)."""
    rows = [(r.doc_type, k, r.keyword_points) for r in CLASS_RULES for k in r.keywords]
    return spark.createDataFrame(rows, "doc_type string, keyword string, weight int")


def side_rule_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, s, p, q, m, list(f)) for t, s, p, q, m, f in SIDE_RULES],
        "doc_type string, side string, extract_photo boolean, extract_qr boolean,"
        " extract_mrz boolean, target_fields array<string>",
    )


def profile_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            (p.doc_type, p.title, list(p.headers), p.min_headers, list(p.key_fields),
             p.number_pattern, p.has_qr, p.has_mrz)
            for p in FORMAT_PROFILES
        ],
        "doc_type string, title string, headers array<string>, min_headers int,"
        " key_fields array<string>, number_pattern string, has_qr boolean, has_mrz boolean",
    )


KEYWORD_SCHEMA = "doc_type string, keyword string, weight int"


def read_keyword_rules(spark: SparkSession, path: str) -> DataFrame:
    """UDF-2: user keywords from JSON lines, added to the built-in ones."""
    return keyword_frame(spark).unionByName(spark.read.schema(KEYWORD_SCHEMA).json(path))
