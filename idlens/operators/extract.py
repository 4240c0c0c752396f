"""Typed fields from page texts (EXT-1..4, EXT-6, EXT-7, WIN-6..8, ARR-1, MAP-1).

All rules are native column expressions. Costly intermediate values (lines,
cleaned names, the MRZ struct) get a projection of their own, so they are
computed once per row, and only for the document types that need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.checksums import verhoeff_valid
from idlens.functions.text import (
    alternation,
    clean_identifier,
    first_line,
    first_match,
    index_of_first,
    name_letters,
    none_if_blank,
    normal_doc_type,
    slash_dates,
    squeeze,
    strip,
    text_lines,
)
from idlens.functions import text as T
from idlens.operators.mrz import mrz_of

# --- fixed patterns -------------------------------------------------------------

DATE = r"[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}"
LOOSE_DATE = r"[0-9]{2}[-/. ][0-9]{2}[-/. ][0-9]{4}"
DAY, MONTH = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])"
NAME_CHARS = r"[A-Za-z\s.'-]"
NON_LETTER_BEFORE, NON_LETTER_AFTER = r"(?:^|[^\p{L}\p{M}])", r"(?:[^\p{L}\p{M}]|$)"
ANCHOR_WORDS = ("DOB", "DATE OF BIRTH", "BIRTH", "YOB", "YEAR OF BIRTH", "MALE", "FEMALE", "TRANSGENDER")
HEADER_WORDS = ("GOVERNMENT OF INDIA", "BHARAT SARKAR", "UNIQUE IDENTIFICATION")
RELATION_WORDS = ("S/O", "D/O", "W/O", "SON OF", "DAUGHTER OF", "WIFE OF", "DOB:")

# --- the wide struct all types share --------------------------------------------

FIELD_TYPES: dict[str, str] = {
    "aadhaar_number": "string",
    "aadhaar_number_valid": "boolean",
    "passport_number": "string",
    "visa_number": "string",
    "dl_number": "string",
    "name": "string",
    "surname": "string",
    "given_name": "string",
    "dob": "string",
    "dob_partial": "boolean",
    "gender": "string",
    "sex": "string",
    "nationality": "string",
    "issuing_country": "string",
    "date_of_issue": "string",
    "date_of_expiry": "string",
    "place_of_birth": "string",
    "place_of_issue": "string",
    "name_in_local_language": "string",
    "signature": "string",
    "visa_type": "string",
    "no_of_entries": "string",
    "issue_date": "string",
    "validity_nt": "string",
    "vehicle_classes": "array<string>",
    "blood_group": "string",
    "relation_name": "string",
    "address": "string",
    "mrz_checksum_valid": "boolean",
    "mrz_checksum_lenient": "boolean",
    "mrz_raw": "array<string>",
}


# necessary conditions of the date, year and number patterns
DATE_GUARD = "[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}"
LOOSE_DATE_GUARD = "[0-9]{2}[-/. ][0-9]{2}[-/. ][0-9]{4}"
YEAR_GUARD = "[12][09][0-9]{2}"
# what the passport rules for a number and for dates without a label look for
FIGURES_GUARD = r"[0-9]{7}|[0-9][-/.\s]\s*[0-9]"


def address_with_pin(text: Column, upper: Column, labels: tuple[str, ...]) -> Column:
    """From the label up to the first six-digit PIN (or the end); a PIN within 20
    characters after is appended unless the address already holds it."""
    body = r"(?is)((?:" + "|".join(labels) + r")\s*[:\s]*.+?)"
    parts = F.struct(
        strip(F.regexp_extract(text, body + r"(?:\b[0-9]{6}\b|\z)", 1)).alias("address"),
        F.regexp_extract(
            F.regexp_extract(text, body + r"(?:\b[0-9]{6}\b.{0,14}|\z)", 0), r"\b[0-9]{6}\b", 0).alias("pin"))

    def whole(p: Column) -> Column:
        missing = (p["pin"] != "") & ~p["address"].contains(p["pin"])
        tail = F.when(missing, F.concat(F.lit(" - "), p["pin"])).otherwise("")
        return none_if_blank(squeeze(F.concat(p["address"], tail)))

    return T.guarded(upper, [w.upper() for w in labels], T.let(parts, whole))


# --- Aadhaar ---------------------------------------------------------------------


def is_anchor(line: Column) -> Column:
    """A line with a birth or gender word, or a date."""
    return T.contains_any(F.upper(line), ANCHOR_WORDS) | (line.rlike(DATE_GUARD) & line.rlike(rf"\b{DATE}\b"))


def is_header(line: Column) -> Column:
    return T.contains_any(F.upper(line), HEADER_WORDS)


def _first_name(lines: Column) -> Column:
    return F.get(F.filter(T.name_candidates(lines), lambda x: x.isNotNull()), F.lit(0))


def name_above_anchor(lines: Column, anchor: Column) -> Column:
    """WIN-6: nearest of the three lines above the first birth/gender line that
    can be a name. `anchor` is 0-based, -1 when there is none."""
    start = F.greatest(anchor - 3, F.lit(0))
    return F.when(anchor > 0, _first_name(F.reverse(F.slice(lines, start + 1, anchor - start))))


def name_below_header(lines: Column, anchor: Column, header: Column) -> Column:
    """WIN-7: first possible name between the header line and the anchor."""
    start = F.greatest(header, F.lit(0))
    end = F.when(anchor > 0, anchor).otherwise(F.size(lines))
    return _first_name(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))))


def line_facts(text: Column) -> Column:
    """The lines of a text with the positions of its anchor and header."""
    return T.let(text_lines(text), lambda lines: F.struct(
        lines.alias("lines"), index_of_first(lines, is_anchor).alias("anchor"),
        index_of_first(lines, is_header).alias("header")))


def holder_from_lines(text: Column) -> Column:
    """WIN-6, then WIN-7."""
    return T.let(line_facts(text), lambda s: F.coalesce(
        name_above_anchor(s["lines"], s["anchor"]),
        name_below_header(s["lines"], s["anchor"], s["header"])))


def _block_name(blocks: Column) -> Column:
    names = T.name_candidates(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))))
    return F.get(F.filter(names, lambda x: x.isNotNull()), F.lit(0))


def gender_word(text: Column, upper: Column) -> Column:
    def hindi(word: str) -> Column:
        return text.contains(word) & text.rlike(NON_LETTER_BEFORE + word + NON_LETTER_AFTER)

    def latin(word: str) -> Column:
        return upper.contains(word) & text.rlike(rf"(?i)\b{word}\b")

    return (
        F.when(latin("MALE") | hindi("पुरुष"), "MALE")
        .when(latin("FEMALE") | hindi("महिला"), "FEMALE")
        .when(latin("TRANSGENDER"), "TRANSGENDER")
    )


def any_date(text: Column, dated: Column) -> Column:
    """`dated`: does the text match DATE_GUARD?"""
    return slash_dates(F.when(dated, first_match(text, rf"\b({DATE})\b")))


def labelled_date(text: Column, upper: Column, dated: Column, labels: tuple[str, ...]) -> Column:
    """The date right after one of the labels, with '/' separators; `dated` as in `any_date`."""
    pattern = rf"(?i)(?:{'|'.join(labels)})\s*[:\s]*({DATE})"
    return slash_dates(F.when(dated, T.guarded(upper, [w.upper() for w in labels], first_match(text, pattern))))


def prefixed_name(text: Column, upper: Column) -> Column:
    """The value after a Name / To / Holder label, unless it is a heading."""
    labelled = none_if_blank(T.guarded(upper, ("NAME", "TO", "HOLDER"), first_line(
        F.regexp_extract(text, rf"(?i)(?:Name|To|Holder)\s*[:\s]+\s*({NAME_CHARS}{{3,35}})", 1))))
    return T.let(labelled, lambda x: F.when(~F.upper(x).rlike(alternation(rules.NAME_FORBIDDEN)), x))


def aadhaar_struct(body: Column, payload: Column | None = None, blocks: Column | None = None) -> Column:
    """EXT-1. A QR payload with a 12-digit uid comes first; when it also carries
    name and birth date nothing is read from the text."""
    nothing = F.lit(None).cast("string")
    qr = nothing if payload is None else payload

    def from_qr(key: str, value: str = "[^\"]+") -> Column:
        return first_match(qr, f'{key}="({value})"')

    attributes = F.struct(
        from_qr("uid", "[0-9]{12}").alias("uid"), from_qr("name").alias("name"), from_qr("dob").alias("dob"),
        from_qr("gender").alias("gender"), F.upper(body).alias("upper"), body.rlike(DATE_GUARD).alias("dated"),
        body.rlike("[0-9]{4}").alias("numbers"))

    def result(q: Column) -> Column:
        upper, dated, numbers = q["upper"], q["dated"], q["numbers"]
        trusted = q["uid"].isNotNull()
        complete = trusted & q["name"].isNotNull() & q["dob"].isNotNull()

        def given(key: str) -> Column:
            return F.when(trusted, q[key])

        plain = F.regexp_replace(F.when(
            numbers, first_match(body, r"\b([0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4})\b")), r"[-\s]", "")
        masked = F.when(numbers, first_match(body, r"(?i)\b([X0-9]{4}[-\s]?[X0-9]{4}[-\s]?[0-9]{4})\b"))

        def as_number(value: Column, is_masked: bool) -> Column:
            return F.struct(value.alias("number"), F.lit(is_masked).alias("masked"))

        # a number in the text beats the payload's, a masked one too
        picked = F.when(complete, as_number(q["uid"], False)).otherwise(
            T.let(plain, lambda p: F.when(p.isNotNull(), as_number(p, False)).otherwise(
                T.let(masked, lambda m: F.when(m.isNotNull(), as_number(m, True)).otherwise(
                    as_number(q["uid"], False))))))
        read = T.let(picked, lambda n: F.struct(
            n["number"].alias("number"),
            F.when(n["masked"], True).otherwise(verhoeff_valid(n["number"])).alias("ok")))
        year_label = r"(?i)(?:YOB|Year of Birth|Birth Year)\s*[:\s]*([0-9]{4})"
        dob = F.coalesce(
            given("dob"),
            labelled_date(body, upper, dated, ("DOB", "Date of Birth", "DOB:")),
            any_date(body, dated),
            F.when(numbers, T.guarded(
                upper, ("YOB", "YEAR OF BIRTH", "BIRTH YEAR"), first_match(body, year_label))),
            F.when(body.rlike(YEAR_GUARD), first_match(body, r"\b(19[0-9]{2}|20[0-2][0-9])\b")),
        )
        name = F.coalesce(
            given("name"),
            strip(T.guarded(upper, ('NAME="',), first_match(body, '(?i)name="([^"]+)"'))),
            prefixed_name(body, upper),
            holder_from_lines(body),
            *([] if blocks is None else [_block_name(blocks)]),
        )
        address = F.when(
            ~complete, address_with_pin(body, upper, ("Address", "पता", "S/O", "C/O", "W/O", "D/O")))
        return T.let(read, lambda n: F.struct(
            n["number"].alias("aadhaar_number"), n["ok"].alias("aadhaar_number_valid"), dob.alias("dob"),
            F.coalesce(given("gender"), F.when(~complete, gender_word(body, upper))).alias("gender"),
            name.alias("name"), address.alias("address")))

    return T.let(attributes, result)


def extract_aadhaar(df: DataFrame, text: str = "raw_text", payload: str | None = None,
                    blocks: str | None = None, into: str = "aadhaar") -> DataFrame:
    return df.withColumn(into, aadhaar_struct(
        F.col(text), F.col(payload) if payload else None, F.col(blocks) if blocks else None))


# --- licence -----------------------------------------------------------------------


def vehicle_classes(text: Column) -> Column:
    """ARR-1: codes occurring in the text, in list order; NULL when none does."""
    return T.let(F.upper(text), _codes_in)


def _codes_in(upper: Column) -> Column:
    codes = F.array(*[F.lit(c) for c in rules.VEHICLE_CLASSES])
    return T.let(F.filter(codes, lambda c: upper.contains(c)), lambda f: F.when(F.size(f) > 0, f))


def name_before_relation(lines: Column) -> Column:
    """WIN-8: the line right before the first relation or birth line that passes."""
    before = F.filter(
        lines, lambda x, i: T.contains_any(F.upper(F.coalesce(F.get(lines, i + 1), F.lit(""))), RELATION_WORDS))
    passing = F.filter(F.transform(before, name_letters), lambda x: F.length(x).between(3, 35)
                       & ~F.upper(x).rlike(alternation(rules.LICENCE_NAME_FORBIDDEN)))
    return F.get(passing, F.lit(0))


def licence_number(text: Column, upper: Column) -> Column:
    """First of four shapes whose cleaned value has at least ten characters."""
    shapes = (
        r"(?i)\b([A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7})\b",
        r"(?i)\b([A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{11})\b",
        r"(?i)\b([A-Z]{2}[-\s]?[0-9]{12,14})\b",
        r"(?i)\b(?:DL\s*NO|LICENCE\s*NO|DL)\.?\s*[:\s]*([A-Z0-9/\-\s]{10,20})\b",
    )
    guards = (F.lit(True), text.rlike("[0-9]{11}"), text.rlike("[0-9]{12}"), T.contains_any(upper, ("DL", "LICENCE")))
    cleaned = [clean_identifier(F.when(g, first_match(text, s))) for g, s in zip(guards, shapes, strict=True)]
    *bare, labelled = [T.let(c, lambda x: F.when(F.length(x) >= 10, x)) for c in cleaned]
    # each bare shape ends in seven digits at least
    return F.coalesce(F.when(text.rlike("[0-9]{7}"), F.coalesce(*bare)), labelled)


def licence_struct(body: Column) -> Column:
    """EXT-4."""
    facts = F.struct(F.upper(body).alias("upper"), body.rlike(DATE_GUARD).alias("dated"))
    return T.let(facts, lambda s: _licence_struct(body, s["upper"], s["dated"]))


def _licence_struct(body: Column, upper: Column, dated: Column) -> Column:
    labelled = T.guarded(upper, ("NAME", "HOLDER"), first_match(
        body, rf"(?i)(?:Name|Holder|Name of Holder)\s*[:\s]*({NAME_CHARS}{{2,35}})"))
    name = T.let(labelled, lambda x: F.when(
        x.isNotNull(), F.when(F.length(first_line(x)) >= 2, first_line(x))
    ).otherwise(T.guarded(upper, RELATION_WORDS, T.let(text_lines(body), name_before_relation))))
    blood = first_match(body, r"(?i)(?:Blood Group|BG)\s*[:\s]*([ABO][+-])")
    relation = first_match(
        body, rf"(?i)(?:S/O|D/O|W/O|Son of|Daughter of|Wife of)\s*[:\s]*({NAME_CHARS}{{2,35}})")
    return F.struct(
        licence_number(body, upper).alias("dl_number"),
        F.coalesce(labelled_date(body, upper, dated, ("DOB", "Date of Birth", "Birth")), any_date(body, dated)).alias("dob"),
        name.alias("name"),
        labelled_date(body, upper, dated, ("Issue Date", "DOI", "Issued")).alias("issue_date"),
        labelled_date(body, upper, dated, ("Validity", "Valid Till", "NT")).alias("validity_nt"),
        _codes_in(upper).alias("vehicle_classes"),
        T.guarded(upper, ("BLOOD GROUP", "BG"), blood).alias("blood_group"),
        none_if_blank(strip(T.guarded(upper, RELATION_WORDS[:-1], relation))).alias("relation_name"),
        address_with_pin(body, upper, ("Address", "Add")).alias("address"),
    )


def extract_licence(df: DataFrame, text: str = "raw_text", into: str = "licence") -> DataFrame:
    return df.withColumn(into, licence_struct(F.col(text)))


# --- passport and visa ---------------------------------------------------------------


def _viz_date(c: Column) -> Column:
    return F.regexp_replace(slash_dates(c), " ", "")


def passport_struct(body: Column, zone: Column) -> Column:
    """EXT-2: MRZ values first, then the labelled values of the visual zone."""
    facts = F.struct(
        F.upper(body).alias("upper"), body.rlike(FIGURES_GUARD).alias("figures"), body.rlike(LOOSE_DATE_GUARD).alias("dated"))
    return T.let(facts, lambda s: _passport_struct(body, s["upper"], s["figures"], s["dated"], zone))


def _passport_struct(body: Column, upper: Column, figures: Column, has_dates: Column, zone: Column) -> Column:
    def line_after(words: tuple[str, ...], labels: str, chars: str) -> Column:
        """First line of the value after a label; `words`: what any label holds."""
        value = first_match(body, rf"(?iu)(?:{labels})[\s.:]*({chars})")
        return strip(first_line(T.guarded(upper, words, value)))

    def dated(words: tuple[str, ...], labels: str) -> Column:
        value = first_match(body, rf"(?iu)(?:{labels})[\s.:]*({LOOSE_DATE})")
        return _viz_date(F.when(has_dates, T.guarded(upper, words, value)))

    def loose_date(pattern: str) -> Column:
        return _viz_date(F.when(has_dates, first_match(body, rf"\b({pattern})\b")))

    number = zone["passport_number"]
    seen_number = F.upper(F.coalesce(
        F.when(figures & body.rlike("[0-9]{7}"), first_match(body, r"\b([A-PR-WYa-pr-wy][0-9]{7})\b")),
        T.guarded(upper, ("PASSPORT",), first_match(
            body, r"(?i)(?:Passport\s*No|Passport\s*Number)[\s.:]*([A-Z0-9]{8,9})")),
    ))
    surname = F.coalesce(
        none_if_blank(zone["surname"]),
        line_after(("SURNAME", "NOM", "उपनाम"), r"Surname|Nom|1\.\s*उपनाम", NAME_CHARS + "{2,35}"), zone["surname"])
    given = F.coalesce(
        none_if_blank(zone["given_name"]),
        line_after(("GIVEN", "NOM", "दिया"), r"Given\s*Name[s]?|Pr[ée]nom|2\.\s*दिया\s*गया\s*नाम", NAME_CHARS + "{2,35}"), zone["given_name"])
    zone_name = none_if_blank(strip(F.concat_ws(" ", zone["surname"], zone["given_name"])))
    labelled_dob = dated(("BIRTH", "NAISSANCE", "DOB", "जन्मतिथि"),
                         r"Date\s*of\s*Birth|Date\s*de\s*naissance|DOB|5\.\s*जन्मतिथि")
    plain_dob = loose_date(rf"{DAY}[-/. ]{MONTH}[-/. ](?:19[0-9]{{2}}|20[0-2][0-9])")
    split_dob = rf"\b({DAY})\s*\n\s*(19[0-9]{{2}}|20[0-2][0-9])\b"
    split_day, split_year = (F.when(
        figures & body.rlike(r"[0-9]\s*\n\s*[12]"), first_match(body, split_dob, i)) for i in (1, 2))
    joined_dob = F.concat(split_day, F.lit("/01/"), split_year)
    zone_dob = none_if_blank(zone["dob"])
    full_dob = F.coalesce(labelled_dob, zone_dob, plain_dob)
    # a date put together from a day and a year is only looked for when there is no whole one
    dob = T.let(full_dob, lambda d: F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(False).alias("partial"))).otherwise(
        T.let(joined_dob, lambda j: F.struct(j.alias("d"), j.isNotNull().alias("partial")))))
    partial = rf"\b({MONTH})[-/. ](20[12][0-9])\b"
    partial_month, partial_year = (F.when(
        figures & body.rlike("[0-9][-/. ]20[12]"), first_match(body, partial, i)) for i in (1, 2))
    issued = F.coalesce(
        dated(("ISSUE", "VRANCE", "जारी"), r"Date\s*of\s*Issue|Date\s*de\s*d[ée]livrance|Issue|8\.\s*जारी"),
        loose_date(rf"{DAY}[-/. ]{MONTH}[-/. ]20[12][0-9]"),
        F.concat(F.lit("01/"), partial_month, F.lit("/"), partial_year),
    )
    expires = F.coalesce(
        dated(("EXPIR", "समाप्ति"), r"Date\s*of\s*Expiry|Date\s*d'expiration|Expiry|9\.\s*समाप्ति"),
        none_if_blank(zone["expiry_date"]),
        loose_date(rf"{DAY}[-/. ]{MONTH}[-/. ]20[2-4][0-9]"),
    )
    city = F.upper(T.guarded(upper, rules.BIRTH_CITIES, first_match(
        body, r"(?i)\b(" + alternation(rules.BIRTH_CITIES) + r")\b")))
    born_at = F.coalesce(
        line_after(("BIRTH", "NAISSANCE", "जन्म"), r"Place\s*of\s*Birth|Lieu\s*de\s*naissance|7\.\s*जन्म\s*स्थान", r"[A-Za-z\s,]+"),
        F.when(body.contains("IND"), first_match(body, r"\b([A-Z]{3,15}\s*,\s*IND)\b")),
        F.concat(city, F.lit(", IND")),
    )
    issued_at = F.coalesce(
        line_after(("ISSUE", "जारी"), r"Place\s*of\s*Issue|10\.\s*जारी\s*करने\s*का\s*स्थान", r"[A-Za-z\s]+"),
        T.guarded(upper, ("RPO",), first_match(body, r"(?i)\b(RPO\s+[A-Za-z]+)\b")),
    )

    def labelled_sex(letter: str) -> Column:
        pattern = rf"(?iu)(?:Sex|Sexe|6\.\s*लिंग)[\s.:]*{letter}\b"
        return T.contains_any(upper, ("SEX", "लिंग")) & body.rlike(pattern)

    sex = F.coalesce(
        none_if_blank(zone["sex"]),
        F.when(labelled_sex("F") | (upper.contains("FEMALE") & body.rlike(r"(?i)\bFEMALE\b")), "F")
        .when(labelled_sex("M") | (upper.contains("MALE") & body.rlike(r"(?i)\bMALE\b")), "M"),
    )
    zone_nation = none_if_blank(zone["nationality"])
    unread_nation = zone_nation.isNull() | (zone_nation == "ND8")
    nation = F.when(unread_nation & upper.contains("IND"), "INDIAN").otherwise(zone_nation)
    country = F.when(unread_nation, "IND").otherwise(F.coalesce(none_if_blank(zone["country"]), F.lit("IND")))

    names = F.struct(surname.alias("s"), given.alias("g"), dob.alias("dob"))
    name = T.let(names, lambda n: F.struct(
        n["s"].alias("surname"), n["g"].alias("given_name"), n["dob"].alias("dob"),
        F.when((n["s"] != "") & (n["g"] != ""), F.concat_ws(" ", n["s"], n["g"])).otherwise(
            F.coalesce(zone_name, line_after(("NAME", "HOLDER"), "Name|Holder", NAME_CHARS + "{2,35}"))).alias("name")))
    return T.let(name, lambda n: F.struct(
        F.when(number.rlike("^[A-Z][0-9]{7}$"), number).otherwise(F.coalesce(seen_number, number))
        .alias("passport_number"),
        n["surname"].alias("surname"),
        n["given_name"].alias("given_name"),
        n["name"].alias("name"),
        nation.alias("nationality"),
        country.alias("issuing_country"),
        n["dob"]["d"].alias("dob"),
        n["dob"]["partial"].alias("dob_partial"),
        sex.alias("sex"),
        issued.alias("date_of_issue"),
        expires.alias("date_of_expiry"),
        born_at.alias("place_of_birth"),
        issued_at.alias("place_of_issue"),
        strip(T.guarded(upper, ("TAM", "HINDI", "स्थानीय"), first_match(
            body, r"(?iu)(?:TAM|TAMIL|HINDI|स्थानीय\s*भाषा)[\s.:]*[^\n]+", 0)))
        .alias("name_in_local_language"),
        line_after(("SIGNATURE", "हस्ताक्षर"), r"Signature|11\.\s*हस्ताक्षर", r"[A-Za-z\s]+").alias("signature"),
        F.coalesce(zone["mrz_checksum_valid"], F.lit(False)).alias("mrz_checksum_valid"),
        F.coalesce(zone["mrz_checksum_lenient"], F.lit(False)).alias("mrz_checksum_lenient"),
        zone["mrz_raw"].alias("mrz_raw"),
    ))


def extract_passport(df: DataFrame, text: str = "raw_text", into: str = "passport") -> DataFrame:
    return df.withColumn(into, T.let(mrz_of(F.col(text)), lambda z: passport_struct(F.col(text), z)))


def visa_struct(body: Column, zone: Column) -> Column:
    """EXT-3."""
    return T.let(F.upper(body), lambda upper: _visa_struct(body, upper, zone))


def _visa_struct(body: Column, upper: Column, zone: Column) -> Column:

    def first_word(*words: tuple[str, str]) -> Column:
        found = F.when(upper.contains(words[0][0]), words[0][1])
        for needle, value in words[1:]:
            found = found.when(upper.contains(needle), value)
        return found

    name = F.coalesce(
        none_if_blank(strip(F.concat_ws(" ", zone["given_name"], zone["surname"]))),
        first_line(first_match(body, rf"(?i)(?:Name|Nom|Nombre|Bearer)\s*[:\s]*({NAME_CHARS}+)")),
    )
    return F.struct(
        first_match(body, r"(?i)(?:VISA\s*NO|VISA|NUMBER)\s*[:\s]*([A-Z0-9]{6,12})").alias("visa_number"),
        zone["passport_number"].alias("passport_number"),
        name.alias("name"),
        zone["surname"].alias("surname"),
        zone["given_name"].alias("given_name"),
        zone["nationality"].alias("nationality"),
        zone["dob"].alias("dob"),
        zone["sex"].alias("sex"),
        zone["expiry_date"].alias("date_of_expiry"),
        first_word(*[(w, w) for w in ("TOURIST", "BUSINESS", "STUDENT", "EMPLOYMENT")]).alias("visa_type"),
        first_word(("MULT", "MULTIPLE"), ("SINGLE", "SINGLE"), ("DOUBLE", "DOUBLE")).alias("no_of_entries"),
        F.coalesce(zone["mrz_checksum_valid"], F.lit(False)).alias("mrz_checksum_valid"),
        F.coalesce(zone["mrz_checksum_lenient"], F.lit(False)).alias("mrz_checksum_lenient"),
        zone["mrz_raw"].alias("mrz_raw"),
    )


def extract_visa(df: DataFrame, text: str = "raw_text", into: str = "visa") -> DataFrame:
    return df.withColumn(into, T.let(mrz_of(F.col(text)), lambda z: visa_struct(F.col(text), z)))


# --- dispatch -----------------------------------------------------------------------

# UDF-1: extra extractors, (text, lines, payload) -> struct whose fields are a
# subset of FIELD_TYPES
Extractor = Callable[[Column, Column, Column], Column]
_EXTRA: dict[str, Extractor] = {}


def register_extractor(doc_type: str, fn: Extractor) -> None:
    """UDF-1: add a document type without touching the built-in rules."""
    _EXTRA[doc_type] = fn


def unregister_extractor(doc_type: str) -> None:
    _EXTRA.pop(doc_type, None)


def extract_fields(
    df: DataFrame, text: str = "raw_text", doc_type: str = "document_type",
    payload: str | None = None, blocks: str | None = None,
) -> DataFrame:
    """EXT-7: adds the wide `fields` struct; each row runs only the rules of its
    own type, and unknown types get the passport rules."""
    body = F.col(text)
    qr = F.col(payload) if payload else F.lit(None).cast("string")
    extras = dict(_EXTRA)

    def by_type(kind: Column) -> Column:
        own = ["aadhaar", "driving_licence", "visa", *extras]

        def with_zone(zone: Column) -> Column:
            parts = {
                "aadhaar": F.when(kind == "aadhaar", aadhaar_struct(body, qr, F.col(blocks) if blocks else None)),
                "passport": F.when(~kind.isin(*own), passport_struct(body, zone)),
                "visa": F.when(kind == "visa", visa_struct(body, zone)),
                "licence": F.when(kind == "driving_licence", licence_struct(body)),
            }
            for i, (name, fn) in enumerate(extras.items()):
                parts[f"extra{i}"] = F.when(kind == name, fn(body, text_lines(body), qr))
            return F.struct(*[c.alias(n) for n, c in parts.items()])

        zoned = ~kind.isin(*[k for k in own if k != "visa"])
        return T.let(F.when(zoned, mrz_of(body)), with_zone)

    staged = df.withColumn("_parts", T.let(normal_doc_type(F.coalesce(F.col(doc_type), F.lit(""))), by_type))
    known = {f.name: set(f.dataType.names) for f in staged.schema["_parts"].dataType.fields}

    def widened(parts: Column) -> Column:
        return F.struct(*[
            F.coalesce(*[parts[p][name] for p, names in known.items() if name in names], F.lit(None))
            .cast(dtype).alias(name)
            for name, dtype in FIELD_TYPES.items()
        ])

    return staged.withColumn("fields", T.let(F.col("_parts"), widened)).drop("_parts")


# --- map, long and wide forms (MAP-1) ---------------------------------------------------


def field_text(fields: Column, name: str) -> Column:
    """Any field as text: lists joined, booleans as true/false."""
    value = fields[name]
    if FIELD_TYPES[name].startswith("array"):
        return F.array_join(value, "\n" if name == "mrz_raw" else ", ")
    return value.cast("string")


def fields_map(fields: Column, names: list[str] | None = None) -> Column:
    """MAP-1: MAP of the non-empty fields."""
    pairs = [x for n in (names or FIELD_TYPES) for x in (F.lit(n), field_text(fields, n))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: F.coalesce(v, F.lit("")) != "")


def fields_long(df: DataFrame, keys: list[str], fields: str = "fields") -> DataFrame:
    """MAP-1: one row (keys, key, value) per non-empty field."""
    return df.select(*keys, F.explode(fields_map(F.col(fields))).alias("key", "value"))


def fields_wide(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """MAP-1 back: one row per document with a map and the asked-for columns.
    The first value of a repeated key in text order is kept."""
    once = long.groupBy(*keys, "key").agg(F.min("value").alias("value"))
    return once.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields_map"),
    ).select(*keys, *[F.try_element_at("fields_map", F.lit(n)).alias(n) for n in names], "fields_map")


# --- light rules (EXT-6, SRT-3) -----------------------------------------------------------


def extract_light(df: DataFrame, text: str = "raw_text", doc_type: str = "document_type") -> DataFrame:
    """EXT-6: the quick rules: birth date, gender, id by type, first plain name
    line and, when fewer than two fields were found, the first four lines."""
    body, kind = F.col(text), normal_doc_type(F.col(doc_type))
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: F.length(x) > 2)
    dob = F.coalesce(
        first_match(body, r"\b([0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4})\b"),
        first_match(body, r"(?i)(?:DOB|D\.O\.B|Birth|Year)[\s:]*([0-9]{2}[/\-][0-9]{2}[/\-][0-9]{4}|[0-9]{4})"),
    )
    gender = F.when(body.rlike(r"(?i)\b(FEMALE|WOMAN)\b"), "Female").when(
        body.rlike(r"(?i)\b(MALE|MAN)\b"), "Male")
    identifier = (
        F.when(kind == "aadhaar", F.coalesce(
            first_match(body, r"\b([0-9]{4}\s[0-9]{4}\s[0-9]{4})\b"),
            first_match(body, r"\b([X0-9]{4}\s[X0-9]{4}\s[0-9]{4})\b")))
        .when(kind == "passport", F.upper(first_match(body, r"\b([A-PR-WYa-pr-wy][0-9]{7})\b")))
        .when(kind == "driving_licence", F.upper(first_match(
            body, r"(?i)\b([A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4,7})\b")))
        .when(kind == "visa", F.upper(first_match(body, r"(?i)\b(V[0-9]{7,9})\b")))
    )
    headers = "(?i)" + alternation(rules.LIGHT_HEADERS)

    def read(kept: Column) -> Column:
        name = F.get(F.filter(
            kept, lambda x: ~x.rlike(headers) & x.rlike(r"^[A-Za-z\s.]{3,35}$")), F.lit(0))
        return F.struct(dob.alias("dateOfBirth"), gender.alias("gender"), identifier.alias("identifier"),
                        name.alias("name"), kept.alias("lines"))

    def topped_up(r: Column) -> Column:
        names = ("dateOfBirth", "gender", "identifier", "name")
        found = sum((r[n].isNotNull().cast("int") for n in names), F.lit(0))
        few = F.when(found < 2, F.slice(r["lines"], 1, 4)).otherwise(F.array().cast("array<string>"))
        return F.struct(*[r[n].alias(n) for n in names], few.alias("lines"))

    return df.withColumn("light", T.let(T.let(lines, read), topped_up))
