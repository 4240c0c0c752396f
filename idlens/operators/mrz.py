"""Machine-readable zones: locate, repair, slice, check (EXT-5, WIN-3, JN-15, SET-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.functions.checksums import icao_matches
from idlens.functions.numbers import mrz_date
from idlens.functions.text import let, none_if_blank, pad_mrz, strip, text_lines

# fixed values: line starts that mark an MRZ line whatever its length
LINE_STARTS = "^(?:P<|V<|VT|SP|P1|P2)"
NAME_STARTS = "^(?:P<|V<)"
RUN_PATTERN = "[P|VA-Z0-9<]{30,44}"

# what a line holds if its zone letters, in upper case, begin as LINE_STARTS says: the letters, or
# others whose upper case they are, with nothing but what is left out before and between them
_LEFT_OUT = r"[^A-Za-z0-9<\n\u017f\u1e97]*+"
START_GUARD = (rf"{_LEFT_OUT}(?:[Pp]{_LEFT_OUT}[<12]|[Vv]{_LEFT_OUT}[<Tt\u1e97]|[Ss\u017f]{_LEFT_OUT}[Pp])")


def _mrz_letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Z0-9<]", "")


def candidate_lines(text: Column) -> Column:
    """SET-3: lines that look like MRZ; when fewer than two, also 30-44 character
    runs of the whole text that are not listed yet.

    Only lines that hold a '<' or can begin as a zone does are reduced to zone letters, and a
    text is only cut into lines if it has such a line."""
    possible = F.filter(text_lines(text), lambda x: x.contains("<") | x.rlike("^" + START_GUARD))
    read = F.filter(
        F.transform(possible, lambda x: _mrz_letters(F.upper(x))),
        lambda x: ((F.length(x) >= 28) & x.contains("<")) | x.rlike(LINE_STARTS),
    )
    none = F.array().cast("array<string>")
    lines = F.when(~(text.contains("<") | text.rlike(rf"(?:^|\n){START_GUARD}")), none).otherwise(read)
    runs = F.filter(
        F.transform(F.regexp_extract_all(F.upper(text), F.lit(RUN_PATTERN), F.lit(0)), _mrz_letters),
        lambda x: x.contains("<") & (F.length(x) >= 30),
    )
    return let(lines, lambda found: F.when(
        (F.size(found) < 2) & text.contains("<"), F.array_union(found, runs)).otherwise(found))


def two_longest(lines: Column) -> Column:
    """WIN-3 / SRT-4: the two longest lines, earlier first among equals."""
    ranked = F.array_sort(
        F.transform(lines, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("line")))
    )
    return F.transform(F.slice(ranked, 1, 2), lambda s: s["line"])


def repaired(line2: Column, text: Column) -> Column:
    """JN-15: give a number line that lost its letter the letter seen elsewhere
    in the page text."""
    same_number = none_if_blank(
        F.call_function(
            "regexp_extract", text, F.concat(F.lit(r"\b([A-Z])"), F.substring(line2, 1, 7)), F.lit(1))
    )
    any_number = none_if_blank(F.regexp_extract(text, r"\b([A-PR-WYa-pr-wy])[0-9]{7}\b", 1))
    letter = F.coalesce(same_number, F.upper(any_number), F.lit(""))
    return F.when(line2.rlike("^[0-9]{6,8}<"), F.concat(letter, line2)).otherwise(line2)


def _swapped(pair: Column, swap) -> Column:
    return let(pair, lambda p: F.when(
        (F.size(p) == 2) & swap(F.get(p, F.lit(0)), F.get(p, F.lit(1))), F.reverse(p)).otherwise(p))


def ordered_lines(text: Column) -> Column:
    """The two longest candidates, name line on top; shorter when there are not two."""
    two = two_longest(candidate_lines(text))
    two = _swapped(two, lambda a, b: b.contains("<") & ~a.contains("<"))
    return _swapped(two, lambda a, b: b.rlike(NAME_STARTS) & ~a.rlike(NAME_STARTS))


def locate_mrz(text: Column) -> Column:
    """[line 1, line 2] of 44 characters each, number line repaired, or NULL."""
    return let(ordered_lines(text), lambda p: F.when(F.size(p) == 2, F.array(
        pad_mrz(F.get(p, F.lit(0))), pad_mrz(let(F.get(p, F.lit(1)), lambda line: repaired(line, text))))))


def mrz_struct(line1: Column, line2: Column) -> Column:
    """Sliced and checked zone; `mrz_checksum_valid` is the strict verdict over
    all five digits, `mrz_checksum_lenient` only says that a zone was read."""

    def part(line: Column, start: int, end: int) -> Column:
        return F.substring(line, start + 1, end - start)

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, "<", "")

    names = F.split(part(line1, 5, 44), "<<")

    def name(i: int) -> Column:
        return strip(F.regexp_replace(F.coalesce(F.get(names, F.lit(i)), F.lit("")), "<", " "))

    number_ok = icao_matches(part(line2, 0, 9), 9, part(line2, 9, 10))
    dob_ok = icao_matches(part(line2, 13, 19), 6, part(line2, 19, 20))
    expiry_ok = icao_matches(part(line2, 21, 27), 6, part(line2, 27, 28))
    optional_ok = icao_matches(part(line2, 28, 42), 14, part(line2, 42, 43), empty_ok=True)
    composite = F.concat(part(line2, 0, 10), part(line2, 13, 20), part(line2, 21, 43))
    composite_ok = icao_matches(composite, 39, part(line2, 43, 44))
    sex = part(line2, 20, 21)
    return F.when(
        line1.isNotNull() & line2.isNotNull(),
        F.struct(
            bare(part(line1, 0, 2)).alias("document_type"),
            bare(part(line1, 2, 5)).alias("country"),
            name(0).alias("surname"),
            name(1).alias("given_name"),
            bare(part(line2, 0, 9)).alias("passport_number"),
            bare(part(line2, 10, 13)).alias("nationality"),
            mrz_date(part(line2, 13, 19)).alias("dob"),
            F.when(sex.isin("M", "F"), sex).otherwise("").alias("sex"),
            mrz_date(part(line2, 21, 27), expiry=True).alias("expiry_date"),
            number_ok.alias("number_ok"),
            dob_ok.alias("dob_ok"),
            expiry_ok.alias("expiry_ok"),
            optional_ok.alias("optional_ok"),
            composite_ok.alias("composite_ok"),
            (number_ok & dob_ok & expiry_ok & optional_ok & composite_ok).alias("mrz_checksum_valid"),
            F.lit(True).alias("mrz_checksum_lenient"),
            F.array(line1, line2).alias("mrz_raw"),
        ),
    )


def mrz_of(text: Column) -> Column:
    """EXT-5: the nullable zone struct of a text."""
    return let(locate_mrz(text), lambda p: mrz_struct(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def parse_mrz(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """EXT-5: adds the nullable `mrz` struct."""
    return df.withColumn("mrz", mrz_of(F.col(text)))
