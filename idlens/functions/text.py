"""Text, name, identifier and file-name functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from idlens import rules

WHITESPACE = " \t\n\r\f\x0b"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often the body
    names it and whatever the optimizer substitutes (a lambda variable is never
    inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every leading and trailing whitespace character, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def none_if_blank(c: Column) -> Column:
    """Missing key, NULL and '' are all the same "absent" value."""
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL when there is none."""
    return none_if_blank(F.regexp_extract(c, pattern, group))


def guarded(upper: Column, words: Iterable[str], value: Column) -> Column:
    """`value` where the upper-cased text holds one of the words its pattern needs;
    a literal search is far cheaper than a pattern with alternatives."""
    return F.when(contains_any(upper, words), value)


def first_line(c: Column) -> Column:
    return F.split_part(strip(c), F.lit("\n"), F.lit(1))


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | c.contains(needle)
    return test


def alternation(words: Iterable[str]) -> str:
    """Regex that finds any of the literal words in one pass."""
    special = set(".^$*+?()[]{}|\\")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def text_lines(c: Column) -> Column:
    """TXT-1: trimmed, non-blank lines of a page text."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def name_letters(c: Column) -> Column:
    """Keep Latin letters and the punctuation of names; everything else is a gap."""
    return squeeze(F.regexp_replace(c, r"[^A-Za-z\s.'-]", " "))


def looks_like_name(c: Column, forbidden: Iterable[str] = rules.NAME_FORBIDDEN) -> Column:
    """TXT-2 on a value already reduced by `name_letters`."""
    return (
        F.length(c).between(3, 35)
        & (F.size(F.split(c, " ")) <= 4)
        & ~F.upper(c).rlike(alternation(forbidden))
    )


def name_candidates(lines: Column, forbidden: Iterable[str] = rules.NAME_FORBIDDEN) -> Column:
    """Per line the cleaned name, or NULL when the line cannot be a name.

    Two nested transforms: the clean-up runs once per line, not once per test.
    """
    return F.transform(
        F.transform(lines, name_letters),
        lambda x: F.when(looks_like_name(x, forbidden), x),
    )


def index_of_first(lines: Column, test) -> Column:
    """0-based position of the first line passing `test`; -1 when none does."""
    return (F.array_position(F.transform(lines, test), True) - 1).cast("int")


def slash_dates(c: Column) -> Column:
    """TXT-3: '-' and '.' become '/'."""
    return F.translate(c, "-.", "//")


def clean_identifier(c: Column) -> Column:
    """TXT-4: no spaces or hyphens, upper case."""
    return F.upper(F.regexp_replace(c, r"[-\s]", ""))


def title_label(c: Column) -> Column:
    """TXT-5: snake_case key to a Title Case label."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def safe_token(c: Column) -> Column:
    """TXT-6: store names are lower case with every other character as '_'."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_")


def safe_review_name(c: Column) -> Column:
    """TXT-6, review variant: case kept, runs of '_' collapsed, '_' trimmed;
    a name without any usable character stays as typed."""
    kept = F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9_\-]", "_"), "_+", "_")
    return F.coalesce(none_if_blank(F.regexp_replace(kept, "^_|_$", "")), c)


def base_name(doc_type: Column, side: Column, custom: Column) -> Column:
    """Name under which a capture is stored (a later one of that name wins)."""
    side_part = safe_token(F.coalesce(none_if_blank(side), F.lit("front")))
    type_part = safe_token(F.coalesce(none_if_blank(doc_type), F.lit("document")))
    custom_part = F.regexp_replace(custom, "[^a-z0-9_]", "_")
    return F.concat_ws("_", F.when(present(custom), custom_part).otherwise(type_part), side_part)


def pad_mrz(c: Column) -> Column:
    """TXT-7: exactly 44 characters, filled with '<'."""
    return F.rpad(c, 44, "<")


def mutually_contained(a: Column, b: Column) -> Column:
    """TXT-8: either text holds the other."""
    return a.contains(b) | b.contains(a)


def normal_doc_type(c: Column) -> Column:
    """One vocabulary for the spellings in use."""
    low = F.lower(c)
    return F.when(low.isin(*rules.LICENCE_SPELLINGS), "driving_licence").otherwise(low)
