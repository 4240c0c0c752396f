"""Document classes from keywords and patterns (AGG-5, WIN-1, MTH-3, JN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.numbers import class_confidence
from idlens.functions.text import alternation

SCORE_PREFIX = "score_"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _occurs(text: str, literal: str, word_boundary: bool) -> str:
    if word_boundary:
        return f"{text} RLIKE {_literal(r'(?<![A-Z0-9])(?:' + alternation([literal]) + r')(?![A-Z0-9])')}"
    return f"contains({text}, {_literal(literal)})"


def _matches(text: str, pattern: str) -> str:
    """A pattern behind a cheap necessary condition, so that ordinary prose never meets the
    costly one: a run of digits, or a literal, that every match holds."""
    search = f"{text} RLIKE {_literal(pattern)}"
    if "P<" in pattern:
        return f"(contains({text}, 'P<') AND {search})"
    return f"({text} RLIKE '[0-9]{{4}}' AND {search})" if "[0-9]" in pattern else f"({search})"


def class_score(text: str, rule: rules.ClassRule, word_boundary: bool = False) -> Column:
    """Points of one class on the column named `text`; each keyword or bonus counts once.
    One expression text a class: building it call by call costs more than running it."""
    terms = [f"IF({_occurs(text, keyword, word_boundary)}, {rule.keyword_points}, 0)" for keyword in rule.keywords]
    for bonus in rule.bonuses:
        hits = [_occurs(text, literal, word_boundary) for literal in bonus.literals] + [_matches(text, p) for p in bonus.patterns]
        terms.append(f"IF({' OR '.join(hits)}, {bonus.points}, 0)")
    return F.expr(" + ".join(terms) or "0")


def class_scores(
    df: DataFrame,
    text: str = "raw_text",
    payload: str | None = None,
    class_rules=rules.CLASS_RULES,
    word_boundary: bool = False,
) -> DataFrame:
    """AGG-5: one score column per class; no join, no shuffle. The upper-cased text is a
    column of its own, worked out once."""
    blank = F.lit("")
    joined = F.concat_ws(" ", F.coalesce(F.col(text), blank), F.coalesce(F.col(payload), blank) if payload else blank)
    return df.withColumn("_upper", F.upper(joined)).select(
        *df.columns, *[class_score("_upper", r, word_boundary).alias(SCORE_PREFIX + r.doc_type) for r in class_rules])


def best_class(scored: DataFrame, class_rules=rules.CLASS_RULES) -> DataFrame:
    """WIN-1 / MTH-3 on the columns of `class_scores`: the class with most points, the
    earlier one on ties, none for 0."""
    best = F.greatest(*[SCORE_PREFIX + r.doc_type for r in class_rules])
    kind, title = F.when(F.col("_best") == 0, "unknown"), F.when(F.col("_best") == 0, rules.UNKNOWN_TITLE)
    for r in class_rules:
        wins = F.col(SCORE_PREFIX + r.doc_type) == F.col("_best")
        kind, title = kind.when(wins, r.doc_type), title.when(wins, r.title)
    return scored.withColumn("_best", best).select(
        *scored.columns, kind.alias("document_type"), title.alias("document_name"), class_confidence(F.col("_best")).alias("confidence"))


def classify(df: DataFrame, text: str = "raw_text", payload: str | None = None,
             class_rules=rules.CLASS_RULES, word_boundary: bool = False) -> DataFrame:
    """Adds document_type, document_name, confidence and the all_scores map."""
    pairs = [x for r in class_rules for x in (F.lit(r.doc_type), F.col(SCORE_PREFIX + r.doc_type))]
    typed = best_class(class_scores(df, text, payload, class_rules, word_boundary), class_rules)
    return typed.select(*df.columns, "document_type", "document_name", "confidence", F.create_map(*pairs).alias("all_scores"))


ANCHOR = 3  # characters of a keyword that a text must hold before it is searched
SALTS = 8  # parts that the texts of one anchor are dealt to
DIRECT = 200  # keywords up to which each text is searched where it lies


def _grams(text: Column, size: int) -> Column:
    """The different stretches of `size` characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _anchored(keywords: DataFrame) -> DataFrame:
    """Each keyword with its anchor: of its stretches the one that fewest keywords hold."""
    words = keywords.select("doc_type", F.upper("keyword").alias("keyword"), "weight").where(F.length("keyword") > 0)
    grams = words.select("keyword").distinct().select("keyword", F.explode(F.when(
        F.length("keyword") < ANCHOR, F.array("keyword")).otherwise(_grams(F.col("keyword"), ANCHOR))).alias("anchor"))
    spread = grams.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(spread, "anchor").groupBy("keyword").agg(F.min(F.struct("n", "anchor"))["anchor"].alias("_anchor"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return words.join(rarest, "keyword").select("doc_type", "keyword", "weight", "_anchor", salts.alias("_salt"))


def _searched(df: DataFrame, few: list[Row], words: DataFrame, text: str) -> DataFrame:
    hits = [F.when(F.col("_upper").contains(F.lit(row["keyword"])), F.struct(*[
        F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in words.schema])) for row in few]
    # the outer form: an inferred filter would search all texts once more
    return df.withColumn("_upper", F.upper(F.coalesce(F.col(text), F.lit("")))).select(
        *df.columns, F.inline_outer(F.array_compact(F.array(*hits)))).where("keyword IS NOT NULL")


def keyword_hits(df: DataFrame, keywords: DataFrame, text: str = "raw_text") -> DataFrame:
    """JN-1: texts x user dictionary by substring; one row per hit, for dictionaries of any size.

    At most DIRECT keywords are searched in each text where it lies, and no text travels. Of
    more, a text can only hold a keyword whose anchor it holds, so the different
    three-character stretches of the different texts meet the anchors in an equi join
    (frequent anchors are dealt to several tasks by text); what meets is searched in the text.
    """
    words = keywords.select("doc_type", F.upper("keyword").alias("keyword"), "weight").where(F.length("keyword") > 0)
    few = words.limit(DIRECT + 1).collect()
    if 0 < len(few) <= DIRECT:
        return _searched(df, few, words, text)
    upper = df.withColumn("_upper", F.upper(F.coalesce(F.col(text), F.lit("")))).withColumn("_text", F.xxhash64("_upper"))
    grams = F.flatten(F.array(*[_grams(F.col("_upper"), size) for size in range(1, ANCHOR + 1)]))
    texts = upper.select("_text", "_upper").dropDuplicates(["_text"]).select("_text", F.explode(grams).alias("_anchor")).withColumn("_salt", F.pmod("_text", F.lit(SALTS)).cast("int"))
    met = texts.join(_anchored(keywords), ["_anchor", "_salt"]).select("_text", "doc_type", "keyword", "weight")
    return upper.join(met, "_text").where(F.col("_upper").contains(F.col("keyword"))).select(
        *df.columns, "doc_type", "keyword", "weight")


def keyword_scores(df: DataFrame, keywords: DataFrame, keys: list[str], text: str = "raw_text") -> DataFrame:
    """JN-1 + AGG-5 for user dictionaries: summed weights per text and class."""
    hits = keyword_hits(df.select(*keys, text), keywords, text)
    return hits.groupBy(*keys, "doc_type").agg(
        F.sum("weight").alias("score"), F.count(F.lit(1)).alias("n_hits")
    )
