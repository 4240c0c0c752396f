"""Second sources against the text: QR, registry, face vectors
(TXT-9, JN-2, JN-3, JN-9, JN-10, AGG-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens import rules
from idlens.functions.numbers import round_even
from idlens.functions.text import let, mutually_contained, none_if_blank, present, strip


def qr_attributes(payload: Column) -> Column:
    """TXT-9: key="value" attributes of a payload; a payload without any is kept
    whole under raw_payload."""
    pairs = [
        x for k in rules.QR_ATTRIBUTES
        for x in (F.lit(k), strip(none_if_blank(F.regexp_extract(payload, f'(?i){k}="([^"]+)"', 1))))
    ]
    found = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    whole = F.when(payload.isNotNull(), F.create_map(F.lit("raw_payload"), payload))
    return let(found, lambda m: F.when(F.size(m) > 0, m).otherwise(whole))


def parse_qr(qr: DataFrame, payload: str = "payload") -> DataFrame:
    return qr.withColumn("parsed_qr_fields", qr_attributes(F.col(payload)))


def first_qr(qr: DataFrame, keys: list[str]) -> DataFrame:
    """One payload per page, pyzbar before opencv. The minimum combines before the
    shuffle, so a page with many decodes does not travel."""
    order = F.when(F.col("method") == "pyzbar", 0).otherwise(1)
    best = F.min(F.struct(order.alias("o"), F.col("payload").alias("payload")))
    return qr.where(present(F.col("payload"))).groupBy(*keys).agg(best["payload"].alias("payload"))


def qr_check(fields: Column, payload: Column, parsed: Column) -> Column:
    """AGG-14: matches, mismatches and the verdict of one document."""
    q_name, q_dob = F.try_element_at(parsed, F.lit("name")), F.try_element_at(parsed, F.lit("dob"))
    name, dob = fields["name"], fields["dob"]
    number = F.coalesce(*[none_if_blank(fields[k]) for k in ("aadhaar_number", "dl_number", "passport_number")])
    both_names, both_dobs = present(q_name) & present(name), present(q_dob) & present(dob)
    name_ok = mutually_contained(F.lower(strip(q_name)), F.lower(strip(name)))
    dob_ok = mutually_contained(q_dob, dob)
    number_ok = F.replace(payload, F.lit(" "), F.lit("")).contains(F.regexp_replace(number, r"\s+", ""))
    mismatches = F.array_compact(F.array(
        F.when(both_names & ~name_ok, F.concat(
            F.lit("Name mismatch: QR='"), q_name, F.lit("', OCR='"), name, F.lit("'"))),
        F.when(both_dobs & ~dob_ok, F.concat(
            F.lit("DOB mismatch: QR='"), q_dob, F.lit("', OCR='"), dob, F.lit("'"))),
    ))

    def one(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    matches = one(both_names & name_ok) + one(both_dobs & dob_ok) + one(number_ok)
    absent = F.struct(
        F.lit(False).alias("qr_detected"), F.lit(None).cast("string").alias("qr_data"),
        F.lit(None).cast("boolean").alias("qr_ocr_match"), F.lit(0).alias("matches"),
        F.array(F.lit("QR code not detected on document")).alias("mismatches"),
    )
    unparsed = F.map_contains_key(parsed, F.lit("raw_payload"))
    seen = let(F.struct(matches.alias("n"), mismatches.alias("m")), lambda s: F.struct(
        F.lit(True).alias("qr_detected"), payload.alias("qr_data"),
        ((F.size(s["m"]) == 0) & ((s["n"] > 0) | unparsed)).alias("qr_ocr_match"),
        s["n"].alias("matches"), s["m"].alias("mismatches")))
    return F.when(present(payload), seen).otherwise(absent)


def check_payload(df: DataFrame, payload: str = "payload", fields: str = "fields") -> DataFrame:
    """JN-2 / AGG-14 once payload and fields are on one row."""
    both = F.struct(F.col(fields).alias("f"), F.col(payload).alias("p"), qr_attributes(F.col(payload)).alias("a"))
    return df.withColumn("qr_check", let(both, lambda s: qr_check(s["f"], s["p"], s["a"])))


def cross_check(fields_df: DataFrame, qr: DataFrame, keys: list[str]) -> DataFrame:
    """JN-2: documents left-joined to their (single) payload; adds `qr_check`."""
    return check_payload(fields_df.join(first_qr(qr, keys), keys, "left"))


def containment_rate(
    docs: DataFrame, qr: DataFrame, keys: list[str], fields_map: str = "fields_map",
    threshold: float = rules.CONTAINMENT_THRESHOLD,
) -> DataFrame:
    """JN-3: % of field values found in the payload (case-insensitive); tampered
    unless above the threshold. Fields stay on their row: no explode, one join."""
    joined = docs.join(first_qr(qr, keys), keys, "left")
    payload = F.lower(F.coalesce(F.col("payload"), F.lit("")))
    values = F.map_values(F.col(fields_map))
    total = F.size(values)
    found = F.size(F.filter(values, lambda v: payload.contains(F.lower(v))))
    staged = joined.withColumn("_rate", F.when(total > 0, found / total * 100).otherwise(0.0))
    return staged.select(
        *keys, round_even(F.col("_rate"), 2).alias("confidence_score"),
        (F.col("_rate") <= threshold).alias("tamper_detected"),
    )


# --- registry ------------------------------------------------------------------------


#: A number that hides all but its last four digits, without its separators.
MASKED = "^X{4,}[0-9]{4}$"


def id_key(number: Column) -> Column:
    return F.upper(F.regexp_replace(number, r"[-\s]", ""))


def _norm(c: Column) -> Column:
    return F.lower(strip(c))


def verify_registry(docs: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """JN-9. `docs`: keys, doc_type, id_number, name, dob, gender. `registry`: doc_type,
    id_number, name, dob, gender.

    A full number matches one registry row. A masked number (a run of X, then four
    digits; an X elsewhere is part of the number) only shows these four
    digits, which thousands of people share, so it is never paired with all of
    them: whether someone with those digits and that name / birth date / gender
    exists is looked up in a de-duplicated set of keys, by one equi join for all facts.
    """
    reg = registry.select(
        "doc_type", id_key(F.col("id_number")).alias("id"), _norm(F.col("name")).alias("n"),
        F.col("dob").alias("b"), F.upper(F.substring(F.col("gender"), 1, 1)).alias("g"),
    ).where(F.col("id").isNotNull())
    d = docs.select(
        *keys, F.col("doc_type"), id_key(F.col("id_number")).alias("id"), _norm(F.col("name")).alias("n"),
        F.col("dob").alias("b"), F.upper(F.substring(F.col("gender"), 1, 1)).alias("g"),
    )
    masked = F.coalesce(F.col("id").rlike(MASKED), F.lit(False))

    one = reg.groupBy("doc_type", "id").agg(F.min(F.struct("n", "b", "g")).alias("r"))
    numbered = d.where(~masked & F.col("doc_type").isNotNull() & F.col("id").isNotNull()).join(one, ["doc_type", "id"], "left")
    # what can't match anything stays where it is
    bare = d.where(F.col("doc_type").isNull() | F.col("id").isNull())
    full = numbered.unionByName(bare, allowMissingColumns=True)
    full = full.select(
        *keys, F.col("r").isNotNull().alias("id_found"),
        F.coalesce(F.col("n") == F.col("r.n"), F.lit(False)).alias("name_verified"),
        F.coalesce(F.col("b") == F.col("r.b"), F.lit(False)).alias("dob_verified"),
        F.coalesce(F.col("g") == F.col("r.g"), F.lit(False)).alias("gender_verified"),
    ).withColumn("is_verified", F.col("id_found") & F.col("name_verified") & F.col("dob_verified")
                 & F.col("gender_verified"))

    # every fact that a masked claim asks for is a (kind, key); one join answers all of them
    kinds = {"id_found": [], "name_verified": ["n"], "dob_verified": ["b"], "gender_verified": ["g"], "is_verified": ["n", "b", "g"]}

    def facts(df: DataFrame) -> Column:
        keys = [F.struct(F.lit(kind).alias("kind"), F.when(
            F.expr(" AND ".join(f"{c} IS NOT NULL" for c in ["doc_type", "t", *cols])),
            F.concat_ws(chr(31), "doc_type", "t", *cols)).alias("key")) for kind, cols in kinds.items()]
        return F.explode(F.filter(F.array(*keys), lambda x: x["key"].isNotNull())).alias("fact")

    claim = ["doc_type", "t", "n", "b", "g"]
    shown = reg.withColumn("t", F.right(F.col("id"), F.lit(4)))
    there = shown.select(facts(shown)).select("fact.*").distinct()
    part = d.where(masked).withColumn("t", F.right(F.col("id"), F.lit(4)))
    asked = part.select(*claim).distinct()
    met = asked.select(*claim, facts(asked)).select(*claim, "fact.*").join(there, ["kind", "key"])
    answers = met.groupBy(*claim).agg(*[F.max(F.col("kind") == kind).alias(kind) for kind in kinds]).withColumnsRenamed(
        {c: f"_{c}" for c in claim})
    same = None
    for c in claim:
        equal = part[c].eqNullSafe(answers[f"_{c}"])
        same = equal if same is None else same & equal
    part = part.join(answers, same, "left").withColumns({kind: F.coalesce(F.col(kind), F.lit(False)) for kind in kinds})
    return full.unionByName(part.select(*full.columns))


# --- faces ------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equally long vectors, in double precision."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def match_faces(pairs: DataFrame, vectors: DataFrame, threshold: float = rules.FACE_MATCH_THRESHOLD) -> DataFrame:
    """JN-10: `pairs(pair_id, left_id, right_id)` against `vectors(vec_id, embedding)`
    by two equi joins; matched when the score (cosine x 100) is above the threshold."""
    left = vectors.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("a"))
    right = vectors.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("b"))
    joined = pairs.join(left, "left_id").join(right, "right_id")
    scored = joined.withColumn("match_score", cosine(F.col("a"), F.col("b")) * 100)
    return scored.select(
        *pairs.columns, "match_score",
        F.coalesce(F.col("match_score") > threshold, F.lit(False)).alias("matched"),
    )
