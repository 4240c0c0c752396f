"""People who share an identity: groups linked by anything two users have in common
(AGG-15, AGG-16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.functions.text import clean_identifier, none_if_blank, squeeze
from idlens.operators.skew import join_to_one
from idlens.session import shared_dir


def record_tokens(records: DataFrame) -> DataFrame:
    """user_id, token: what a document record ties to its user, its id number and its
    holder's name with birth date. Missing values tie to nothing."""

    def token(kind: str, *parts: Column) -> Column:
        known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
        return F.when(known, F.concat_ws(chr(31), F.lit(kind), *parts))

    number = none_if_blank(clean_identifier(F.col("id_number")))
    name = none_if_blank(F.lower(squeeze(F.col("name"))))
    both = F.array(token("id", F.col("doc_type"), number), token("person", name, none_if_blank(F.col("dob").cast("string"))))
    return records.select("user_id", F.explode(F.array_compact(both)).alias("token"))


def shared_links(tokens: DataFrame) -> DataFrame:
    """a, b: each user of a token linked with the token's smallest user. A token of n users
    gives n - 1 links, not all its pairs, and a hot one is not gathered anywhere."""
    ties = tokens.where(F.col("user_id").isNotNull() & F.col("token").isNotNull()).distinct()
    centres = ties.groupBy("token").agg(F.min("user_id").alias("b"), F.count(F.lit(1)).alias("n"))
    return join_to_one(ties, centres, "token", "n").where("user_id <> b").select(F.col("user_id").alias("a"), "b")


def _cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def connected(links: DataFrame) -> DataFrame:
    """member, group: every user of a link with the smallest user that links reach.

    Alternating stars on DataFrames: a large star ties a user's larger neighbours to the
    smallest user among it and its neighbours, a small star does so with the smaller
    ones. The number of rows does not grow, the depth of each group's tree shrinks by
    a constant factor a round, and a round is written to the shared folder before the
    next one. It ends when a round changes nothing.
    """

    def star(rows: DataFrame, total: int) -> DataFrame:
        """Rows (u, v), `total` at most, with the least user around u."""
        least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count(F.lit(1)).alias("rows"))
        return join_to_one(rows, least, "u", "rows", total)

    def pairs(rows: DataFrame, up: Column, down: Column) -> DataFrame:
        return rows.select(up.alias("u"), down.alias("v")).where("u <> v").distinct()

    def marked(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = _cut(pairs(links, F.greatest("a", "b"), F.least("a", "b")))
    mark = marked(now)
    while mark[0]:
        mirrored = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _cut(pairs(star(mirrored, 2 * mark[0]).where("v > u"), F.col("v"), F.col("least")))
        # u > v in all rows now, so the least around u is a neighbour
        tied = star(large, mark[0])
        now = _cut(pairs(tied, F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")), F.col("least")))
        seen, mark = mark, marked(now)
        if mark == seen:
            break
    return now.select(F.col("u").alias("member"), F.col("v").alias("group")).unionAll(now.select("v", "v").distinct())


def identity_groups(users: DataFrame, tokens: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """user_id, group_id, group_size for every user (`users.id`): the users that shared tokens
    reach, one after another, under their smallest id. `pairs(a, b)` are links of another
    kind, such as faces that match. A user who shares nothing is a group of its own; null
    users and null tokens link nothing.
    """
    links = shared_links(tokens)
    if pairs is not None:
        links = links.unionByName(pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"))
    found = connected(links)
    named = _cut(users.select(F.col("id").alias("user_id")).distinct().join(
        found.withColumnRenamed("member", "user_id"), "user_id", "left").select(
        "user_id", F.coalesce("group", "user_id").alias("group_id")))
    sizes = named.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return join_to_one(named, sizes, "group_id", "group_size").select("user_id", "group_id", "group_size")
