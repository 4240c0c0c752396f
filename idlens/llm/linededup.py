"""Line dedup through a deletion-neighbourhood join.

A line is dropped when an earlier line is equal to it or within one edit (a code point
inserted, deleted or replaced); the earliest of all stays. Earlier means a smaller
(doc_id, text hash, line number). Lines count without the white space at their ends;
lines of fewer than `min_chars` code points stay as they are.

Two lines within one edit share a deletion variant: of equal length, both lose the
same place; of different length, the longer one's variant is the shorter line itself.
Variants are emitted as hashed keys and equal ones joined. Every key compares each
member with the earliest of the other kind only, so a hot key emits no pairs, and what
it yields is verified by the edit distance of the two texts.

Writing all variants of every line would multiply the corpus by its line length. A
line therefore first looks for a partner by coarser keys: cut into pieces, two lines
within one edit agree in all pieces but one (the shorter length gives the cuts). Halves
choose the lines whose texts are fetched, sixteenths the places whose variants are
emitted; no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.llm.common import cut

MIN_CHARS = 10
COARSE, FINE = 2, 16  # pieces
#: Rows of fixed width (some 40 bytes) up to which one side of a join goes to the other.
AT_HAND = 250_000
WHITE = " \t\r\x0b\x0c"
POSITION = ("doc_id", "text_hash", "line_no")


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, line_no (from 0), line, n, k1, k2 (hashes that identify the line)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "_raw"))
    rows = rows.withColumn("line", F.trim(F.col("_raw"), F.lit(WHITE))).withColumn("n", F.char_length("line"))
    return rows.where(F.col("n") >= min_chars).select(
        *POSITION, "line", "n", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"))


def near_side(df: DataFrame) -> DataFrame:
    """A stored table, marked to be sent to the other side of a join if it is small; a
    larger one is shuffled."""
    return F.broadcast(df) if df.limit(AT_HAND + 1).count() <= AT_HAND else df


def edge(shorter: Column, piece: Column | int, pieces: int) -> Column:
    return F.floor(shorter * piece / pieces).cast("int")


def piece_keys(pieces: int) -> list[Column]:
    """The line as the shorter or equally long one of a pair, without each of its pieces;
    then the same as the longer one."""
    keys = []
    for shorter in (F.col("n"), F.col("n") - 1):
        for p in range(pieces):
            tail = (shorter - edge(shorter, p + 1, pieces)).cast("int")
            keys.append(F.xxhash64(F.lit(p), shorter, F.substring(F.col("line"), F.lit(1), edge(shorter, p, pieces)), F.when(
                tail > 0, F.substring(F.col("line"), F.col("n") - tail + 1, tail))))
    return keys


def first_lines(lines: DataFrame) -> DataFrame:
    """k1, k2 -> first (position of the earliest occurrence) and the piece keys q0, q1, ..."""
    keyed = lines.select("k1", "k2", F.struct(*POSITION).alias("_at"), *[k.alias(f"q{i}") for i, k in enumerate(piece_keys(COARSE))])
    return keyed.groupBy("k1", "k2").agg(F.min("_at").alias("first"), *[F.min(f"q{i}").alias(f"q{i}") for i in range(2 * COARSE)])


def with_partners(keyed: DataFrame, pieces: int) -> DataFrame:
    """k1, part, key -> the distinct (k1, part) whose key another line has, too. The two ends
    of each shared key's members come with it; only keys of three or more are looked up again.
    One of a pair is the shorter line and one the longer, so either end is given both parts."""
    shared = cut(keyed.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max("part").alias("part"), F.count("*").alias("_n")).where("a <> b"))
    part = F.col("part") % pieces
    ends = shared.select(F.explode(F.array("a", "b")).alias("k1"), part.alias("part")).select(
        "k1", F.explode(F.array("part", F.col("part") + pieces)).alias("part"))
    more = cut(shared.where("_n > 2").select("key"))
    others = keyed.join(near_side(more), "key", "left_semi").select("k1", "part")
    return ends.unionAll(others).distinct()


def variants(members: DataFrame) -> DataFrame:
    """k1, role ('same', 'short', 'long'), key: the deletion neighbourhood of k1, line, n
    within its piece `part`."""
    shorter = F.when(F.col("part") < FINE, F.col("n")).otherwise(F.col("n") - 1)
    piece = F.col("part") % FINE
    lo, hi = edge(shorter, piece, FINE), edge(shorter, piece + 1, FINE)
    last = F.when(F.col("part") < FINE, hi - 1).otherwise(hi)
    placed = members.withColumn("_i", F.explode(F.when(last >= lo, F.sequence(lo, last))))
    rest = F.concat(F.substring(F.col("line"), F.lit(1), F.col("_i")), F.substring(F.col("line"), F.col("_i") + 2, F.col("n")))
    equal = placed.where(F.col("part") < FINE).select("k1", F.lit("same").alias("role"), F.xxhash64(F.lit("same"), F.col("_i"), rest).alias("key"))
    longer = placed.where(F.col("part") >= FINE).select("k1", F.lit("long").alias("role"), F.xxhash64(rest).alias("key"))
    short = members.where(F.col("part") < FINE).select("k1", F.lit("short").alias("role"), F.xxhash64("line").alias("key"))
    return equal.unionAll(longer).unionAll(short)


def earlier_neighbours(texts: DataFrame) -> DataFrame:
    """k1, k2 of the lines with an earlier one within one edit, and near_first, its place.
    `texts`: k1, k2, first, line, n of lines that may have one."""
    fine = with_partners(texts.select("k1", F.posexplode(F.array(*piece_keys(FINE))).alias("part", "key")), FINE)
    emitted = variants(texts.select("k1", "line", "n").join(fine, "k1"))
    shared = cut(emitted.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("key"))
    met = emitted.join(near_side(shared), "key", "left_semi").distinct().join(texts, "k1")
    own = F.struct("first", "k1", "k2", "line")
    least = lambda role: F.min(F.when(F.col("role") == role, own))
    met = cut(met)
    heads = met.groupBy("key").agg(*[least(r).alias(r) for r in ("same", "short", "long")])
    other = F.when(F.col("role") == "same", F.col("same")).when(F.col("role") == "short", F.col("long")).otherwise(F.col("short"))
    return met.join(heads, "key").withColumn("_o", other).where(
        (F.col("_o.first") < F.col("first")) & F.levenshtein(F.col("line"), F.col("_o.line"), 1).between(0, 1)).groupBy("k1", "k2").agg(
        F.min("_o.first").alias("near_first"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, line_no, kind ('exact' or 'near'), kept_doc_id, kept_line_no: the
    lines that go, and the earliest line that stands for them.

    Null and empty texts have no lines. Rows that share doc_id and text are one
    document here. 'near' names an earlier line within one edit of this line's text;
    it may itself have gone for a still earlier one. Other columns are not read.
    """
    lines = lines_of(docs, min_chars)
    first = cut(first_lines(lines))
    coarse = first.select("k1", F.posexplode(F.array(*[f"q{i}" for i in range(2 * COARSE)])).alias("part", "key"))
    members = cut(with_partners(coarse, COARSE).select("k1").distinct().join(first.select("k1", "k2", "first"), "k1"))
    texts = cut(lines.select("k1", "k2", F.struct(*POSITION).alias("_at"), "line", "n").join(near_side(members), ["k1", "k2"]).where(
        F.col("_at") == F.col("first")).select("k1", "k2", "first", "line", "n").distinct())
    verdict = first.select("k1", "k2", "first").join(earlier_neighbours(texts), ["k1", "k2"], "left")
    met = lines.select(*POSITION, "k1", "k2").join(verdict, ["k1", "k2"])
    own = F.struct(*POSITION)
    kept = F.when(own != F.col("first"), F.col("first")).otherwise(F.col("near_first"))
    return met.withColumn("_kept", kept).where(F.col("_kept").isNotNull()).select(
        *POSITION, F.when(own != F.col("first"), F.lit("exact")).otherwise(F.lit("near")).alias("kind"),
        F.col("_kept.doc_id").alias("kept_doc_id"), F.col("_kept.line_no").alias("kept_line_no")).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, all columns as they were but text, which lacks its dropped lines;
    adds n_lines, n_exact and n_near. Null texts stay null."""
    gone = dropped_lines(docs, min_chars).groupBy("doc_id", "text_hash").agg(
        F.collect_list("line_no").alias("_gone"), F.sum((F.col("kind") == "exact").cast("bigint")).alias("_exact"), F.count("*").alias("_all"))
    gone = gone.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "_gone", "_exact", "_all")
    same = docs["doc_id"].eqNullSafe(gone["_doc_id"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"])
    lines = F.split(docs["text"], "\n")
    left = F.when(gone["_gone"].isNull(), docs["text"]).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone["_gone"], i)), "\n"))
    exact = F.coalesce(gone["_exact"], F.lit(0))
    return docs.join(gone, same, "left").select(
        *[left.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")],
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"), exact.alias("n_exact"),
        (F.coalesce(gone["_all"], F.lit(0)) - exact).alias("n_near"))
