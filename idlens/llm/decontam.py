"""Benchmark decontamination: a prefix-filtered set join on word shingles.

A window of an item (its `window` consecutive words) is contained in a document when
all its shingles are, one after another. For exact containment the necessary prefix
of a window, its shingles ordered by rarity in the whole corpus, is its rarest one:
only where that one occurs can the window stand, at a known distance. So

1. every shingle of the items is counted over all documents;
2. each distinct window is keyed by its rarest shingle and that shingle's place;
3. document positions are joined with the keys; the window must fit between the
   document's first and last word (length and positional bounds);
4. the window's words are compared with the document's.

The documents never move: the joins of steps 1 and 3 send the items' windows to
them, in blocks of at most `BLOCK` windows, so what is broadcast has a fixed bound
and a larger benchmark takes more passes instead. Only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.llm.common import ascii_lower, cut, words

#: Runs of ASCII digits, letters (after lower-casing A-Z) and anything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
BLOCK = 50_000  # windows or shingles sent to the executors at a time; about 10 MB


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), ITEM_WORD)


def shingle_key(ws: Column, at: Column, size: int) -> Column:
    """Hash of the `size` words from position `at` (from 0) on."""
    return F.xxhash64(*[F.get(ws, at + i) for i in range(size)])


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """window_words -> the distinct windows; an item of fewer words is one window."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - window))
    return items.where(F.size("_w") > 0).select("item_id", "_w", F.explode(at).alias("_at")).select(
        "item_id", F.slice("_w", F.col("_at") + 1, window).alias("window_words"))


def spread_shingles(docs: DataFrame, size: int) -> DataFrame:
    """A row for each word position: _pos (from 0; null without words) and _key, the
    shingle that begins there (null where fewer than `size` words are left)."""
    placed = docs.select("*", F.posexplode_outer("_w").alias("_pos", "_word"))
    return placed.withColumn("_key", F.when(
        F.col("_pos") + size <= F.size("_w"), shingle_key(F.col("_w"), F.col("_pos"), size)))


def blocks(table: DataFrame, by: str, block: int) -> list[DataFrame]:
    """Parts of at most about `block` rows each, by a hash."""
    n = -(-table.count() // block)
    return [table.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) for i in range(n)] if n > 1 else [table]


def rarest_shingles(docs: DataFrame, windows: DataFrame, size: int, block: int) -> DataFrame:
    """windows (window_words of at least `size` words) -> adds _prefix, the hash of the
    window's rarest shingle over all documents, and _shift, its place in the window."""
    at = F.sequence(F.lit(0), F.size("window_words") - size)
    keyed = windows.select("window_id", F.explode(at).alias("_shift"), "window_words").select(
        "window_id", "_shift", shingle_key(F.col("window_words"), F.col("_shift"), size).alias("_prefix"))
    known = cut(keyed.select("_prefix").distinct())
    counts = None
    for part in blocks(known, "_prefix", block):
        seen = spread_shingles(docs.select("_w"), size).join(
            F.broadcast(part), F.col("_key") == F.col("_prefix"), "left_semi").groupBy("_key").agg(F.count("*").alias("_df"))
        counts = seen if counts is None else counts.unionAll(seen)
    order = F.struct(F.coalesce("_df", F.lit(0)), "_shift", "_prefix")
    rarest = keyed.join(counts, F.col("_prefix") == F.col("_key"), "left").groupBy("window_id").agg(F.min(order).alias("_r"))
    return windows.join(rarest.select("window_id", F.col("_r._shift").alias("_shift"), F.col("_r._prefix").alias("_prefix")), "window_id")


def matches(docs: DataFrame, windows: DataFrame, window: int, size: int, block: int) -> DataFrame:
    """Occurrences of `windows` in documents (_w and what `docs` brings along): adds
    start, length, window_id. Every document keeps a row with nulls in these."""
    found = docs.select(*[c for c in docs.columns if c != "_w"], F.size("_w").cast("bigint").alias("n_words"),
                        *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("length", "int"), ("window_id", "bigint"))])
    # windows of fewer words than a shingle are looked up by all their words
    for length in sorted({min(size, r[0]) for r in windows.select(F.least(F.size("window_words"), F.lit(size))).distinct().collect()}):
        own = windows.where(F.least(F.size("window_words"), F.lit(size)) == length)
        for part in blocks(cut(rarest_shingles(docs, own, length, block)), "window_id", block):
            start = F.col("_pos") - F.col("_shift")
            met = spread_shingles(docs, length).join(F.broadcast(part), F.col("_key") == F.col("_prefix")).where(
                (start >= 0) & (start + F.size("window_words") <= F.size("_w"))).where(
                F.slice("_w", start + 1, F.size("window_words")) == F.col("window_words"))
            found = found.unionByName(met.select(
                *[c for c in docs.columns if c != "_w"], F.size("_w").cast("bigint").alias("n_words"),
                start.cast("int").alias("start"), F.size("window_words").alias("length"), "window_id"))
    return found


def covered(spans: Column) -> Column:
    """Positions in the union of spans (start, length), sorted by start."""
    none = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, none, lambda a, s: F.struct(
        F.greatest(a["upto"], s["start"] + s["length"]).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["upto"], s["start"]))).alias("n")))["n"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, item_ids (sorted as strings) of every document.

    A word is hit if it lies in any occurrence of a window. Null and empty texts have
    no words and no hits; items without a word have no window; no items: no hits.
    Repeated rows give a row each; further columns of either table are not read.
    A document's matches are gathered in one row, as its words were.
    """
    known = cut(items.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("_w")))
    occurring = item_windows(known, window)
    windows = cut(occurring.select("window_words").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    owners = windows.join(occurring, "window_words").select("window_id", "item_id").distinct()
    key = ["doc_id", "text_hash"]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("_w"))
    found = matches(keyed, windows, window, shingle, block)
    per_doc = cut(found.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.sum(F.col("start").isNull().cast("int")).alias("_copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length")))).alias("_spans"),
        F.collect_set("window_id").alias("_windows")))
    met = per_doc.where(F.size("_windows") > 0).select(*key, F.explode("_windows").alias("window_id"))
    named = met.join(owners, "window_id").groupBy(*key).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    out = per_doc.join(named, same, "left").select(
        "doc_id", "text_hash", "n_words", covered(F.col("_spans")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "_copies")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copies", "_copy")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents without a hit word, all their columns as they were."""
    hit = decontaminate(docs, items, window, shingle).where(F.col("n_hit") > 0).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(hit["_doc_id"]) & (F.xxhash64(docs["text"]) == hit["_text_hash"])
    return docs.join(hit, same, "left_anti")
