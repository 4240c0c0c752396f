"""Words to page texts, engine choice, manifests (AGG-1..4, WIN-2, FLT-1, PRJ-2, SRC-1..3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from idlens import rules
from idlens.functions.numbers import round_even
from idlens.functions.text import let, looks_like_name, name_letters, strip

#: What a run of words carries besides its keys.
RUN_TYPES = {
    "first": pa.int64(), "n": pa.int64(), "text": pa.string(), "seqs": pa.list_(pa.int64()), "words": pa.list_(pa.string()),
    "conf_sum": pa.float64(), "name": pa.struct([("seq", pa.int64()), ("_letters", pa.string())]),
}


def is_kept() -> Column:
    """FLT-1: non-blank words; Tesseract words also need a positive confidence."""
    confident = (F.col("engine") != "tesseract") | (F.col("confidence") > 0)
    return (F.coalesce(strip(F.col("text")), F.lit("")) != "") & F.coalesce(confident, F.lit(False))


def kept_words(blocks: DataFrame) -> DataFrame:
    """FLT-1 as a filter."""
    return blocks.where(is_kept()).withColumn("text", strip(F.col("text")))


def word_runs(words: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring rows (keys, seq, word, confidence, letters; a null word is one left out)
    of the same keys, with rising seq, joined to one row before they travel: keys, first
    (the first seq), n, text (words joined by spaces), conf_sum and the first name; seqs
    where they are not consecutive, and words where one of several holds a space. Rows in
    another order only give more and shorter runs; keys with left-out rows alone keep one
    with n = 0. A batch is worked on at a time, so memory is bounded by it.
    """
    def changes(c: pa.ChunkedArray) -> np.ndarray:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        return np.concatenate([[True], other.to_numpy()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).combine_chunks()
            if not len(t):
                continue
            segment = np.cumsum(np.logical_or.reduce([changes(t[k]) for k in keys])) - 1
            kept = pc.is_valid(t["word"]).to_numpy()
            alone = np.flatnonzero(np.diff(segment, prepend=-1))
            alone = alone[~np.isin(segment[alone], segment[kept])]
            place, w = np.flatnonzero(kept), t.filter(pa.array(kept))
            seq, unnumbered = pc.fill_null(w["seq"], 0).to_numpy(), pc.is_null(w["seq"]).to_numpy()
            step = np.diff(seq, prepend=seq[:1])
            begins = (np.diff(segment[kept], prepend=-1) != 0) | (step <= 0) | unnumbered | np.roll(unnumbered, 1)
            at = np.flatnonzero(begins)
            ends = np.append(at[1:], len(place))
            offsets = pa.array(np.append(at, len(place)).astype(np.int32))
            word, number, known = (w[c].combine_chunks() if len(place) else pa.array([], w[c].type) for c in ("word", "seq", "confidence"))

            def lists(values: pa.Array, wanted: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~wanted))

            def any_of(flags: np.ndarray) -> np.ndarray:
                before = np.cumsum(np.append(0, flags))
                return before[ends] > before[at]

            spaced, uneven = pc.match_substring(word, " ").to_numpy(False), (step != 1) & ~begins
            confident = pc.is_valid(known).to_numpy(False)
            conf = np.add.reduceat(pc.fill_null(known, 0.0).to_numpy(False), at) if len(at) else np.zeros(0)
            named = np.flatnonzero(pc.is_valid(w["letters"]).to_numpy())
            first_name = np.append(named, len(place))[np.searchsorted(named, at)]
            unnamed = first_name >= ends
            pick = pa.array(np.where(unnamed, 0, first_name), mask=unnamed)
            letters = w["letters"].combine_chunks().take(pick) if len(place) else pa.array([], pa.string())
            values = [
                number.take(pa.array(at)), pa.array(ends - at), pc.binary_join(lists(word, np.ones(len(at), bool)), " "),
                lists(number, any_of(uneven)), lists(word, any_of(spaced) & (ends - at > 1)),
                pa.array(conf, mask=~any_of(confident)),
                pa.StructArray.from_arrays([number.take(pick), letters], ["seq", "_letters"], mask=pa.array(unnamed)),
            ]
            heads = t.select(keys)
            runs = heads.take(pa.array(place[at]))
            empty = heads.take(pa.array(alone))
            for (name, kind), column in zip(RUN_TYPES.items(), values, strict=True):
                runs = runs.append_column(name, column.cast(kind))
                empty = empty.append_column(name, pa.array([0] * len(alone), kind) if name == "n" else pa.nulls(len(alone), kind))
            yield from pa.concat_tables([runs, empty]).combine_chunks().to_batches()

    schema = words.select(*keys).schema
    for name, kind in RUN_TYPES.items():
        schema = schema.add(name, from_arrow_type(kind))
    return words.select(*keys, "seq", "word", "confidence", "letters").mapInArrow(run, schema)


def line_texts(blocks: DataFrame, keys: list[str], names: bool = False) -> DataFrame:
    """AGG-1, first level: words of a (block, line) joined by spaces, with the
    position of the first word and the line's part of the page statistics.

    Engines without line ids (AGG-2) have one line per block. With `names`, also the
    first block whose own text can be a name. Words that come one after another travel
    as one row (`word_runs`).
    """
    kept = is_kept()
    named = blocks.withColumn("_letters", name_letters(F.col("text"))) if names else blocks
    letters = F.when(kept & looks_like_name(F.col("_letters")), F.col("_letters")) if names else F.lit(None).cast("string")
    words = named.select(
        *keys, F.col("seq").cast("bigint").alias("seq"),
        F.coalesce("block_num", F.lit(-1)).alias("block_num"),
        F.coalesce(F.col("line_num").cast("bigint"), F.col("seq").cast("bigint")).alias("line_num"),
        F.when(kept, strip(F.col("text"))).alias("word"),
        F.when(kept, F.col("confidence")).cast("double").alias("confidence"), letters.alias("letters"),
    )
    runs = word_runs(words, [*keys, "block_num", "line_num"])

    def numbered(run: Column) -> Column:
        parts = F.coalesce(run["words"], F.when(run["n"] == 1, F.array(run["text"])).otherwise(F.split(run["text"], " ")))
        return F.transform(parts, lambda w, i: F.struct(
            F.coalesce(F.get(run["seqs"], i), run["first"] + i).alias("seq"), w.alias("word")))

    def line(found: Column) -> Column:
        ordered = F.array_sort(F.flatten(F.transform(found, numbered)))
        return F.when(F.size(found) == 1, F.get(found, F.lit(0))["text"]).otherwise(
            F.array_join(F.transform(ordered, lambda s: s["word"]), " "))

    return runs.groupBy(*keys, "block_num", "line_num").agg(
        F.min("first").alias("first_seq"),
        F.collect_list(F.when(F.col("n") > 0, F.struct("first", "n", "text", "seqs", "words"))).alias("_runs"),
        F.sum("conf_sum").alias("conf_sum"), F.sum("n").alias("words"),
        *([F.min("name").alias("name")] if names else []),
    ).select(*keys, "block_num", "line_num", "first_seq", let(F.col("_runs"), line).alias("line"), "conf_sum", "words",
             *(["name"] if names else []))


def assemble_text(blocks: DataFrame, keys: list[str], names: bool = False) -> DataFrame:
    """AGG-1..4: raw_text, confidence_score and text_blocks_count per page; a page
    without any usable word gets '', 0.0 and 0.

    Words group into lines, lines into the page, both in first-seen order. The
    first grouping spreads a big page over its lines; one page is one output row.
    With `names` (WIN-7) the first block that can be a name comes along as
    `name_blocks`, so the extractor's last name rule needs no list of all blocks.
    """
    lines = line_texts(blocks, keys, names)
    entry = F.when(F.col("words") > 0, F.struct("first_seq", "block_num", "line_num", "line"))
    ordered = F.array_sort(F.collect_list(entry))
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("raw_text"),
        F.coalesce(round_even(F.sum("conf_sum") / F.nullif(F.sum("words"), F.lit(0)), 2), F.lit(0.0))
        .alias("confidence_score"),
        F.sum("words").alias("text_blocks_count"),
        *([F.array_compact(F.array(F.min("name"))).alias("_names")] if names else []),
    ).select(
        *keys, "raw_text", "confidence_score", "text_blocks_count",
        *([F.transform("_names", lambda n: F.struct(n["_letters"].alias("text"))).alias("name_blocks")] if names else []))


def pick_engine(ocr: DataFrame, keys: list[str], pref: str = "auto", engines=rules.OCR_ENGINES) -> DataFrame:
    """WIN-2: per page the first engine (or only the preferred one) whose trimmed
    text has more than ten characters; otherwise the empty fallback.

    row_number() = 1 is planned with a per-partition limit before the shuffle, so
    at most one row per page and input partition travels.
    """
    wanted = list(engines) if pref == "auto" else [pref]
    rank = F.when(F.lit(False), 0)
    for i, name in enumerate(wanted):
        rank = rank.when(F.col("engine") == name, i)
    usable = F.length(strip(F.col("raw_text"))) > rules.MIN_OCR_CHARS
    ranked = ocr.withColumn("_rank", F.when(usable, rank))
    chosen = F.col("_rank").isNotNull()
    core = ("engine", "raw_text", "confidence_score")
    others = [c for c in ocr.columns if c not in (*keys, *core)]
    # unusable rows stay as placeholders of their page, ranked last and emptied
    ranked = ranked.select(
        *keys, F.coalesce("_rank", F.lit(len(wanted))).alias("_rank"),
        F.when(chosen, F.col("engine")).otherwise(rules.FALLBACK_ENGINE).alias("engine"),
        F.when(chosen, F.col("raw_text")).otherwise("").alias("raw_text"),
        F.when(chosen, F.col("confidence_score")).otherwise(rules.FALLBACK_CONFIDENCE).alias("confidence_score"),
        *[F.when(chosen, F.col(c)).alias(c) for c in others],
    )
    w = W.partitionBy(*keys).orderBy("_rank", "raw_text", "confidence_score")
    return ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_rank")


def combined_text(raw_text: Column, payload: Column, file_name: Column) -> Column:
    """PRJ-2: what the classifier reads; of a path only the file's own name."""
    blank = F.lit("")
    name = F.substring_index(F.coalesce(file_name, blank), "/", -1)
    return F.concat_ws("\n", F.coalesce(raw_text, blank), F.coalesce(payload, blank), name)


# --- manifests -----------------------------------------------------------------------------


def extension(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"[^/](\.[^./]*)$", 1))


def screen_files(manifest: DataFrame, file_name: str = "file_name") -> DataFrame:
    """SRC-1: every file with its verdict; rejected ones carry the error text."""
    accepted = (*rules.IMAGE_EXTENSIONS, *rules.DOCUMENT_EXTENSIONS)
    staged = manifest.withColumn("extension", extension(F.col(file_name)))
    return staged.withColumns({
        "accepted": F.col("extension").isin(*accepted),
        "error": F.when(~F.col("extension").isin(*accepted), F.concat(
            F.lit("Unsupported file format '"), F.col("extension"), F.lit("'."))),
    })


def expand_pages(docs: DataFrame, pages: str = "pages", into: str = "page") -> DataFrame:
    """SRC-2: one row per page, numbered from 1."""
    others = [c for c in docs.columns if c != pages]
    return docs.select(*others, F.posexplode(pages).alias("_pos", into)).select(
        *others, (F.col("_pos") + 1).alias("page_number"), into)


def flatten_blocks(ocr: DataFrame, blocks: str = "blocks") -> DataFrame:
    """SRC-3: nested ARRAY<STRUCT> blocks to block rows."""
    return ocr.select(*[c for c in ocr.columns if c != blocks], F.inline(blocks))
