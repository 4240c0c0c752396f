"""Ranked lexical search: documents grouped by the set of an item's terms they hold.

1. The items' terms are numbered, in blocks of bounded size.
2. Each task reads its documents once and keeps, for the terms of the block only,
   (document, term, occurrences), packed into shards of a few thousand documents.
3. Document frequencies, N and L are sums over the shards.
4. A shard holds a bitmap of its documents for each term. For an item, the bitmaps of its
   terms are turned into a mask a document, the terms that it holds, and documents are
   grouped by mask. A mask's score is at most the sum over its terms of weight times the
   term's greatest contribution in the shard. Masks are evaluated by falling maximum, all
   documents of a mask exactly; when the next maximum is below the score of the last of
   the k best so far, nothing that is left can be among them.

A task carries its k best of each item from shard to shard, so later shards stop sooner.
It returns them in the end, tasks * items * k rows at most, of which the k best are kept.
Documents are not shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idlens.llm.common import ascii_lower, cut, words

TOP = 50
#: Runs of ASCII digits and letters and anything beyond ASCII; upper-case A-Z is lowered first.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for bytes: every other ASCII byte becomes a blank.
TO_TERMS = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))
BLOCK_TERMS = 20_000  # terms searched in one pass
SHARD_DOCS = 8192
SHARD_POSTINGS = 2_000_000
NO_ID = (1 << 63) - 1  # rank of a null doc_id among equal scores: last
SHARD = "n bigint, length bigint, docs array<bigint>, nameless array<boolean>, sizes array<bigint>, ends array<bigint>, terms array<int>, times array<bigint>"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the different terms of each item; items that share an id are one."""
    each = items.select("item_id", F.explode(words(ascii_lower(F.col("text")), TERM)).alias("term"))
    return each.distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def shards(docs: DataFrame, vocabulary: dict[bytes, int], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """SHARD rows of the documents that hold any term at all; those without a term of the
    vocabulary count in n and length only."""
    types = [pa.int64(), pa.int64(), *[pa.list_(t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64())]]
    names = [c.split()[0] for c in SHARD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get

        def fresh() -> list:
            return [0, 0, [], [], [], [], [], []]

        def close(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held, types)], names=names)

        held = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ws = text.as_buffer().to_pybytes().translate(TO_TERMS).split() if text.is_valid else ()
                if not ws:
                    continue
                held[0] += 1
                held[1] += len(ws)
                found = sorted((known(w), c) for w, c in Counter(ws).items() if w in vocabulary)
                if found:
                    held[2].append(NO_ID if doc_id is None else doc_id)
                    held[3].append(doc_id is None)
                    held[4].append(len(ws))
                    held[6] += [t for t, _ in found]
                    held[7] += [c for _, c in found]
                    held[5].append(len(held[6]))
                    if len(held[2]) >= shard_docs or len(held[6]) >= SHARD_POSTINGS:
                        yield close(held)
                        held = fresh()
        if held[0]:
            yield close(held)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SHARD)


class Shard:
    """Documents, their postings and a bitmap for each term."""

    def __init__(self, docs, nameless, sizes, ends, terms, times, n: int, length: int):
        self.docs, self.nameless = docs, nameless
        self.starts, self.ends = np.r_[0, ends[:-1]], ends
        m = 50 + (50 * sizes * n) // length
        of = np.repeat(np.arange(len(docs)), self.ends - self.starts)
        self.terms = terms
        self.gains = (1_000_000_000 * times) // (1000 * times + 20 * m[of])
        self.present, self.rows = np.unique(terms, return_inverse=True)  # rows: place of a posting's term
        self.greatest = np.zeros(len(self.present), np.int64)
        np.maximum.at(self.greatest, self.rows, self.gains)
        self.bitmaps = np.zeros((len(self.present), -(-len(docs) // 8)), np.uint8)
        np.bitwise_or.at(self.bitmaps, (self.rows, of >> 3), (128 >> (of & 7)).astype(np.uint8))

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents that hold any of the terms at `rows`, the number of each one's mask,
        and the masks as rows of bits."""
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=len(self.docs))
        packed = np.packbits(bits, axis=0)
        held = np.flatnonzero(packed.any(0))
        key = np.zeros(len(held), np.int64)
        for lo in range(0, len(packed), 4):  # 32 terms at a time, with what came before
            word = np.zeros(len(held), np.int64)
            for byte in packed[lo:lo + 4, held]:
                word = (word << 8) | byte
            _, word = np.unique(word, return_inverse=True)
            _, first, key = np.unique(key * (word.max(initial=0) + 1) + word, return_index=True, return_inverse=True)
        return held, key, bits[:, held[first]].T

    def scores(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of the documents at places `at`; weights by place of the term."""
        sizes = self.ends[at] - self.starts[at]
        before = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(self.starts[at] - before, sizes)
        return np.add.reduceat(weights[self.rows[place]] * self.gains[place], before)


class Best:
    """The k best of an item: score, doc_id (NO_ID for null) and whether it is null."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 3), np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray, nameless: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, docs, nameless.astype(np.int64)], 1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:self.k]]

    def least(self) -> int:
        """Score of the last of k, 0 while they are fewer."""
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 0


def search(shard: Shard, terms: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Adds what the shard has for an item; returns the number of documents evaluated."""
    at = np.searchsorted(shard.present, terms)
    there = at < len(shard.present)
    there[there] = shard.present[at[there]] == terms[there]
    rows = at[there]
    if not len(rows):
        return 0
    weights = np.zeros(len(shard.present), np.int64)
    weights[rows] = weight[there]
    held, mask, bits = shard.masks(rows)
    most = bits.astype(float) @ (weights[rows] * shard.greatest[rows]).astype(float)
    order = np.argsort(-most, kind="stable")
    by_mask = np.argsort(mask, kind="stable")
    edges = np.searchsorted(mask[by_mask], np.arange(len(bits) + 1))
    done, evaluated, step = 0, 0, 32
    while done < len(order) and most[order[done]] >= max(1, best.least()) - 0.5:
        some = order[done:done + step]
        docs = held[np.concatenate([by_mask[edges[g]:edges[g + 1]] for g in some.tolist()])]
        scores = shard.scores(docs, weights)
        kept = scores > 0
        best.add(scores[kept], shard.docs[docs[kept]], shard.nameless[docs[kept]])
        evaluated += len(docs)
        done, step = done + step, 2 * step
    return evaluated


def rank_block(docs: DataFrame, items: list[tuple[str, list[str]]], k: int, shard_docs: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each task for some items."""
    spark = docs.sparkSession
    listed = sorted({t.encode() for _, terms in items for t in terms})
    vocabulary = {t: i for i, t in enumerate(listed)}
    made = cut(shards(docs, vocabulary, shard_docs))
    total = made.agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    n, length = total["n"] or 0, total["length"] or 0
    if not n:
        return spark.createDataFrame([], "item_id string, doc_id bigint, score bigint")
    # a row a term of the block
    df = {r["term"]: r["count"] for r in made.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(listed))], np.int64)
    asked = [(item, np.array(sorted(vocabulary[t.encode()] for t in terms), np.int64)) for item, terms in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                lists = [batch.column(c)[row].values for c in ("docs", "nameless", "sizes", "ends", "terms", "times")]
                if len(lists[0]):
                    shard = Shard(*[v.to_numpy(zero_copy_only=False) for v in lists], n, length)
                    for (_, terms), found in zip(asked, best):
                        search(shard, terms, w[terms], found)
        for (item, _), found in zip(asked, best):
            if len(found.rows):
                scores, ids, nameless = found.rows.T
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(ids), pa.string()), pa.array(ids, pa.int64(), mask=nameless.astype(bool)), pa.array(scores)],
                    names=["item_id", "doc_id", "score"])

    return made.mapInArrow(run, "item_id string, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents.

    Null and empty texts have no terms: such documents are not counted and such items find
    nothing. Every row is a document of its own, repeated rows and rows of one id
    too; a null id ranks last among equal scores. Items that share an id (null included)
    are one item with all their terms. Further columns are not read; empty tables give
    empty tables. More than `block_terms` item terms take more passes over the documents.
    """
    spark = docs.sparkSession
    terms = cut(item_terms(items.select(F.col("item_id").cast("string").alias("item_id"), "text")))
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = -(-total // block_terms)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, passes)))
    found = spark.createDataFrame([], "item_id string, doc_id bigint, score bigint")
    for i in range(passes):
        some = [(r["item_id"], r["terms"]) for r in terms.where(block == i).collect()]
        found = found.unionByName(rank_block(docs, some, k, shard_docs)) if some else found
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
