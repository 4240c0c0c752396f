"""SimHash near-duplicates through an inverted index on positional bytes.

A fingerprint has 8 positional bytes. Two that differ in at most 4 bits agree in at
least 4 of them, so the guaranteed minimum of shared positional bytes is 4. The 2,048
positional bytes are counted over all different fingerprints and ordered by rarity. Of
the bytes that two fingerprints share, only the most frequent can be the most frequent
of either, so at least 3 shared ones remain among the 7 rarest of both: a posting list
for every three of a fingerprint's 7 rarest bytes (35 a fingerprint) brings each such
pair together at least once. In a list all shared positional bytes of a pair are
tallied, pairs below the minimum of 4 dropped, and the others verified by the number
of differing bits.

Lists hold different fingerprints only, whatever the number of copies. A list gives
no pairs but the links of a spanning forest, fewer than its members. A long list is
first split by the remaining bytes: within it at most 4 of 40 bits differ, so one of
five bit fields must agree, again and again down to small lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.llm.common import ascii_lower, cut, words
from idlens.operators.skew import join_to_one

SHINGLE = 4
MAX_BITS = 4
BYTES = 8
#: Guaranteed number of equal bytes of two fingerprints within MAX_BITS.
MIN_SHARED = BYTES - MAX_BITS
#: Bytes of a posting list's key: what is left of them without the most frequent byte.
KEYED = MIN_SHARED - 1
SMALL = 2048  # members of a list that are compared at a stroke
LINKS = "a bigint, b bigint"


def shingle_hash(ws: Column, at: Column, size: int) -> Column:
    """XXH64 (seed 42) of the space-joined shingle at `at`; of all words if they are fewer."""
    whole = F.xxhash64(F.concat_ws(" ", *[F.get(ws, at + i) for i in range(size)]))
    return F.when(at + size <= F.size(ws), whole).when((at == 0) & (F.size(ws) > 0), F.xxhash64(F.array_join(ws, " ")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (bigint) of every document; null and empty texts have fingerprint 0.

    The counts of two bits share a bigint, so 32 sums hold all 64. They are added up
    next to the words; one row a document is shuffled. Repeated rows give rows each.
    """
    placed = docs.select("doc_id", F.xxhash64("text").alias("_hash"), words(ascii_lower(F.col("text"))).alias("_w")).select(
        "doc_id", "_hash", "_w", F.posexplode_outer("_w").alias("_pos", "_word")).select(
        "doc_id", "_hash", (F.coalesce("_pos", F.lit(0)) == 0).cast("bigint").alias("_first"),
        shingle_hash(F.col("_w"), F.col("_pos"), shingle).alias("_h"))
    pair = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(pair)).alias(f"_s{i}") for i in range(32)]
    counted = placed.groupBy("doc_id", "_hash").agg(F.sum("_first").alias("_copies"), F.count("_h").alias("_n"), *sums)
    bits = F.lit(0).cast("bigint")
    for i in range(32):
        low, high = F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{i}", 32)
        for at, count in ((i, low), (i + 32, high)):
            bits = bits.bitwiseOR(F.when(2 * count > F.col("_n"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(0))
    return counted.select("doc_id", F.col("_hash").alias("text_hash"), bits.alias("fp"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")).drop("_copy")


def positional_bytes(fp: Column) -> list[Column]:
    """The 8 positional bytes as numbers from 0 to 2047: position * 256 + byte."""
    return [F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(0xFF)).cast("int") + 256 * b for b in range(BYTES)]


def by_rarity(distinct: DataFrame) -> list[int]:
    """The place of each of the 2,048 positional bytes in the order of frequency."""
    counts = {r["byte"]: r["count"] for r in distinct.select(F.explode(F.array(*positional_bytes(F.col("fp")))).alias("byte")).groupBy("byte").count().collect()}
    order = sorted(range(256 * BYTES), key=lambda x: (counts.get(x, 0), x))
    return [place for _, place in sorted(zip(order, range(256 * BYTES)))]


def posting_lists(distinct: DataFrame) -> DataFrame:
    """fp -> (fp, list, key) for each KEYED of its positional bytes but the most frequent one."""
    places = F.array(*map(F.lit, by_rarity(distinct)))
    common = F.array_max(F.array(*[F.struct(F.get(places, x).alias("place"), F.lit(b).alias("at")) for b, x in enumerate(positional_bytes(F.col("fp")))]))["at"]
    choices = []
    for number, kept in enumerate(combinations(range(BYTES), KEYED)):
        mask = sum(0xFF << (8 * b) for b in kept)
        key = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        choices.append(F.when(~F.col("_common").isin(*kept), F.struct(F.lit(number).alias("list"), key.alias("key"))))
    return distinct.select("fp", common.alias("_common")).select("fp", F.explode(F.array_compact(F.array(*choices))).alias("_c")).select("fp", "_c.list", "_c.key")


class Forest:
    """Union-find over the places 0 .. n - 1; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((i, j))


def close(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Places of the others that share MIN_SHARED positional bytes and differ in MAX_BITS or fewer."""
    apart = one ^ others
    shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    return np.flatnonzero((shared >= MIN_SHARED) & (np.bitwise_count(apart) <= MAX_BITS))


def connect(fps: np.ndarray, places: np.ndarray, free: list[int], forest: Forest) -> None:
    """Links all pairs within MAX_BITS among `places`, which agree outside the bits `free`."""
    if len(places) > SMALL and len(free) > MAX_BITS:
        fields = np.array_split(np.array(free, dtype=np.uint64), MAX_BITS + 1)
        for field in fields:
            mask = np.bitwise_or.reduce(np.uint64(1) << field)
            order = places[np.argsort(fps[places] & mask, kind="stable")]
            cuts = np.flatnonzero(np.diff(fps[order] & mask)) + 1
            rest = [b for b in free if b not in set(field.tolist())]
            for part in np.split(order, cuts):
                if len(part) > 1:
                    connect(fps, part, rest, forest)
        return
    values = fps[places]
    for i in range(len(places) - 1):
        for j in close(values[i], values[i + 1:]):
            forest.link(places[i], places[i + 1 + j])


def spanning_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (list, key) -> links of a spanning forest of each list."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    choices = list(combinations(range(BYTES), KEYED))

    def forest_of(fps: np.ndarray, number: int) -> list[tuple[int, int]]:
        free = [8 * b + i for b in range(BYTES) if b not in choices[number] for i in range(8)]
        forest = Forest(len(fps))
        connect(fps, np.arange(len(fps)), free, forest)
        return forest.links

    held: list[np.ndarray] = []  # the last, still growing list
    last: tuple[int, int] | None = None

    def flush() -> list[tuple[int, int]]:
        fps = np.concatenate(held).view(np.uint64)
        return [(fps[i].astype(np.int64), fps[j].astype(np.int64)) for i, j in forest_of(fps, last[0])] if len(fps) > 1 else []

    for batch in batches:
        out: list[tuple[int, int]] = []
        number, key, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "key", "fp"))
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
        for k in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fps))):  # all others have one member
            lo, hi = starts[k], ends[k]
            mark = (int(number[lo]), int(key[lo]))
            if mark != last:
                out += flush() if held else []
                held, last = [], mark
            held.append(fps[lo:hi].copy())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], schema=schema)
    if held and (out := flush()):
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], schema=schema)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> node, root: the smallest node reachable. Large-star and small-star
    rounds, each cut at the shared folder, until nothing changes; about log(n) rounds.
    A star's centre keeps one row per neighbour and is reduced by a minimum before the
    shuffle, so it may have any number of them."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v"), F.col("v")).distinct())
        before = state


def classes(docs: DataFrame, shingle: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id; root names the component."""
    spark = docs.sparkSession
    marked = cut(fingerprints(docs, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = posting_lists(distinct.select("fp")).repartition(parts, "list", "key").sortWithinPartitions("list", "key", "fp").mapInArrow(
        spanning_links, LINKS)
    roots = components(links)
    named = cut(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "root"))
    # one root may hold a third of all fingerprints; those without a link need no join
    linked = named.where(F.col("root").isNotNull())
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    told = join_to_one(linked, ids, "root", "_n").select("fp", "root", "component_id").unionByName(
        named.where(F.col("root").isNull()).select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id")))
    return marked.join(told, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, itself included.

    Copies are told apart by nothing but their doc_id: null ids form no smallest one
    unless a component has no other. Empty tables give empty tables; further columns
    are not read.
    """
    return classes(docs, shingle, parts).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Of each component its smallest document by doc_id, then by hash of the text, with all
    columns, whatever other components hold of that id; of equal rows one. A row without an id
    can't be named as the one to stay and is not dropped."""
    least = classes(docs.where(F.col("doc_id").isNotNull()), shingle).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("_least"))
    kept = least.select("_least.doc_id", F.col("_least.text_hash").alias("_hash"))
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    return hashed.join(kept, ["doc_id", "_hash"], "left_semi").dropDuplicates(["doc_id", "_hash"]).drop("_hash").select(docs.columns).unionByName(
        docs.where(F.col("doc_id").isNull()))
