"""Exact top-k inner products through an impact-ordered index, a score at a time.

Candidates are packed into shards. A task builds the index of a shard: for each
dimension the candidates in order of their value, cut into posting segments of equal
width. A query gives each segment an impact, the most that a value of it can add to the
query's score, quantised upwards. Segments are processed by falling quantised impact
into two accumulators a candidate: what its values add, and the number of dimensions
seen.

With t the greatest impact of the segments left, a dimension not seen yet adds at most
the lesser of t and the dimension's greatest impact. So after any segment, a candidate's
score is at most (sum so far) - t * (dimensions seen) + sum over dimensions of that
lesser value. The exact scores of the leading candidates give the score that a member must
reach; processing stops only when those that can still reach it are few, or when no
segment is left, and they are all scored exactly.

Equal vectors of a shard are one candidate with the list of its ids, so any number of
copies costs one accumulator. Queries go to the shards in blocks of fixed size; each
shard returns its k best, of which the k best are kept. Both sides are hashed, nothing
is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idlens.llm.common import cut
from idlens.llm.vectors import quantised

TOP = 5
EVERY = 50  # ids divisible by this are queries
LEVELS = 32  # segments of a dimension
ROUNDS = 10  # checks for a proof while segments are processed
FEW = 4  # when a quarter of the candidates, or fewer, can still be among the best, they are scored exactly
UNITS = 1 << 16  # steps of a query's greatest impact
SHARD_ROWS = (8192, 65536)
QUERY_ROWS = 2048
PACK = "n int, kind string, ids binary, cells binary"


def pack_rows(ids: np.ndarray, x: np.ndarray) -> tuple[int, str, bytes, bytes]:
    """Rows in the narrowest whole-number type that holds them."""
    kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or not x.size or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
    return len(ids), np.dtype(kind).str, ids.astype("<i8").tobytes(), x.astype(kind).tobytes()


def unpack_rows(n: int, kind: str, ids: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(cells, kind).reshape(n, -1).astype(np.int64) if n else np.zeros((0, 0), np.int64)
    return np.frombuffer(ids, "<i8"), x


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products; what a bigint cannot hold becomes its nearest value."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(1, len(q))
    if most < 2.0 ** 62:
        return x @ q
    exact = (sum(int(a) * int(b) for a, b in zip(row, q)) for row in x)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in exact], np.int64)


class Shard:
    """The impact-ordered index of a shard's candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)])
        self.ids, self.starts = ids, np.r_[new, len(ids)]  # the ids of each distinct vector, rising
        self.x = x[new]
        m, dims = self.x.shape
        self.places = np.argsort(self.x, axis=0, kind="stable").T.copy()  # by dimension
        self.values = np.take_along_axis(self.x.T, self.places, 1).astype(float)
        low, high, cuts = [], [], []
        for j in range(dims):
            v = self.values[j]
            edges = v[0] + (v[-1] - v[0]) * np.arange(1, levels) / levels
            at = np.unique(np.r_[0, np.searchsorted(v, edges, side="right"), m])
            cuts += [(j, a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            low.append(v[at[:-1]])
            high.append(v[at[1:] - 1])
        self.dim, self.first, self.end = (np.array(c) for c in zip(*cuts))
        self.low, self.high = np.concatenate(low), np.concatenate(high)
        self.postings = 0  # processed so far, for tests and figures
        self.rescored = 0

    def counts(self, own: int) -> np.ndarray:
        """Ids of each distinct vector without the query's own."""
        n = np.diff(self.starts)
        mine = np.flatnonzero(self.ids == own)
        return n - np.bincount(np.searchsorted(self.starts, mine, side="right") - 1, minlength=len(n)) if len(mine) else n

    def search(self, own: int, q: np.ndarray, k: int = TOP, rounds: int = ROUNDS, few: int = FEW) -> list[tuple[int, int]]:
        """The k best (id, score) of the shard: by falling score, then rising id, `own` left out."""
        m, q_float = len(self.x), q.astype(float)
        weight = q_float[self.dim]
        impact = np.where(weight > 0, weight * self.high, weight * self.low)
        # doubles may be off in their last bits: bounds get so much on top
        slack = 1e-12 * float(np.abs(impact).max(initial=0)) * len(q)
        used = np.flatnonzero(weight)
        unit = max(1.0, float(np.abs(impact).max(initial=0)) / UNITS)
        used = used[np.argsort(-np.ceil(impact[used] / unit), kind="stable")]  # by quantised impact
        rest = np.r_[np.maximum.accumulate(impact[used][::-1])[::-1], 0.0]  # the most that later segments hold
        greatest = np.full(len(q), -np.inf)
        np.maximum.at(greatest, self.dim[used], impact[used])
        greatest = greatest[greatest > -np.inf]
        counts = self.counts(own)
        # sums are whole numbers: where a double has room, the dimensions seen stand above them
        above = 2.0 ** np.ceil(np.log2(2 * len(q) * float(np.abs(impact).max(initial=1)) + 2))
        joint = above * 2 * len(q) < 2.0 ** 53
        held, seen = np.zeros(m), np.zeros(m)
        known = np.full(m, np.iinfo(np.int64).min)  # exact scores of leading candidates
        scored = np.zeros(m, bool)
        sizes = self.end[used] - self.first[used]
        stops = np.unique(np.searchsorted(np.cumsum(sizes), sizes.sum() * np.arange(1, rounds + 1) / rounds, side="left") + 1)
        members, done = np.arange(m), 0
        for stop in np.minimum(stops, len(used)):
            some = used[done:stop]
            if len(some):
                cuts = list(zip(self.dim[some].tolist(), self.first[some].tolist(), self.end[some].tolist()))
                places = np.concatenate([self.places[j, a:b] for j, a, b in cuts])
                values = np.concatenate([self.values[j, a:b] for j, a, b in cuts])
                values *= np.repeat(weight[some], sizes[done:stop])
                if joint:
                    values += above
                else:
                    seen += np.bincount(places, minlength=m)
                held += np.bincount(places, values, m)
                self.postings += len(places)
            done = stop
            t = rest[done]
            if joint:
                seen = np.floor(held / above + 0.5)
            bound = (held - above * seen if joint else held) + (float(np.minimum(t, greatest).sum()) - t * seen if done < len(used) else 0.0) + slack
            lead = np.argpartition(-bound, min(2 * k, m - 1))[:2 * k]
            lead = lead[~scored[lead]]
            known[lead], scored[lead] = products(self.x[lead], q), True
            ranked = np.flatnonzero(scored & (counts > 0))
            ranked = ranked[np.argsort(-known[ranked], kind="stable")]
            enough = np.searchsorted(np.cumsum(counts[ranked]), k)
            if enough < len(ranked):
                members = np.flatnonzero(bound >= float(known[ranked[enough]]) - slack)
                if len(members) <= max(8 * k, m // few):
                    break
            if done == len(used):
                break
        self.rescored += len(members)
        scores = products(self.x[members], q)
        best = []
        for at in np.lexsort((members, -scores)).tolist():
            if len(best) >= k and scores[at] < best[k - 1][1]:
                break
            some = self.ids[self.starts[members[at]]:self.starts[members[at] + 1]]
            lo, hi = np.searchsorted(some, [own, own + 1]) if own < (1 << 63) - 1 else (np.searchsorted(some, own), len(some))
            best += [(int(i), int(scores[at])) for i in [*some[:lo][:k], *some[hi:hi + k]][:k]]
            best.sort(key=lambda b: (-b[1], b[0]))
        return best[:k]


def packs(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, x), in the order of their partition, to PACK rows of at most `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def close() -> pa.RecordBatch:
            ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(pack_rows(ids, x), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["n", "kind", "ids", "cells"])

        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                if count + part.num_rows > size:
                    yield close()
                    held, count = [], 0
                held.append((part.column("vec_id").to_numpy(), part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)))
                count += part.num_rows
        if count:
            yield close()

    return rows.mapInArrow(run, PACK)


def dealt(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """Each shard with each block of queries: the blocks are repeated under the number of
    every shard, and both sides are hashed on it. Numbers of tasks with fewer shards than
    others meet nothing."""
    most = shards.agg(F.max("task").alias("task"), F.max("place").alias("place")).first()
    stride = (most["place"] or 0) + 1
    numbers = F.sequence(F.lit(0), F.lit(((most["task"] or 0) + 1) * stride - 1))
    keyed = shards.withColumn("shard", F.col("task") * stride + F.col("place")).drop("task", "place")
    # few bytes, much work: dealt explicitly, so that small partitions are not put together
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.select([F.col(c).alias(f"q_{c}") for c in ("n", "kind", "ids", "cells")] + [F.explode(numbers).alias("shard")])
    return keyed.repartition(parts, "shard").join(asked.repartition(parts, "shard"), "shard")


def top_k(embeddings: DataFrame, k: int = TOP, every: int = EVERY, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable row (see `vectors.quantised`) whose id is
    divisible by `every`, the k highest inner products with all other rows, ties to the
    smaller id; all of them, if there are fewer.

    Rows without an id can't be named and take no part. A row's own are all rows of its
    id. Candidates that repeat an id take a place each; a query that is repeated with the
    same vector counts once, with other vectors its results are ranked together. Scores
    beyond a bigint become its nearest value. Empty tables give empty tables.
    """
    spark = embeddings.sparkSession
    rows = cut(quantised(embeddings).where(F.col("vec_id").isNotNull()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = shard_rows or min(max(SHARD_ROWS[0], -(-rows.count() // (2 * parts))), SHARD_ROWS[1])
    numbered = F.monotonically_increasing_id()
    shards = cut(packs(rows, size).select("*", F.shiftright(numbered, 33).cast("int").alias("task"), numbered.bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("place")))
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = cut(packs(queries, QUERY_ROWS))
    pairs = dealt(shards, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row].as_py() for name in ("shard", "q_n", "q_kind", "q_ids", "q_cells")}
                if at["shard"] != last:
                    last, index = at["shard"], Shard(*unpack_rows(*[batch.column(c)[row].as_py() for c in ("n", "kind", "ids", "cells")]))
                out = [(own, *found) for own, q in zip(*unpack_rows(at["q_n"], at["q_kind"], at["q_ids"], at["q_cells"])) for found in index.search(int(own), q, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
