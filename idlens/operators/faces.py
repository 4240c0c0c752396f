"""One-to-many face search: each probe against all stored vectors (JN-10)."""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idlens import rules
from idlens.operators.crosscheck import cosine
from idlens.session import shared_dir

#: Different vectors that a bucket holds on average.
BUCKET = 64
MAX_BITS = 40
#: Bytes of stored vectors, as doubles, that a task holds.
BLOCK = 1 << 27
#: Cosines this close may change places when they are worked out in another order.
CLOSE = 1e-9


def index_shape(n: int, similarity: float, recall: float, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a signature and number of tables: buckets of about `bucket` of n vectors, and
    as many tables as two vectors of that cosine need to meet in one with probability
    `recall`. A random hyperplane parts them with probability angle / pi."""
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(max(2, n / bucket)))))
    meet = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def usable(vectors: DataFrame, name: str) -> DataFrame:
    """Rows whose vector has a direction: not null or empty, no null or non-finite entry, not all zero."""
    v = F.col("embedding")
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(name, "embedding").where(
        F.col(name).isNotNull() & v.isNotNull() & ~F.coalesce(broken, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))


def nearest(stored: DataFrame, asked: DataFrame, dims: int, bits: int, tables: int, seed: int = 7, tasks: int | None = None,
            block: int = BLOCK) -> DataFrame:
    """probe_id, vec_id, near: for each probe of `asked` the vectors of `stored` whose cosine is
    the highest, or within CLOSE of it, among those that lie on the same sides of `bits` random
    hyperplanes in one of `tables` tables; `near` is that cosine, infinite where it can't be
    worked out safely in advance. Vectors of another length than `dims` are left out.

    Neither signatures nor pairs travel: both sides are dealt to a grid, a task meets one part
    of each, looks it up table by table and scores a bucket as a matrix product. A vector
    travels about as often as the root of the number of tasks, or as `block` stored bytes
    go into all. The planes follow from the seed, so every task and run has the same. Rows of a
    repeated probe id share what each of them finds.
    """
    spark = stored.sparkSession
    rows = max(1, block // (8 * dims))
    n, m = (df.where(F.size("embedding") == dims).count() for df in (stored, asked))
    tasks = tasks or 2 * spark.sparkContext.defaultParallelism
    across = max(math.ceil(n / rows), math.ceil(math.sqrt(tasks)))
    down = max(math.ceil(m / rows), math.ceil(tasks / across))
    close, tile = CLOSE, 1 << 20

    def dealt(df: DataFrame, name: str, own: int, other: int, cell: str) -> DataFrame:
        place = df.where(F.size("embedding") == dims).select(F.col(name).cast("bigint").alias(name), "embedding")
        return place.withColumn("_own", F.pmod(F.xxhash64(name), F.lit(own))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select(
            F.expr(cell).cast("bigint").alias("_cell"), name, "embedding")

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("probe_id", pa.int64()), ("vec_id", pa.int64()), ("near", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()

        def matrix(t: pa.Table) -> np.ndarray:
            return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["embedding"].chunks]).reshape(-1, dims).astype(np.float64)

        v, e, vec_ids, probe_ids = matrix(left), matrix(right), left["vec_id"].to_numpy(), right["probe_id"].to_numpy()
        planes = np.random.default_rng(seed).normal(size=(dims, tables * bits))
        places = 1 << np.arange(bits, dtype=np.int64)
        # looked up: an embedding by a signature, its own or that of another row of its probe
        _, probe, times = np.unique(probe_ids, return_inverse=True, return_counts=True)
        scored = by = np.flatnonzero(times[probe] == 1)
        again: dict[int, dict[bytes, int]] = {}
        for i in np.flatnonzero(times[probe] > 1):
            again.setdefault(int(probe[i]), {}).setdefault(e[i].tobytes(), int(i))
        pairs = [(i, j) for some in again.values() for i in some.values() for j in some.values()]
        if pairs:
            scored, by = (np.concatenate([scored, [p[x] for p in pairs]]).astype(np.int64) for x in (0, 1))

        def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            with np.errstate(over="ignore", under="ignore"):
                norm = np.sqrt((x * x).sum(1))
            odd = ~((norm > 1e-100) & (norm < 1e100))
            return x / np.where(odd, 1.0, norm)[:, None] * ~odd[:, None], odd

        (unit_v, odd_v), (unit_e, odd_e) = units(v), units(e)
        any_odd = odd_v.any() or odd_e.any()
        best, kept, pending = np.full(len(scored), -np.inf), [], 0

        def compact() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r, c, s = (np.concatenate(x) for x in zip(*kept, strict=True))
            good = np.flatnonzero(s >= best[r] - close)
            _, first = np.unique(r[good] * len(v) + c[good], return_index=True)
            return r[good[first]], c[good[first]], s[good[first]]

        for table in range(tables):
            some = planes[:, table * bits:(table + 1) * bits]
            here, there = (v @ some > 0) @ places, ((e @ some > 0) @ places)[by]
            order_v, order_e = np.argsort(here, kind="stable"), np.argsort(there, kind="stable")
            sorted_v, sorted_e = unit_v[order_v], unit_e[scored[order_e]]
            buckets, begins = np.unique(there[order_e], return_index=True)
            ends = np.append(begins[1:], len(there))
            low, high = (np.searchsorted(here[order_v], buckets, side) for side in ("left", "right"))
            for b in np.flatnonzero(high > low):
                wide = min(high[b] - low[b], 4096)
                for c in range(low[b], high[b], wide):
                    cols = order_v[c:min(c + wide, high[b])]
                    for a in range(begins[b], ends[b], step := max(1, tile // wide)):
                        which = order_e[a:min(a + step, ends[b])]
                        score = sorted_e[a:a + len(which)] @ sorted_v[c:c + len(cols)].T
                        if any_odd:
                            odd = odd_e[scored[which]][:, None] | odd_v[cols][None, :]
                            x, y = np.nonzero(odd)
                            kept.append((which[x], cols[y], np.full(len(x), np.inf)))
                            score[odd] = -np.inf
                        top = np.maximum(best[which], score.max(1))
                        best[which] = top
                        x, y = np.nonzero((score >= top[:, None] - close) & (score > -np.inf))
                        if len(x):
                            kept.append((which[x], cols[y], score[x, y]))
                            pending += len(x)
            if pending > 1 << 21:
                kept = [compact()]
                pending = 0
        if not kept:
            return schema.empty_table()
        r, c, s = compact()
        return pa.table([pa.array(probe_ids[scored[r]]), pa.array(vec_ids[c]), pa.array(s)], schema=schema)

    left = dealt(stored, "vec_id", across, down, f"_own * {down} + _other").groupBy("_cell")
    right = dealt(asked, "probe_id", down, across, f"_other * {down} + _own").groupBy("_cell")
    return left.cogroup(right).applyInArrow(look, "probe_id bigint, vec_id bigint, near double")


def search_faces(probes: DataFrame, vectors: DataFrame, threshold: float = rules.FACE_MATCH_THRESHOLD, recall: float = 0.999,
                 bucket: int = BUCKET, seed: int = 7, tasks: int | None = None) -> DataFrame:
    """probe_id, vec_id, match_score, matched: the best stored vector that the index finds for
    each probe (`probe_id`, `embedding`), by exact cosine x 100, ties to the smallest vec_id.

    Probes meet stored vectors of their bucket in each table of the index (`nearest`); those
    that can be the best are scored exactly. A vector whose score reaches `threshold` is found
    with probability `recall`; the best one below it with less, as such a probe is no match
    anyway. Equal stored vectors count once, so copies fill no bucket. A probe that meets
    nothing, or has no direction, has null for vec_id and score and is not matched; repeated
    probe ids count as one with the better score.
    """
    spark = probes.sparkSession
    shared_dir(spark)
    stored = usable(vectors, "vec_id").groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).checkpoint()
    size = stored.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    ids = probes.select("probe_id").distinct()
    if size is None:
        return ids.select("probe_id", F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("double").alias("match_score"), F.lit(False).alias("matched"))
    bits, tables = index_shape(size["count"], threshold / 100, recall, bucket)
    asked = usable(probes, "probe_id")
    told = F.max(F.when(F.col("near") < float("inf"), F.col("near"))).over(W.partitionBy("probe_id"))
    met = nearest(stored, asked, size["dims"], bits, tables, seed, tasks).withColumn("_best", told).where(
        (F.col("near") == float("inf")) | (F.col("near") >= F.col("_best") - CLOSE)).select("probe_id", "vec_id")
    scored = met.join(asked.withColumnRenamed("embedding", "a"), "probe_id").join(stored.withColumnRenamed("embedding", "b"), "vec_id").select(
        "probe_id", F.struct((cosine(F.col("a"), F.col("b")) * 100).alias("score"), (-F.col("vec_id")).alias("first")).alias("hit"))
    best = scored.groupBy("probe_id").agg(F.max("hit").alias("hit"))
    return ids.join(best, "probe_id", "left").select(
        "probe_id", (-F.col("hit.first")).alias("vec_id"), F.col("hit.score").alias("match_score"),
        F.coalesce(F.col("hit.score") > threshold, F.lit(False)).alias("matched"))
