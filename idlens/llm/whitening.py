"""Embedding whitening with MLlib's BlockMatrix.

The fit list holds each distinct vector once. Its centred rows are packed into blocks,
a block a row of a DataFrame, and become a BlockMatrix X without leaving Arrow and the
JVM. X' multiplied by X is the scatter matrix, dims x dims, which alone comes to the
driver for `eigh`. A second BlockMatrix of all rows, multiplied by the whitening matrix,
projects them.

How the products spread over tasks:

* X'X has a single block or few, so MLlib's middle dimension is cut into as many pieces
  as there are partitions; each task adds up its own blocks first.
* In the projection MLlib deals the blocks of the result over a square grid. The blocks
  of rows are therefore laid out in panels, block k at (k div c, k mod c) with c near
  the root of the number of partitions, against a whitening matrix repeated along the
  diagonal: every task gets a share, and nothing is multiplied twice.

A short last block is filled up with zero rows, which add nothing to a scatter of
centred rows and are dropped when ids are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from idlens.llm.common import cut
from idlens.llm.vectors import quantised

COMPONENTS = 4
#: Numbers in a block at most: 32 MB of doubles.
BLOCK_VALUES = 1 << 22
PACKED = "task int, block int, ids array<bigint>, deviations array<decimal(38,0)>, cells binary"
RESULT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
          "identity_error double, deviation_exact decimal(38,0)")
PLACE = StructType([StructField("row", LongType()), StructField("col", LongType())])
CELLS = StructType([StructField("place", PLACE), StructField("matrix", MatrixUDT())])
ARROW_PLACE = pa.struct([("row", pa.int64()), ("col", pa.int64())])
ARROW_MATRIX = pa.struct([
    ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
    ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension: one row a dimension comes to the driver."""
    halves = fit.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(
        F.count("*").alias("n"), F.sum(F.shiftright("v", 32)).alias("high"), F.sum(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    rows = halves.orderBy("pos").collect()
    return (rows[0]["n"] if rows else 0), [(r["high"] << 32) + r["low"] for r in rows]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 for each row, exactly; None beyond 38 digits."""
    largest = max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, max(map(abs, sums), default=0))
    exact = np.int64 if largest ** 2 * max(1, len(sums)) < 1 << 62 else object
    wide, s = x.astype(exact), np.array(sums, exact)
    squares, crossed, own = (wide * wide).sum(1).tolist(), wide.dot(s).tolist(), sum(v * v for v in sums)
    found = (n * n * a - 2 * n * b + own for a, b in zip(squares, crossed))
    return [v if v < 10 ** 38 else None for v in found]


def packed(rows: DataFrame, n: int, sums: list[int], size: int) -> DataFrame:
    """Rows (vec_id, x) -> PACKED: `size` centred rows a block, with their ids and deviations.

    Blocks are numbered per task; the rows of a task that fails are packed anew alike, and
    what is packed is written to the shared folder before it is numbered.
    """
    dims = len(sums)
    mean = np.array([s / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, np.ndarray]] = []
        count = block = task = 0

        def close(ids: list, x: np.ndarray) -> pa.RecordBatch:
            cells = np.zeros((size, dims))
            cells[:len(x)] = x - mean
            return pa.RecordBatch.from_arrays([
                pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([deviations(x, n, sums)], pa.list_(pa.decimal128(38, 0))), pa.array([cells.tobytes()], pa.binary())],
                names=["task", "block", "ids", "deviations", "cells"])

        for batch in batches:
            task = batch.column("task")[0].as_py() if batch.num_rows else task
            held.append((batch.column("vec_id").to_pylist(), batch.column("x").flatten().to_numpy().reshape(-1, dims)))
            count += batch.num_rows
            while count >= size:
                ids, x = [i for some, _ in held for i in some], np.concatenate([v for _, v in held])
                yield close(ids[:size], x[:size])
                held, count, block = [(ids[size:], x[size:])], count - size, block + 1
        if count:
            yield close([i for some, _ in held for i in some], np.concatenate([v for _, v in held]))

    return cut(rows.select("vec_id", "x", F.spark_partition_id().alias("task")).mapInArrow(run, PACKED))


def numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Adds `number`, and the number of places; places of tasks with fewer blocks stay empty."""
    most = blocks.agg(F.max("task").alias("task"), F.max("block").alias("block")).first()
    stride = most["block"] + 1
    return blocks.withColumn("number", F.col("task") * stride + F.col("block")), (most["task"] + 1) * stride


def matrix(blocks: DataFrame, places: int, size: int, dims: int, panels: int = 1) -> BlockMatrix:
    """The BlockMatrix of numbered blocks, laid out in panels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, cells in zip(batch.column("number").to_pylist(), batch.column("cells")):
                made = {"type": 1, "numRows": size, "numCols": dims, "colPtrs": None, "rowIndices": None,
                        "values": np.frombuffer(cells.as_buffer()), "isTransposed": True}
                yield pa.RecordBatch.from_arrays([
                    pa.array([{"row": number // panels, "col": number % panels}], ARROW_PLACE), pa.array([made], ARROW_MATRIX)], names=["place", "matrix"])

    rows = -(-places // panels) * size
    made = callMLlibFunc("createBlockMatrix", blocks.select("number", "cells").mapInArrow(run, CELLS), size, dims, rows, panels * dims)
    return BlockMatrix(made, size, dims, rows, panels * dims)


def scatter(x: BlockMatrix, pieces: int) -> np.ndarray:
    """X'X, the middle dimension cut into pieces."""
    product = x.transpose()._java_matrix_wrapper.call("multiply", x._java_matrix_wrapper._java_model, pieces)
    return BlockMatrix(product, x.colsPerBlock, x.colsPerBlock).toLocalMatrix().toArray()


def projected(spark: SparkSession, x: BlockMatrix, basis: np.ndarray, panels: int) -> DataFrame:
    """number, y array<double>: the rows of each block times the basis, row after row."""
    dims, kept = basis.shape
    repeated = [((p, p), DenseMatrix(dims, kept, basis.ravel(order="F"))) for p in range(panels)]
    by = BlockMatrix(spark.sparkContext.parallelize(repeated, min(panels, 8)), dims, kept, panels * dims, panels * kept)
    y = x.multiply(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, made in zip(batch.column(0).to_pylist(), batch.column(1)):
                row, col = place.values()
                cells = made["values"].values.to_numpy().reshape((-1, kept), order="C" if made["isTransposed"].as_py() else "F")
                yield pa.RecordBatch.from_arrays([
                    pa.array([row * panels + col], pa.int64()), pa.array([cells.ravel()], pa.list_(pa.float64()))], names=["number", "y"])

    return callMLlibFunc("getMatrixBlocks", y._java_matrix_wrapper._java_model).mapInArrow(run, "number bigint, y array<double>")


def identity_error(y: DataFrame, kept: int, n: int) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened rows minus the
    identity; `y` has a row of `kept` numbers for each vector, and zero rows."""

    def summed(mean: np.ndarray | None) -> tuple[np.ndarray, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cells in batch.column("y"):
                    rows = cells.values.to_numpy().reshape(-1, kept)
                    out = rows.sum(0) if mean is None else ((rows - mean).T @ (rows - mean)).ravel()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(range(len(out)), pa.int32()), pa.array(out), pa.array([len(rows)] * len(out), pa.int64())], names=["pos", "v", "rows"])

        found = y.mapInArrow(run, "pos int, v double, rows bigint").groupBy("pos").agg(F.sum("v").alias("v"), F.sum("rows").alias("rows")).orderBy("pos").collect()
        return np.array([r["v"] for r in found]), found[0]["rows"]

    mean = summed(None)[0] / n
    total, rows = summed(mean)
    centred = total.reshape(kept, kept) - (rows - n) * np.outer(mean, mean)  # less what zero rows gave
    return float(np.abs(centred / n - np.eye(kept)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, block_values: int = BLOCK_VALUES) -> DataFrame:
    """RESULT: every usable row (see `vectors.quantised`) on the first components.

    The fit list is each distinct vector once, so copies do not weigh on it; all rows are
    projected, repeated ones and those with null ids too. A component without variance
    (fewer distinct vectors than dimensions, constant dimensions) has null for `whitened`
    and 0 for `explained`, null if nothing varies at all, and takes no part in
    `identity_error`. `deviation` is null where it does not fit a bigint;
    `deviation_exact` holds it up to 38 digits. Fewer dimensions than components give a
    component a dimension; an empty table gives an empty one.
    """
    spark = embeddings.sparkSession
    rows = quantised(embeddings)
    fit = cut(rows.select("x").distinct())
    n, sums = totals(fit)
    if not n:
        return spark.createDataFrame([], RESULT)
    dims = len(sums)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, min(block_values // dims, -(-n // (4 * parts))))
    panels = isqrt(parts - 1) + 1

    fit_blocks, places = numbered(packed(fit.select(F.lit(None).cast("bigint").alias("vec_id"), "x"), n, sums, size))
    covariance = scatter(matrix(fit_blocks, places, size, dims), parts) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    kept = min(components, dims)
    values, vectors = values[::-1][:kept], vectors[:, ::-1][:, :kept]
    trace = float(np.trace(covariance))
    alive = int((values > values.max(initial=0) * dims * np.finfo(float).eps).sum())  # falling: the living ones come first
    basis = vectors[:, :alive] / np.sqrt(values[:alive])

    blocks, all_places = numbered(packed(rows, n, sums, size))
    listed = blocks.select("number", F.posexplode(F.arrays_zip("ids", "deviations")).alias("pos", "row"))
    error = None
    if alive:
        of_fit = cut(projected(spark, matrix(fit_blocks, places, size, dims, panels), basis, panels))
        error = identity_error(of_fit, alive, n)
        y = projected(spark, matrix(blocks, all_places, size, dims, panels), basis, panels)
        listed = blocks.join(y, "number").select(
            "number", "y", F.posexplode(F.arrays_zip("ids", "deviations")).alias("pos", "row"))
    whitened = [F.get("y", F.col("pos") * alive + i) if i < alive else F.lit(None).cast("double") for i in range(kept)]
    explained = [float(values[i] / trace) if i < alive else 0.0 if trace > 0 else None for i in range(kept)]
    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), w.alias("whitened"), F.lit(explained[i]).cast("double").alias("explained")) for i, w in enumerate(whitened)])
    return listed.select("row", F.explode(each).alias("c")).select(
        F.col("row.ids").alias("vec_id"), "c.component", F.lit(n).cast("bigint").alias("n"),
        F.col("row.deviations").try_cast("bigint").alias("deviation"),
        "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"), F.col("row.deviations").alias("deviation_exact"))
