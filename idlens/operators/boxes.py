"""Lines and columns from boxes, for engines without line ids (AGG-1, AGG-2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from idlens.session import scratch_path, shared_dir

#: Places of a reading order that a line and a column have.
LINE_WORDS = 1 << 21
COLUMN_LINES = 1 << 21
#: Pages whose keys may go to all tasks.
FEW_PAGES = 100_000
#: Boxes that a task packs at a time.
STRETCH = 100_000


def islands(df: DataFrame, keys: list[str], low: str, high: str, into: str, gap: float = 0.0, parts: int | None = None) -> DataFrame:
    """Adds `into`: the number, from 0 up the axis, of the island that the interval
    [low, high] belongs to. An interval that begins more than `gap` beyond the end of all
    before it begins a new island.

    Intervals are range-partitioned by (keys, low, high), so a page with a third of all boxes
    spans many partitions; the furthest end and the number of islands of earlier
    partitions come from one summary row a key and partition. Keys and bounds must not be
    null.
    """
    shared_dir(df.sparkSession)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *keys, low, high).withColumn("_part", F.spark_partition_id()).checkpoint()
    place = [*keys, "_part"]
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = cut.groupBy(*place).agg(F.max(high).alias("_end")).select(*place, F.max("_end").over(earlier).alias("_end"))
    inside = W.partitionBy(*place).orderBy(low, high)
    reached = F.greatest(F.max(high).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("_end"))
    begun = cut.join(ends, place).withColumn("_new", F.coalesce(F.col(low) > reached + gap, F.lit(True)).cast("bigint"))
    counts = begun.groupBy(*place).agg(F.sum("_new").alias("_before")).select(*place, F.sum("_before").over(earlier).alias("_before"))
    # equal intervals may come in any order, so the sum takes in all of them
    number = F.coalesce("_before", F.lit(0)) + F.sum("_new").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow)) - 1
    return begun.join(counts, place).withColumn(into, number).drop("_part", "_end", "_new", "_before")


def line_units(boxed: DataFrame, keys: list[str], gap: float, stretch: int = STRETCH) -> DataFrame:
    """Neighbouring boxes of a page packed to a row a line before they travel: keys, _first
    (one row of the page's stretch), _column and _line inside the stretch, _l, _r, _t, _b (what
    the stretch's column and the line reach) and all other columns as lists, in the order of
    the words. `boxed` has _left, _right, _top, _bottom and _tie besides.

    A stretch is a page's boxes among those worked on at a time: about `stretch` rows, which
    bounds memory, and no page's end that more rows may follow. What shares a column or
    line in it shares one in the page, whatever other boxes the page has, so no row is ever
    taken apart again. Rows in another order only give more and shorter rows.
    """
    marks = ["_left", "_right", "_top", "_bottom", "_tie"]
    names = [c for c in boxed.columns if c not in (*keys, *marks)]

    def numbered(group: np.ndarray, low: np.ndarray, high: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # the island of each interval, numbered through all groups, and what each reaches
        order = np.lexsort((high, low, group))
        values, rank = np.unique(high[order], return_inverse=True)  # furthest end so far, a group at a time
        g, a = group[order], low[order]
        offset = g * (len(values) + 1)
        furthest = np.maximum.accumulate(rank + offset) - offset
        first = np.concatenate([[True], g[1:] != g[:-1]])
        reached = np.concatenate([[0.0], values[furthest[:-1].clip(0)]]) + gap
        new = first | (a > reached) | (np.isnan(a) & ~np.isnan(reached))
        at = np.flatnonzero(new)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return number, a[at], values[furthest[np.append(at[1:], len(order)) - 1]]

    def pages(t: pa.Table) -> np.ndarray:
        codes = np.zeros(len(t), np.int64)
        for k in keys:
            one = t[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            codes = np.unique(codes * (int(one.max()) + 1) + one, return_inverse=True)[1].astype(np.int64)
        return codes

    def whole(c: pa.ChunkedArray) -> pa.Array:
        return pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)

    def pack(t: pa.Table) -> pa.RecordBatch:
        page = pages(t)
        left, right, top, bottom, tie = (t[c].to_numpy() for c in marks)
        column, l, r = numbered(page, left, right, gap)
        line, low, high = numbered(column, top, bottom, 0.0)
        order = np.lexsort((tie, top, left, line))
        at = np.flatnonzero(np.diff(line[order], prepend=-1))
        some = order[at]  # a row of each line
        first = np.diff(page[some], prepend=-1) != 0
        own = np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))  # the page's first line
        of = column[some]
        begins = np.maximum.accumulate(np.where(np.diff(of, prepend=-1) != 0, np.arange(len(some)), 0))
        offsets = pa.array(np.append(at, len(order)).astype(np.int32))
        heads = t.select(keys).take(pa.array(some)).combine_chunks()
        sorted_rows = t.select(names).take(pa.array(order)).combine_chunks()

        return pa.RecordBatch.from_arrays(
            [whole(heads[k]) for k in keys] + [pa.array(x) for x in (
                first, of - of[own], np.arange(len(some)) - begins, l[of], r[of], low, high)]
            + [pa.ListArray.from_arrays(offsets, whole(sorted_rows[c])) for c in names],
            names=[*keys, "_first", "_column", "_line", "_l", "_r", "_t", "_b", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n < stretch:
                continue
            t = pa.Table.from_batches(held)
            page = pages(t)
            tail = n - int(np.flatnonzero(page != page[-1]).max(initial=-1)) - 1  # the last page may go on
            tail = 0 if 2 * tail > stretch else tail
            yield pack(t.slice(0, n - tail))
            held, n = t.slice(n - tail).to_batches() if tail else [], tail
        if n:
            yield pack(pa.Table.from_batches(held))

    schema = boxed.select(*keys).schema
    for name, kind in (("_first", "boolean"), ("_column", "long"), ("_line", "long"), *((c, "double") for c in ("_l", "_r", "_t", "_b"))):
        schema = schema.add(name, kind)
    for name in names:
        schema = schema.add(name, ArrayType(boxed.schema[name].dataType))
    return boxed.select(*keys, *marks, *names).mapInArrow(run, schema)


def lines_from_boxes(blocks: DataFrame, keys: list[str], gap: float = 40.0, parts: int | None = None, boxes: bool = True,
                     stretch: int = STRETCH) -> DataFrame:
    """Blocks (keys, bbox [x1, y1, x2, y2], ...) with block_num, line_num and seq as the boxes tell.

    Columns are what blank strips wider than `gap` part from top to bottom of a page. In a
    column, boxes share a line when the middle halves of their heights overlap, one after
    another, so slightly slanted or touching lines stay apart. Reading order: columns
    from the left, lines from the top, words from the left. Blocks without a box, or with
    a null in it, follow after all others, a line each. Without `boxes` the result leaves
    out bbox.

    Boxes are packed to lines where they lie (`line_units`) and stored once. A page that one
    stretch held is numbered by that and does not travel; of the others only what their lines
    reach does, an island of islands at a time, and their words once to meet the numbers.
    """
    spark = blocks.sparkSession
    whole = F.col("bbox").isNotNull() & (F.size("bbox") >= 4) & ~F.exists("bbox", lambda v: v.isNull())
    usable = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    plain = blocks.drop("block_num", "line_num", "seq")
    others = [c for c in plain.columns if c not in (*keys, "bbox")]
    shown = [c for c in plain.columns if boxes or c != "bbox"]

    def corner(box: Column) -> dict[str, Column]:
        x1, y1, x2, y2 = (box[i].cast("double") for i in range(4))
        return {"_left": F.least(x1, x2), "_right": F.greatest(x1, x2), "_top": F.least(y1, y2) + F.abs(y2 - y1) / 4, "_bottom": F.greatest(y1, y2) - F.abs(y2 - y1) / 4}

    tie = F.xxhash64(*others) if others else F.lit(0).cast("bigint")
    packed = line_units(plain.where(whole & F.expr(usable)).withColumns({**corner(F.col("bbox")), "_tie": tie}), keys, gap, stretch)
    path = scratch_path(spark, "box-lines")
    packed.write.option("compression", "zstd").parquet(path)
    units = spark.read.schema(packed.schema).parquet(path)
    torn = units.where("_first").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys).checkpoint()
    n_torn = torn.count()
    some = F.broadcast(torn) if n_torn <= FEW_PAGES else torn

    def placed(df: DataFrame, word: Column) -> DataFrame:
        return df.select(
            *shown, F.col("_column").cast("int").alias("block_num"), F.col("_line").cast("int").alias("line_num"),
            ((F.col("_column") * COLUMN_LINES + F.col("_line")) * LINE_WORDS + word).alias("seq"))

    def words(df: DataFrame, names: list[str]) -> DataFrame:
        return df.select(*keys, "_column", "_line", F.posexplode(F.arrays_zip(*names)).alias("_at", "_word")).select(
            *keys, "_column", "_line", "_at", *[F.col("_word")[c].alias(c) for c in names])

    found = placed(words(units.join(some, keys, "left_anti"), [c for c in shown if c not in keys] or ["bbox"]), F.col("_at") + 1)
    if n_torn:
        rest = units.join(some, keys, "left_semi")
        columns = islands(rest.select(*keys, "_l", "_r").distinct(), keys, "_l", "_r", "_column", gap, parts)
        reach = rest.select(*keys, "_l", "_r", "_t", "_b").distinct().join(columns, [*keys, "_l", "_r"])
        lines = islands(reach, [*keys, "_column"], "_t", "_b", "_line", 0.0, parts)
        met = rest.drop("_column", "_line").join(lines, [*keys, "_l", "_r", "_t", "_b"]).repartition(*keys, "_column", "_line")
        order = W.partitionBy(*keys, "_column", "_line").orderBy("_left", "_top", tie)
        found = found.unionByName(placed(
            words(met, [*others, "bbox"]).withColumns({c: v for c, v in corner(F.col("bbox")).items() if c in ("_left", "_top")}), F.row_number().over(order)))
    last = F.lit((1 << 62)).cast("bigint")
    return found.unionByName(plain.where(~F.coalesce(whole & F.expr(usable), F.lit(False))).select(
        *shown, F.lit((1 << 31) - 1).alias("block_num"), F.lit(None).cast("int").alias("line_num"),
        (last + F.pmod(F.xxhash64(*plain.columns), F.lit(1 << 60))).alias("seq")))


def exclude_overlaps_by_grid(candidates: DataFrame, photos: DataFrame, keys: list[str], limit: float = 0.15) -> DataFrame:
    """FLT-8 for pages with very many boxes: as `layout.exclude_overlaps`, as an equi join on
    grid cells instead of a list of photos in every row.

    A photo's grid has cells of the power of two not below its longer side, so it lies in
    four cells at most. A candidate is looked up in the grids that photos use (32 at most)
    and in few cells of each: one longer or higher than a cell / limit can't have a larger
    share than `limit` in common with such a photo. A pair meets in the one cell that holds
    the upper left corner of what it shares. Cells are part of the key, so a page with a
    third of all boxes is dealt to many tasks.
    """
    from idlens.operators.layout import overlap_share

    def sides(df: DataFrame) -> DataFrame:
        b = [F.col("bbox")[i] for i in range(4)]
        return df.select(*keys, "bbox", (b[2] - b[0]).alias("_w"), (b[3] - b[1]).alias("_h")).where("_w > 0 AND _h > 0")

    def cells(df: DataFrame) -> DataFrame:
        def span(low: int, high: int):
            return F.explode(F.sequence(F.floor(F.col("bbox")[low] / F.col("_cell")), F.floor(F.col("bbox")[high] / F.col("_cell"))))

        return df.withColumn("_cx", span(0, 2)).withColumn("_cy", span(1, 3))

    level = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("_w", "_h").cast("double")))).cast("bigint")
    shown = sides(photos).distinct().withColumn("_cell", level)
    grids = [r[0] for r in shown.select("_cell").distinct().orderBy("_cell").collect()]  # powers of two: few
    looked = sides(candidates).withColumn("_cell", F.explode(F.array(*[F.lit(g).cast("bigint") for g in grids]) if grids else F.array().cast("array<bigint>")))
    looked = cells(looked.where(F.greatest("_w", "_h") * limit <= F.col("_cell")))
    met = looked.join(cells(shown).select(*keys, "_cell", "_cx", "_cy", F.col("bbox").alias("_photo")), [*keys, "_cell", "_cx", "_cy"])
    corner = [F.floor(F.greatest(F.col("bbox")[i], F.col("_photo")[i]) / F.col("_cell")) == F.col(c) for i, c in ((0, "_cx"), (1, "_cy"))]
    hit = met.where(corner[0] & corner[1] & (overlap_share(F.col("bbox"), F.col("_photo")) > limit)).select(*keys, "bbox").distinct()
    return candidates.join(hit, [*keys, "bbox"], "left_anti").select(candidates.columns)
