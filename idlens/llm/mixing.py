"""Mixing sources to target weights with Sainte-Laguë quotas.

Every source is a stream of its documents' words in a seeded order, cut into blocks
of `block_words`. Blocks are the seats of an apportionment: the mix's shards get
integer numbers of blocks of each source by the highest quotients target / (2k + 1),
and a source gives its first blocks, beginning anew (a further epoch) when all are
taken. So a document is taken whole and equally often, but for the one at the end
of its source's last block.

Quotas need no list of all seats. Rounding target / divisor gives every seat whose
quotient lies above a bound; only the few seats around it are compared, so the work
depends on the number of sources alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlens.llm.common import cut, words

WEIGHTS = (5, 2, 1)
LIMIT = 3  # no source or document is taken more often
BLOCK_WORDS = 4  # small, so that a small source comes near its target, too
SHARDS = 8
SEED = 42


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size -> adds target (words, double).

    Weights go round the sources in code point order, null last. All sizes together
    are shared by weight; a target stops at `limit` times its source's size and the
    excess is shared again. In the order of limit * size / weight the sources that
    stop come first, so sums up to each source tell where stopping ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    top = F.col("source_size") * limit
    known = sources.withColumn("_weight", weight).withColumn("_top", top).withColumn("_ratio", F.col("_top") / F.col("_weight"))
    known = known.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_weight").over(everything))
    level = (F.col("_all") - F.coalesce(F.sum("_top").over(before), F.lit(0))) / (
        F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    known = known.withColumn("_stops", level * F.col("_weight") > F.col("_top"))
    stopped = lambda c: F.coalesce(F.sum(F.when(F.col("_stops"), F.col(c))).over(everything), F.lit(0))
    left = F.col("_weights") - stopped("_weight")
    rest = (F.col("_all") - stopped("_top")) / F.when(left > 0, left)
    return known.withColumn("target", F.when(F.col("_stops"), F.col("_top").cast("double")).otherwise(
        F.coalesce(F.col("_weight") * rest, F.lit(0.0)))).select("source", "source_size", "target")


def sainte_lague(targets: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target -> one line per source and shard (0 ..): quota, the
    blocks it takes, and upto, the blocks of the source in this and earlier shards.

    The quotas of the first j shards are the apportionment of their blocks, and the
    method never takes a seat back when the house grows, so differences are quotas.
    A source has at most limit * size words' worth of seats.
    """
    everything = Window.partitionBy()
    house = F.floor(F.floor(F.col("_all") / block_words) * F.col("_upto_shard") / shards)
    lines = targets.withColumn("_all", F.round(F.sum("target").over(everything))).withColumn(
        "_upto_shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("_house", house)
    seats = F.floor(F.col("target") * F.col("_house") / F.when(F.col("_all") > 0, F.col("_all")) + 0.5)
    most = F.floor(F.col("source_size") * limit / block_words)
    lines = lines.withColumn("_most", most).withColumn("_seats", F.least(F.coalesce(seats, F.lit(0)), F.col("_most")))
    lines = lines.withColumn("_open", F.col("_house") - F.sum("_seats").over(Window.partitionBy("_upto_shard")))
    # the seats next to the bound: the highest unfilled ones, or the lowest filled ones
    steps = F.when(F.col("_open") == 0, F.array().cast("array<bigint>")).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.abs(F.col("_open")) - 1))
    near = lines.where(F.col("target") > 0).withColumn("_step", F.explode(steps)).withColumn(
        "_seat", F.when(F.col("_open") > 0, F.col("_seats") + F.col("_step")).otherwise(F.col("_seats") - 1 - F.col("_step")))
    near = near.where((F.col("_seat") >= 0) & (F.col("_seat") < F.col("_most"))).withColumn(
        "_quotient", F.col("target") / (2 * F.col("_seat") + 1))
    # equal quotients: the first source in code point order has the seat, so the last one gives it up
    adds = F.col("_open") > 0
    rank = F.row_number().over(Window.partitionBy("_upto_shard").orderBy(
        F.when(adds, -F.col("_quotient")).otherwise(F.col("_quotient")), F.when(adds, F.col("source").isNull()).otherwise(F.col("source").isNotNull()),
        F.when(adds, F.col("source")).asc(), F.when(~adds, F.col("source")).desc(), "_step"))
    moved = near.withColumn("_rank", rank).where(F.col("_rank") <= F.abs(F.col("_open"))).groupBy("source", "_upto_shard").agg(
        F.sum(F.signum("_open")).cast("bigint").alias("_moved"))
    both = lines.alias("l").join(moved.alias("m"), F.col("l.source").eqNullSafe(F.col("m.source")) & (
        F.col("l._upto_shard") == F.col("m._upto_shard")), "left").select(
        "l.source", "l.source_size", "l.target", "l._upto_shard", (F.col("_seats") + F.coalesce("_moved", F.lit(0))).alias("upto"))
    earlier = F.lag("upto", 1, 0).over(Window.partitionBy("source").orderBy("_upto_shard"))
    return both.select("source", "source_size", "target", (F.col("_upto_shard") - 1).alias("shard"), (F.col("upto") - earlier).alias("quota"), "upto")


def words_within(first: Column, size: Column, stream: Column, upto: Column) -> Column:
    """Words of a document at [first, first + size) of a stream among the first `upto`
    words of the stream repeated without end."""
    rounds = F.when(stream > 0, F.floor(upto / stream)).otherwise(0)
    rest = upto - rounds * stream
    return (rounds * size + F.greatest(F.lit(0), F.least(size, rest - first))).cast("bigint")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block_words: int = BLOCK_WORDS,
        shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard_taken (words that each
    shard takes of the document) and the columns named in `keep`.

    Null texts have no words and are taken 0 times; a null source is a source of its
    own. Repeated rows are documents of their own. The order within a source is that
    of a hash of seed, doc_id and text; sums are taken in 4,096 stretches of the hash,
    so that a source with a third of all rows still spreads over many tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    rows = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), place.alias("_place"), *keep).withColumn(
        "_stretch", F.substring("_place", 1, 3))
    rows = rows if keep else cut(rows)
    stretches = cut(rows.groupBy("source", "_stretch").agg(F.sum("size").alias("_words")))
    before = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    targets = cut(source_targets(stretches.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, limit))
    quotas = sainte_lague(targets, block_words, shards, limit).groupBy("source", "source_size", "target").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("_upto"))
    plan = starts.alias("s").join(quotas.alias("q"), F.col("s.source").eqNullSafe(F.col("q.source"))).select(
        F.col("s.source").alias("_source"), F.col("s._stretch").alias("_part"), "_start", "source_size", "target", "_upto")

    within = Window.partitionBy("source", "_stretch").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["_source"]) & (placed["_stretch"] == plan["_part"]))
    first = F.col("_start") + F.col("_offset")
    upto = F.transform("_upto", lambda b: words_within(first, F.col("size"), F.col("source_size"), b * block_words))
    taken = joined.withColumn("_taken", upto)
    per_shard = F.transform("_taken", lambda x, i: x - F.when(i > 0, F.get(F.col("_taken"), i - 1)).otherwise(0))
    return taken.select("doc_id", "source", "size", "source_size", "target", F.element_at("_taken", -1).alias("taken"),
                        per_shard.alias("shard_taken"), *keep)
