"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sizes are words. Each source gets a target from its weight, at most cap times its size, the excess being
shared again by weight. The targets buy blocks of equal size: the highest quotients weight / (2 k + 1) win them,
first among sources, then among the shards of each source. A shard is a seeded hash bucket of the source's
documents, laid one after another in seeded order and cut into blocks. A shard with q blocks to take out of n
takes every block q div n times and q mod n blocks once more, chosen evenly from a seeded phase.

A hot source has many shards, so that no task holds a source: as many as its words over shard_words, or, for a source of
more than (shard_words / 4) ** 2 words, a quarter of the root of its words. Only shard and source totals meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, settle

WEIGHTS = (5, 2, 1)
#: Sources up to this number are broadcast; more are joined by key.
BROADCAST_SOURCES = 10_000


def _seeded(seed: int, *parts: Column) -> Column:
    """60 bits of an MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Integer division of non-negative numbers."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def highest_quotients(parties: DataFrame, keys: list[str], group: list[str], weight: str, seats: str, most: str) -> DataFrame:
    """Sainte-Lague seats for each party; parties has one row per key.

    group: columns that tell one apportionment from another; seats: how many the group deals out; most: a party's limit.
    With n parties, no party ends further than share * n / 2 + 1/2 from its exact quota, so only the quotients in
    that range are listed: about three a party. Ties go to the smaller key. A group with no weight deals out nothing.
    """
    own = Window.partitionBy(*group)
    total, n = F.sum(weight).over(own), F.count(F.lit(1)).over(own)
    p = parties.select(*dict.fromkeys([*keys, *group]), weight, seats, most, total.cast("double").alias("_total"), n.alias("_n"))
    share = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    p = p.withColumn("_share", share).withColumn("_reach", F.col("_share") * F.col("_n") / 2 + 0.5)
    quota = F.col("_share") * F.col(seats)
    p = p.withColumn("_low", F.least(F.greatest(F.floor(quota - F.col("_reach")), F.lit(0)), F.col(most)))
    p = p.withColumn("_high", F.least(F.ceil(quota + F.col("_reach")), F.col(most)))
    p = p.withColumn("_left", F.col(seats) - F.sum("_low").over(own))
    steps = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array().cast("array<bigint>"))
    listed = p.select("*", F.explode_outer(steps).alias("_k"))
    order = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc_nulls_last(), *keys, "_k")
    won = F.when(F.col("_k").isNotNull() & (F.row_number().over(order) <= F.col("_left")) & (F.col("_share") > 0), 1).otherwise(0)
    return listed.withColumn("_won", won).groupBy(*keys).agg((F.first("_low") + F.sum("_won")).alias("quota"))


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Adds source_rank, weight, total and target to rows (source, source_size).

    Filling to a level L gives each source min(cap * size, L * weight). In order of cap * size / weight the capped
    sources come first; a source is capped if the level reached with all earlier ones capped is no less than its own.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    s = sources.withColumn("source_rank", rank.cast("long"))
    s = s.withColumn("weight", F.element_at(listed, (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(everything))
    order = everything.orderBy(F.col("_cap") / F.col("weight"), "source_rank")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (F.col("total") - before) / rest)
    s = s.withColumn("_capped", F.col("_cap") / F.col("weight") <= F.col("_level"))
    level = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything)
    s = s.withColumn("target", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(level * F.col("weight")))
    return s.select("source", "source_size", "source_rank", "total", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, block: int = 8, shard_words: int = 65_536, seed: int = 17, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    docs needs doc_id, text and source; other columns are left alone. A null text has size 0, a null source is a
    source of its own (last in order), a null doc_id is hashed like "-". Repeated rows are separate rows. An empty
    table gives an empty result. taken counts words with repeats, at most cap times the size. Columns carried are added to
    the result and settle the order of rows with one doc_id and size.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = settle(docs.select("doc_id", "source", size.alias("size"), *carried))
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    blocks = lambda c: F.ceil(F.col(c) / block)
    parties = sources.withColumn("_all", F.lit(0)).withColumn("_seats", F.floor(F.col("total") / block)).withColumn("_most", blocks("source_size") * cap)
    quotas = highest_quotients(parties, ["source_rank"], ["_all"], "target", "_seats", "_most")
    sources = settle(sources.join(quotas.withColumnRenamed("quota", "source_quota"), "source_rank"))
    # shards grow with the root of a large source, so that neither a shard nor the list of a source's shards is ever large
    words = F.greatest(F.lit(shard_words).cast("double"), F.ceil(4 * F.sqrt(F.col("source_size"))))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / words))
    side = sources.select(F.col("source").alias("_source"), "source_size", "source_rank", "target", "source_quota", shards.alias("_shards"))
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    hashed = sized.withColumn("_h", _seeded(seed, F.col("doc_id")))
    placed = hashed.join(side, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.col("_h"), F.col("_shards")))
    totals = placed.groupBy("source_rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("_seats"))
    totals = totals.withColumn("_most", blocks("shard_size") * cap)
    shard_quota = highest_quotients(totals, ["source_rank", "shard"], ["source_rank"], "shard_size", "_seats", "_most")
    shard_quota = shard_quota.withColumnRenamed("source_rank", "_rank").withColumnRenamed("shard", "_shard")
    line = Window.partitionBy("source_rank", "shard").orderBy("_h", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(line)).withColumn("_size", F.sum("size").over(Window.partitionBy("source_rank", "shard")))
    laid = laid.join(shard_quota, (F.col("source_rank") == F.col("_rank")) & (F.col("shard") == F.col("_shard")))
    return laid.select("doc_id", "source", "size", "source_size", "target", _taken(block, seed).alias("taken"), *carried)


def _taken(block: int, seed: int) -> Column:
    """Words taken between the start and the end of a document in its shard."""
    n = F.greatest(F.ceil(F.col("_size") / block), F.lit(1)).cast("long")
    base, extra = _div(F.col("quota"), n), F.pmod(F.col("quota"), n)
    phase = F.pmod(_seeded(seed, F.col("source_rank"), F.col("shard")), n)
    chosen = lambda i: _div(i * extra + phase, n)  # noqa: E731  blocks chosen among the first i

    def upto(p: Column) -> Column:
        i, rest = _div(p, F.lit(block)), F.pmod(p, F.lit(block))
        return base * p + block * chosen(i) + (chosen(i + 1) - chosen(i)) * rest

    return (upto(F.col("_end")) - upto(F.col("_end") - F.col("size"))).cast("long")
