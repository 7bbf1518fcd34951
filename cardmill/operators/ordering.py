"""Order of cards in a deck: interleaving of topics and the runs it should avoid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.sources.tables import materialize


#: Ranges a group's order is cut into before rows are numbered inside each.
RANGES = 4096


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, where null keys are equal."""
    renamed = right.select(*(F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in keys]
    return left.join(renamed, same).drop(*(f"_right_{c}" for c in keys))


def numbered(rows: DataFrame, group: list[str], at: Column, order: list[Column], name: str) -> DataFrame:
    """Rows with their number in their group, from 1, by ``at`` (from 0 to 1) and ``order``.

    A window over a group would put the whole group into one task. Here rows are
    counted per range of ``at`` first; the running count of ranges gives the offset
    of each, and only the rows of one range are sorted together.
    """
    cut = rows.withColumn("_at", at).withColumn("_range", F.least(F.floor(F.col("_at") * RANGES), F.lit(RANGES - 1)))
    counts = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = null_safe_join(cut, offsets, [*group, "_range"])
    inside = Window.partitionBy(*group, "_range").orderBy("_at", *order)
    return joined.withColumn(name, F.row_number().over(inside) + F.col("_offset")).drop("_at", "_range", "_offset")


def interleave(cards: DataFrame, deck: str, key: str, topic: str = "topic", seed: int = 42) -> DataFrame:
    """Cards with ``place`` from 1: each topic shuffled by a seeded hash, then the
    topics spread evenly over the deck.

    A card's position within its topic, over the topic's size, is where it belongs
    in the deck; sorting by it spreads every topic. Decks and topics of any size are
    numbered range by range.
    """
    chance = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / float(1 << 53)
    ranked = numbered(cards, [deck, topic], chance, [F.col(key)], "_rank")
    sizes = cards.groupBy(deck, topic).agg(F.count("*").alias("_size"))
    sized = null_safe_join(ranked, sizes, [deck, topic])
    spot = (F.col("_rank") - 0.5) / F.col("_size")
    return numbered(sized, [deck], spot, [F.xxhash64(topic, F.lit(seed)), F.col(key)], "place").drop("_rank", "_size")


def avoidable_runs(cards: DataFrame, deck: str, place: str, topic: str = "topic") -> DataFrame:
    """(deck, avoidable_runs): neighbours of one topic while a card of another topic
    was still to come. Null decks are one deck; a null topic equals no other.

    Rows are cut into ranges of (deck, place), so a large deck is spread; what stands
    before the first row of a range is the last row of the range before. Whether
    another topic comes later follows from the last place of each topic.
    """
    rows = cards.select(F.col(deck).alias("deck"), F.col(place).alias("place"), F.col(topic).alias("topic"))
    ends = rows.groupBy("deck", "topic").agg(F.max("place").alias("last"))
    by_last = Window.partitionBy("deck").orderBy(F.desc("last"))  # one row per topic
    last_two = ends.select("deck", F.struct("last", "topic").alias("end"), F.row_number().over(by_last).alias("n")).where("n <= 2").groupBy("deck").agg(F.max(F.when(F.col("n") == 1, F.col("end"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("end"))).alias("second"))
    ranged = materialize(rows.repartitionByRange(F.col("deck"), F.col("place")).withColumn("range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("range").orderBy("deck", "place")
    seen = lambda c: F.lag(F.struct("deck", "topic")).over(c)
    tails = ranged.groupBy("range").agg(F.max_by(F.struct("deck", "topic"), F.struct("deck", "place")).alias("tail"))
    before = tails.select("range", F.lag("tail").over(Window.orderBy("range")).alias("tail"))  # one row per range
    marked = ranged.join(before, "range").withColumn("previous", F.coalesce(seen(inside), F.col("tail")))
    again = F.col("previous")["deck"].eqNullSafe(F.col("deck")) & (F.col("previous")["topic"] == F.col("topic"))
    other = F.when(F.col("first")["topic"].eqNullSafe(F.col("topic")), F.col("second")["last"]).otherwise(F.col("first")["last"])
    judged = null_safe_join(marked.select("deck", "place", "topic", F.coalesce(again, F.lit(False)).alias("again")), last_two, ["deck"])
    return judged.groupBy("deck").agg(F.count_if(F.col("again") & (other > F.col("place"))).alias("avoidable_runs")).withColumnRenamed("deck", deck)


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct non-empty values with the place they are first seen at."""
    return rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(value).agg(F.min(order).alias("first_at")).orderBy("first_at", value)
