"""Mixing sources to target weights by tempered weights and block permutations.

With source shares ``q`` and target shares ``t`` the weights are ``q * (t/q)^a``,
normalised. Exponent 1 gives the targets, exponent 0 the shares as they are;
without targets the same solver tempers ``q^a``. The exponent is bisected to meet
a repetition limit (no source used beyond ``max_repeats`` times its size) or a
target entropy. Without a wanted total the mix is as large as it can be with every
present source at its target, and the bisection ends at exponent 1.

A budget is realised block by block: a block is one permutation of a source's
documents, by a seeded hash; whole blocks count whole, and the last one is cut
where the running total meets the budget. The running total is taken over 4096
hash ranges per source first and over single documents only inside the range
where the cut falls, so no source, however large, meets in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardmill.llm.tokenizer import count_tokens
from cardmill.sources.tables import BLANKS, materialize, table

RANGES = 4096


def tidy_source(col: Column) -> Column:
    """Trimmed, lower case, ``_`` as ``-``; null where nothing remains."""
    return F.nullif(F.translate(F.lower(F.btrim(col, F.lit(BLANKS))), "_", "-"), F.lit(""))


@dataclass(frozen=True)
class Source:
    name: str
    tokens: int
    target: float
    max_repeats: int


def tempered(sources: list[Source], exponent: float, targets: bool = True) -> list[float]:
    total = sum(s.tokens for s in sources) or 1
    raw = []
    for s in sources:
        q = s.tokens / total
        raw.append((q ** (1 - exponent) * s.target**exponent if targets else q**exponent) if s.tokens and (s.target > 0 or not targets) else 0.0)
    whole = sum(raw)
    return [r / whole for r in raw] if whole else raw


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect(holds, low: float, high: float, steps: int = 60) -> float:
    """The largest exponent in [low, high] for which ``holds``, if it holds from low on."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def largest_total(sources: list[Source]) -> float:
    """Tokens of the largest mix in which every present source has its target."""
    here = [s for s in sources if s.tokens and s.target > 0]
    whole = sum(s.target for s in here)
    return min((s.max_repeats * s.tokens * whole / s.target for s in here), default=0.0)


def solve(sources: list[Source], total: float | None = None) -> tuple[float, float, list[float]]:
    """(exponent, total, weights) under the repetition limits. If even the natural
    shares exceed a limit, the surplus of full sources goes to the others."""
    total = largest_total(sources) if total is None else min(total, sum(s.max_repeats * s.tokens for s in sources if s.target > 0))
    if not total:
        return 1.0, 0.0, tempered(sources, 1.0)

    def fits(exponent: float) -> bool:
        return all(w * total <= s.max_repeats * s.tokens * (1 + 1e-9) for s, w in zip(sources, tempered(sources, exponent)))

    exponent = bisect(fits, 0.0, 1.0)
    weights = tempered(sources, exponent)
    caps = [s.max_repeats * s.tokens / total for s in sources]
    full = [False] * len(sources)
    while any(w > c * (1 + 1e-9) and not f for w, c, f in zip(weights, caps, full)):
        full = [f or w >= c for w, c, f in zip(weights, caps, full)]
        rest = 1 - sum(c for c, f in zip(caps, full) if f)
        free = sum(w for w, f in zip(weights, full) if not f)
        weights = [c if f else w * rest / free for w, c, f in zip(weights, caps, full)]
    return exponent, total, weights


def temperature(sources: list[Source], target_entropy: float) -> float:
    """The exponent in [0, 8] at which ``q^a`` reaches the wanted entropy; entropy
    falls as the exponent rises, from log n at 0. Above 1 large sources gain."""
    return bisect(lambda a: entropy(tempered(sources, a, targets=False)) >= target_entropy, 0.0, 8.0)


def source_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, tidy source and tokens of every document, counted once and kept."""
    sizes = count_tokens(docs.withColumn("source", tidy_source(F.col("source"))), ["doc_id", "source"])
    return materialize(sizes, "sizes")


def source_totals(sizes: DataFrame, targets: DataFrame) -> list[Source]:
    """One entry per target source (a short, fixed list); duplicates keep the greatest share."""
    wanted = targets.groupBy(tidy_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    rows = wanted.where("source is not null").join(have, "source", "left").orderBy("source").collect()
    return [Source(r.source, int(r.n_tokens or 0), float(r.target_share or 0), int(r.max_repeats if r.max_repeats is not None else 1)) for r in rows]


def _plan(spark: SparkSession, sources: list[Source], total: float, weights: list[float]) -> DataFrame:
    rows = []
    for s, w in zip(sources, weights):
        budget = w * total
        blocks = min(int(budget / s.tokens + 1e-9), s.max_repeats) if s.tokens else 0
        rest = max(0.0, budget - blocks * s.tokens) if blocks < s.max_repeats else 0.0
        rows.append((s.name, budget, blocks, rest, (budget / s.tokens) if s.tokens else 0.0, s.max_repeats))
    return spark.createDataFrame(rows, "source string, budget double, blocks int, rest double, turns double, max_repeats int")


def _place(block: Column, seed: int) -> Column:
    """A document's place in a block's permutation, from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", block, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def mix(spark: SparkSession, sizes: DataFrame, sources: list[Source], total: float | None = None, seed: int = 0) -> DataFrame:
    """Documents of the mix: one row per use.

    doc_id, source, block (1, 2, ... the pass over the source), n_tokens, and
    mix_key in [0, 1]: in its order every stretch of the mix has the weights.
    Documents without tokens, without a source or with one that has no target are
    not used. A document is used at most max_repeats times. Equal inputs and
    seeds give equal mixes, whatever the partitioning.
    """
    _, total, weights = solve(sources, total)
    plan = _plan(spark, sources, total, weights)  # one row per target source
    docs = sizes.where("n_tokens > 0").join(plan, "source")

    whole = docs.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    whole = whole.withColumn("place", _place(F.col("block"), seed))

    last = docs.where("rest > 0").withColumn("block", F.col("blocks") + 1)
    last = last.withColumn("place", _place(F.col("block"), seed)).withColumn("range", F.floor(F.col("place") * RANGES))
    per_range = last.groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    # At most RANGES rows per target source; whether that is small enough to send everywhere is for the planner.
    ranges = per_range.withColumn("through", F.sum("in_range").over(up_to)).withColumn("ahead", F.col("through") - F.col("in_range")).drop("in_range")
    placed = last.join(ranges, ["source", "range"]).where("ahead < rest")
    inside = placed.where("through <= rest").drop("range", "through", "ahead")
    order = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        placed.where("through > rest")
        .withColumn("so_far", F.col("ahead") + F.sum("n_tokens").over(order))
        .where(F.col("so_far") - F.col("n_tokens") / 2 <= F.col("rest"))
        .drop("range", "through", "ahead", "so_far")
    )
    used = whole.unionByName(inside).unionByName(cut)
    key = F.least((F.col("block") - 1 + F.col("place")) / F.col("turns"), F.lit(1.0))
    return used.select("doc_id", "source", "block", "n_tokens", key.alias("mix_key"))


def uses(spark: SparkSession, sizes: DataFrame, sources: list[Source], total: float | None = None, seed: int = 0) -> DataFrame:
    """Every document with the number of its uses in the mix: doc_id, source,
    n_tokens, uses (0 where it isn't used)."""
    mixed = mix(spark, sizes, sources, total, seed).groupBy("doc_id", "source").agg(F.count("*").alias("uses"))
    return sizes.join(mixed, ["doc_id", "source"], "left").select("doc_id", "source", "n_tokens", F.coalesce("uses", F.lit(0)).alias("uses"))


def shares(spark: SparkSession, mixed: DataFrame, sources: list[Source], total: float | None = None) -> DataFrame:
    """Per target source: what it has, should have and got; absent sources get 0."""
    exponent, _, weights = solve(sources, total)
    rows = [(s.name, s.target, s.max_repeats, s.tokens, w, exponent) for s, w in zip(sources, weights)]
    wanted = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens bigint, weight double, exponent double")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("block").alias("most_repeats"))
    joined = wanted.join(got, "source", "left").fillna(0, ["tokens", "uses", "most_repeats"])
    return joined.withColumn("share", F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())))


#: Tokens of a mix, as a share of what the target sources have.
WANTED = 0.25


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, list[Source]]:
    sizes = source_sizes(table(spark, folder, "documents"))
    return sizes, source_totals(sizes, table(spark, folder, "source_targets"))


def wanted_total(sources: list[Source]) -> float:
    return WANTED * sum(s.tokens for s in sources if s.target > 0)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """A mix that grows with the corpus: as near to the targets as the repetition limits allow."""
    sizes, sources = _prepared(spark, folder)
    return mix(spark, sizes, sources, wanted_total(sources))


def p8_uses(spark: SparkSession, folder: str) -> DataFrame:
    sizes, sources = _prepared(spark, folder)
    return uses(spark, sizes, sources, wanted_total(sources))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes, sources = _prepared(spark, folder)
    total = wanted_total(sources)
    return shares(spark, mix(spark, sizes, sources, total), sources, total)


def p8_shares_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mix in which every present source has its target: exponent 1."""
    sizes, sources = _prepared(spark, folder)
    return shares(spark, mix(spark, sizes, sources), sources)


def p8_temperature(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of tempered natural shares with the entropy of the target shares."""
    _, sources = _prepared(spark, folder)
    here = [s for s in sources if s.tokens]
    wanted = entropy(tempered(here, 1.0))
    exponent = temperature(here, wanted)
    rows = [(s.name, s.tokens, w, exponent) for s, w in zip(here, tempered(here, exponent, targets=False))]
    return spark.createDataFrame(rows, "source string, tokens bigint, weight double, exponent double")


QUERIES = {"p8_mix": p8_mix, "p8_uses": p8_uses, "p8_shares": p8_shares, "p8_shares_exact": p8_shares_exact, "p8_temperature": p8_temperature}
SQL: dict[str, str] = {}
