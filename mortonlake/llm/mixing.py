"""Mixing sources to target weights by a temperature.

A source's weight is its token share to the power of an exponent, normalised. The
exponent is bisected, many points at a time, by aggregations over the table of
sources: towards a target entropy or, by default, the smallest exponent (the
flattest mix) at which no source is repeated more than max_repeats times. The
budget of tokens is given, or the least at which every source is used once in full.

The weights are realised by block permutations: a source's documents fall into a
fixed number of blocks by hash, each epoch orders the blocks anew by a seeded hash,
whole epochs take all blocks, and the last epoch takes blocks in its order
while the budget lasts. Only (source, block) totals are ever sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import SPACE, load, table, text_of

MAX_REPEATS, BLOCKS, SEED, POINTS, ROUNDS, BROADCAST_ROWS = 2.0, 1024, 17, 16, 8, 200_000


def word_count() -> Column:
    return F.size(F.filter(F.split(text_of(), SPACE), lambda w: w != "")).cast("long")


def exponent(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent in [0, 1]. shares: one row a source, its share > 0 in column share.

    Entropy in nats falls as the exponent rises; one out of reach gives the end nearest to
    it. The least repeated source is the largest one, so its weight decides the budget
    and repeats are (weight / share) over the same of the largest source: (largest
    / share) ** (1 - exponent), which also falls. Each round narrows the
    interval by POINTS + 1 with one aggregation.
    """
    low, high = 0.0, 1.0
    if entropy is None and max_repeats is None:
        return 1.0
    for _ in range(ROUNDS):
        at = [low + (high - low) * (k + 1) / (POINTS + 1) for k in range(POINTS)]
        p = F.col("share")
        if entropy is not None:
            z = shares.agg(*[x for k, a in enumerate(at) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{k}"))]).first()
            over = [math.log(z[f"z{k}"]) - a * z[f"s{k}"] / z[f"z{k}"] > entropy if z[f"z{k}"] else False for k, a in enumerate(at)]
        else:
            z = shares.agg(F.max(p).alias("most"), F.min(p).alias("least")).first()
            over = [z.least is not None and (z.most / z.least) ** (1 - a) > max_repeats for a in at]
        n = sum(over)  # monotone: the first n are too flat
        low, high = (at[n - 1] if n else low), (at[n] if n < POINTS else high)
    return high


def weights(sized: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """One row a source: source, tokens, share, weight and repeats, the epochs (with a fraction) that meet the budget."""
    totals = table(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mixing-sources")
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = totals.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1))))
    a = exponent(shares, entropy, max_repeats)
    z = shares.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.max(F.pow("share", F.lit(1 - a))).alias("most")).first()
    if z.z is None:
        return shares.withColumns({"weight": F.lit(0.0), "repeats": F.lit(0.0)})
    # budget * weight / tokens, where the least of weight / tokens is that of the largest source (the smallest, above exponent 1)
    spent = float(budget) if budget is not None else whole * z.z * z.most
    return shares.withColumn("weight", F.pow("share", F.lit(a)) / F.lit(z.z)).withColumn("repeats", F.round(F.lit(spent) * F.col("weight") / F.col("tokens"), 9))


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, blocks: int = BLOCKS, seed: int = SEED, n_tokens: Column | None = None) -> DataFrame:
    """docs with columns epoch and block_order: a row for each time a document is used.

    Read in the order (epoch, block_order, source) a prefix of the result has about the
    target weights. Null source is a source of its own; documents without tokens are used
    once in each whole epoch of their source and need no budget; a source of
    such documents alone is used once. Repeated rows count each. An empty table
    gives an empty result. Columns named epoch or block_order are replaced.
    """
    names = [c for c in docs.columns if c not in ("epoch", "block_order")]
    inner = [f"c{i}" for i in range(len(names))]  # no name of the caller's meets one of these steps
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text_of())
    base = docs.select(*[F.col(n).alias(c) for n, c in zip(names, inner, strict=True)], "source", (word_count() if n_tokens is None else F.coalesce(n_tokens, F.lit(0)).cast("long")).alias("__n"), F.pmod(key, F.lit(blocks)).cast("int").alias("__block"))
    sized = table(base.groupBy("source", "__block").agg(F.sum("__n").alias("n_tokens")), "mixing-blocks")
    w = weights(sized, entropy, max_repeats, budget).select(F.col("source").alias("source_"), "tokens", "repeats")
    each = sized.join(w, F.col("source").eqNullSafe(F.col("source_")), "left").withColumns({"repeats": F.coalesce("repeats", F.lit(1.0)), "tokens": F.coalesce("tokens", F.lit(0))})
    each = each.withColumns({"whole": F.floor("repeats"), "order": F.xxhash64(F.lit(seed), F.floor("repeats"), F.coalesce("source", F.lit("")), "__block")})
    upto = Window.partitionBy("source").orderBy("order", "__block").rowsBetween(Window.unboundedPreceding, 0)  # at most `blocks` rows a source
    each = each.withColumn("upto", F.sum("n_tokens").over(upto)).withColumn("times", F.col("whole") + F.when(F.col("upto") <= F.round((F.col("repeats") - F.col("whole")) * F.col("tokens")), 1).otherwise(0))
    each = table(each.select(F.col("source").alias("__source"), F.col("__block").alias("__of"), F.col("times").alias("__times")), "mixing-times")
    if each.count() <= BROADCAST_ROWS:
        each = F.broadcast(each)
    used = base.join(each, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__of")))
    used = used.filter("__times > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, __times - 1)")))
    order = F.xxhash64(F.lit(seed), F.col("epoch"), F.coalesce("source", F.lit("")), F.col("__block"))
    return used.select(*inner, "epoch", order.alias("block_order")).toDF(*names, "epoch", "block_order")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "block_order")
