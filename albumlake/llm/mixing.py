"""Temperature mixing of sources: exponentiated token shares, a bisected exponent, budgeted block permutations.

A null source is a source of its own; null and empty texts hold no tokens and ride along with their source (they cost no
budget). A source without tokens is taken once. An empty table gives an empty result. Copies of a row come out as
separate rows with their own `epoch`. Result columns replace input columns of the same name (compared without case).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, set_aside, table, word_count

MAX_EPOCHS = 4.0
BLOCKS = 1024


def weights_at(tokens: list[int], exponent: float) -> list[float]:
    """Normalised tokens**exponent, computed from logs so huge counts do not overflow."""
    top = max(tokens)
    raw = [math.exp(exponent * (math.log(t) - math.log(top))) for t in tokens]
    return [r / sum(raw) for r in raw]


def bisect_exponent(tokens: list[int], target_entropy: float | None = None, max_epochs: float | None = MAX_EPOCHS, steps: int = 60) -> float:
    """The exponent in [0, 1] that meets a target entropy (nats) or else the flattest one whose repetition stays in
    max_epochs, where the budget takes every source at least once."""
    tokens = [t for t in tokens if t > 0]
    if len(tokens) < 2:
        return 1.0

    def flat_enough(e: float) -> bool:
        w = weights_at(tokens, e)
        if target_entropy is not None:
            return -sum(x * math.log(x) for x in w if x) <= target_entropy
        rates = [x / t for x, t in zip(w, tokens, strict=True)]
        return max(rates) / min(rates) <= max_epochs

    lo, hi = 0.0, 1.0
    if flat_enough(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if flat_enough(mid) else (mid, hi)
    return hi


def flattest(least: int | None, most: int | None, max_epochs: float) -> float:
    """The least exponent at which the smallest source is repeated max_epochs times at most: (most / least) ** (1 - e)."""
    return max(0.0, 1 - math.log(max_epochs) / math.log(most / least)) if least and most > least else 0.0


def entropy_exponent(sources: DataFrame, target_entropy: float, rounds: int = 10, width: int = 31) -> float:
    """bisect_exponent's answer for a target entropy, over any number of sources: every round sums t^e and t^e*ln(t) over
    all of them for `width` exponents in one aggregate, and keeps one of the width + 1 gaps."""
    sizes = materialise(sources.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")))
    count, top = sizes.agg(F.sum("c"), F.max("n_tokens")).first()
    if not count or count < 2:
        return 1.0
    if math.log(count) <= target_entropy:
        return 0.0
    x = F.log(F.col("n_tokens").cast("double")) - math.log(top)
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        tried = [lo + (hi - lo) * (i + 1) / (width + 1) for i in range(width)]
        sums = [f for e in tried for f in (F.sum(F.col("c") * F.exp(x * e)), F.sum(F.col("c") * F.exp(x * e) * x))]
        got = sizes.agg(*[f.alias(f"s{i}") for i, f in enumerate(sums)]).first()
        flat = [math.log(got[2 * i]) - e * got[2 * i + 1] / got[2 * i] <= target_entropy for i, e in enumerate(tried)]
        at = flat.index(True) if True in flat else width
        lo, hi = (tried[at - 1] if at else lo), (tried[at] if at < width else hi)
    return hi


def source_plan(sources: DataFrame, tokens: str = "n_tokens", exponent: float = 1.0) -> DataFrame:
    """One row per source (any number of them): weight, epochs, budget in tokens. Native; sums stay on executors."""
    w = F.when(F.col(tokens) > 0, F.pow(F.col(tokens).cast("double"), F.lit(exponent)))
    rate = F.col("_w") / F.col(tokens)
    planned = sources.withColumn("_w", w)
    total = planned.agg(F.sum("_w").alias("_all"), F.min(rate).alias("_least"))
    out = planned.crossJoin(F.broadcast(total))
    return out.select(
        *sources.columns,
        F.coalesce(F.col("_w") / F.col("_all"), F.lit(0.0)).alias("weight"),
        F.coalesce(F.floor(F.col(tokens) * F.round(rate / F.col("_least"), 9)), F.lit(0)).cast("long").alias("budget"),
    )


def mix_sources(docs: DataFrame, max_epochs: float = MAX_EPOCHS, target_entropy: float | None = None, blocks: int = BLOCKS, seed: int = 17, text: str = "text") -> DataFrame:
    """docs repeated to their source's budget, plus n_tokens, weight, epoch, block and order_key.

    Rows of a source fall in `blocks` blocks by hash. The budget pays whole epochs, then whole blocks in a permuted
    order, then rows of one last block in hash order until it is spent; so running sums see block totals, and rows of a
    single block only, never a whole source. No source is repeated more than `max_epochs` times, also where a target
    entropy asks for more. Read by order_key, an epoch's blocks come one after the other in a permuted order. For the exponent only sums go to the driver: the least and largest source
    total, or with a target entropy two sums over all sources for each exponent tried.
    """
    docs, back = set_aside(docs, ["_src", "_h", "block_tokens", "whole", "left", "_times"], ["n_tokens", "weight", "epoch", "block", "order_key"])
    d = docs.withColumns({
        "_src": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        "n_tokens": word_count(F.col(text)).cast("long"),
        "_h": F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col(text), F.lit(""))),
    }).withColumn("block", F.pmod("_h", F.lit(blocks)).cast("int"))
    per_block = d.groupBy("_src", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    sources = per_block.groupBy("_src").agg(F.sum("block_tokens").alias("n_tokens"))
    ends = sources.filter("n_tokens > 0").agg(F.min("n_tokens"), F.max("n_tokens")).first()
    if target_entropy is None:
        exponent = bisect_exponent(sorted({int(x) for x in ends if x}), None, max_epochs)
    else:  # a flatter mixture than max_epochs allows is not made
        exponent = max(entropy_exponent(sources, target_entropy), flattest(ends[0], ends[1], max_epochs))
    plan = source_plan(sources, exponent=exponent)
    plan = plan.select("_src", "weight", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens"))).otherwise(1).cast("int").alias("whole"), F.when(F.col("n_tokens") > 0, F.col("budget") % F.col("n_tokens")).otherwise(0).alias("rest"))
    order = Window.partitionBy("_src").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    budget = per_block.join(plan, "_src").withColumn("before", F.coalesce(F.sum("block_tokens").over(order), F.lit(0)))
    budget = budget.withColumn("left", F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("block_tokens")))
    d = d.join(budget.select("_src", "block", "weight", "whole", "left", "block_tokens"), ["_src", "block"])
    cut = (F.col("left") > 0) & (F.col("left") < F.col("block_tokens"))
    # Only rows of a source's one cut block take part in the running sum; the others carry distinct salts.
    salt = F.when(cut, F.lit(-1).cast("long")).otherwise(F.col("_h"))
    within = Window.partitionBy("_src", "block", salt).orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    extra = F.when(F.col("left") <= 0, False).when(~cut, True).otherwise(F.sum("n_tokens").over(within) <= F.col("left"))
    d = d.withColumn("_times", F.col("whole") + F.when(extra, 1).otherwise(0))
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    low = F.lit((1 << 32) - 1)
    block_place = F.xxhash64(F.lit(seed + 2), "epoch", "block").bitwiseAND(F.bitwise_not(low))
    d = d.withColumn("order_key", block_place.bitwiseOR(F.xxhash64(F.lit(seed + 3), "epoch", "_h").bitwiseAND(low)))
    return d.select(*back, "n_tokens", "weight", "epoch", "block", "order_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).drop("text")
