"""Mixing of sources to target shares of the total size, with a cap on how often a record is used.

Temperature mixing: the weight of a source is its share of all tokens, raised to an exponent. One exponent can't meet
the targets of many sources, so each source has its own: it is bisected until the weight is the target, or what the
repetition limit allows where that is less. What capped and missing sources leave of the budget (in tokens, by default one pass over
the sources that have a target) is spread over the others under one common exponent, bisected until those others have the entropy
of their targets, as far as their limits allow. The normalised weights are realised as block permutations with
a budget: a source is passed as often as its weight asks, every pass being a permutation of its own; the last one ends where the
budget does. Laid out in order (``order``), the mix is a row of blocks of equal size, in each of which every source has its weight.

No source, however large, goes through one task: sums go by buckets of a hash, and only the bucket in which a pass ends
is looked at record by record.

Defined results: records of sources without a target (and of a null source) are not used; targets of sources without
records are reported with a share of 0; null and empty texts have 0 tokens and are not used; repeated texts under other
keys are records of their own; rows of the same key and source count once; empty tables give an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


@dataclass
class Source:
    """A target and what there is to meet it; ``budget`` is what the plan gives."""

    name: str
    target: float
    max_repeats: int
    tokens: int = 0
    documents: int = 0
    budget: float = 0.0
    exponent: float | None = None
    state: str = "met"

    @property
    def cap(self) -> float:
        return float(self.tokens * self.max_repeats)


def entropy(shares: list[float]) -> float:
    total = sum(shares) or 1.0
    return -sum(s / total * math.log(s / total) for s in shares if s > 0)


def spread(amount: float, room: list[float], weights: list[float]) -> list[float]:
    """``amount`` in proportion to weights, none above its room; what one can't take goes to the others."""
    out = [0.0] * len(room)
    while amount > 1e-9:
        open_ = [i for i, r in enumerate(room) if weights[i] > 0 and r - out[i] > 1e-9]
        if not open_:
            break
        total, left = sum(weights[i] for i in open_), 0.0
        for i in open_:
            part = amount * weights[i] / total
            taken = min(part, room[i] - out[i])
            out[i] += taken
            left += part - taken
        amount = left
    return out


def temperature(amount: float, given: list[float], tokens: list[float], room: list[float], aim: float) -> tuple[float, list[float]]:
    """(exponent, what each source gets of ``amount``): token shares to that power, so that given + got has the entropy ``aim``."""
    total = sum(tokens) or 1.0

    def at(exponent: float) -> tuple[float, list[float]]:
        got = spread(amount, room, [(t / total) ** exponent if t > 0 else 0.0 for t in tokens])
        return entropy([g + x for g, x in zip(given, got)]), got

    low, high = -1.0, 2.0  # a smaller exponent favours small sources and raises the entropy
    for _ in range(60):
        middle = (low + high) / 2
        if at(middle)[0] > aim:
            low = middle
        else:
            high = middle
    return high, at(high)[1]


def exponent_for(share: float, weight: float) -> float | None:
    """The exponent that turns a share of tokens into that weight, by bisection; null where none does (a share or weight of 0, or a share of 1)."""
    if not 0 < share < 1 or weight <= 0:
        return None
    low, high = -64.0, 64.0  # a smaller exponent gives more weight
    for _ in range(80):
        middle = (low + high) / 2
        if share**middle > weight:
            low = middle
        else:
            high = middle
    return high


def plan(sources: list[Source], budget: float | None = None) -> tuple[float, float]:
    """Set the exponents and budgets of the sources. Returns (total budget, the common exponent of what is spread)."""
    everything = float(sum(s.tokens for s in sources))
    total = everything if budget is None else float(budget)
    for s in sources:
        wanted, share = s.target * total, s.tokens / everything if everything else 0.0
        s.state = "no documents" if not s.tokens else "met" if wanted <= s.cap else "capped"
        s.exponent = exponent_for(share, min(wanted, s.cap) / total if total else 0.0)
        s.budget = share**s.exponent * total if s.exponent is not None else min(wanted, s.cap)
    missing = total - sum(s.budget for s in sources)
    if missing <= 0:
        return total, 1.0
    free = [s for s in sources if s.state == "met"]
    # The open sources are to stay as diverse among themselves as their targets are.
    aim = entropy([s.target for s in free])
    exponent, got = temperature(missing, [s.budget for s in free], [float(s.tokens) for s in free], [s.cap - s.budget for s in free], aim)
    for s, x in zip(free, got):
        s.budget += x
    return total, exponent


def read_sources(records: DataFrame, source: str, tokens: str, targets: DataFrame) -> list[Source]:
    """Targets and what there is for each: as many rows as the table of targets has, which is configuration."""
    sums = records.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("documents"))
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = wanted.join(sums, "source", "left").collect()
    return [Source(r["source"], r["share"] or 0.0, r["repeats"] or 0, r["tokens"] or 0, r["documents"] or 0) for r in sorted(rows, key=lambda r: r["source"])]


def _bucket(place):
    return F.shiftrightunsigned(place, 64 - int(math.log2(BUCKETS))).cast("int")


def mix(records: DataFrame, key: str, source: str, tokens: str, sources: list[Source], seed: int = 11) -> DataFrame:
    """(key, source, tokens, copies): how often each record is used. The last pass takes records in the order of its own permutation."""
    spark = records.sparkSession
    rows = [(s.name, int(s.budget // s.tokens) if s.tokens else 0, int(round(s.budget % s.tokens)) if s.tokens else 0, s.max_repeats) for s in sources]
    wanted = F.broadcast(spark.createDataFrame(rows, "source string, passes int, rest long, most int"))  # one row a target
    r = records.where(F.col(tokens) > 0).select(F.col(key), F.col(source).alias("source"), F.col(tokens).alias("tokens")).dropDuplicates([key, "source"])
    r = r.join(wanted, "source").withColumn("place", _place(seed, "passes", key))
    r = r.withColumn("bucket", _bucket("place"))
    # The running sum over buckets needs BUCKETS numbers a source.
    order = Window.partitionBy("source").orderBy("bucket")
    ends = r.groupBy("source", "bucket").agg(F.sum("tokens").alias("here")).withColumn("upto", F.sum("here").over(order))
    last = ends.join(wanted, "source").where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("here") <= F.col("rest"))).select("source", F.col("bucket").alias("last"), (F.col("upto") - F.col("here")).alias("before"))
    r = r.join(F.broadcast(last), "source", "left")  # one row a target
    within = Window.partitionBy("source").orderBy("place", key)
    final = r.where(F.col("bucket") == F.col("last")).withColumn("run", F.col("before") + F.sum("tokens").over(within))
    # A record is in if at least half of it is within the budget, so that passes end as near to it as records allow.
    final = final.withColumn("extra", (F.col("run") - F.col("tokens") / 2 <= F.col("rest")).cast("int")).drop("run")
    others = r.where(F.col("last").isNull() | (F.col("bucket") != F.col("last"))).withColumn("extra", (F.col("last").isNull() | (F.col("bucket") < F.col("last"))).cast("int"))
    others = others.withColumn("extra", F.when(F.col("rest") == 0, 0).otherwise(F.col("extra")))
    return others.unionByName(final).select(key, "source", "tokens", F.least(F.col("passes") + F.col("extra"), "most").cast("int").alias("copies")).where("copies > 0")


def _place(seed: int, turn: str, key: str):
    """Place of a record in the permutation of one pass."""
    return F.xxhash64(F.lit(seed), F.col(turn).cast("int"), F.col(key))


def order(mixed: DataFrame, key: str, block: int = 1_000_000, seed: int = 11) -> DataFrame:
    """(block, place, key, source, pass, tokens): the mix laid out. Sorted by block and place it is what a reader sees.

    A block holds ``block`` tokens, of which each source has its share of the whole mix, as near as records allow; within
    it records of all sources are permuted. The passes of a source follow each other, each in an order of its own.
    """
    shares = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    total = F.sum("used").over(Window.partitionBy())  # one row a target
    per_block = F.broadcast(shares.select("source", (F.col("used") / total * F.lit(float(block))).alias("room")))
    copies = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("at", _place(seed, "pass", key))
    copies = copies.withColumn("bucket", _bucket("at"))
    # Sums by source, pass and bucket: a running sum over them needs BUCKETS numbers a pass.
    ends = copies.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("here"))
    ends = ends.withColumn("before", F.sum("here").over(Window.partitionBy("source").orderBy("pass", "bucket")) - F.col("here")).drop("here")
    within = Window.partitionBy("source", "pass", "bucket").orderBy("at", key)
    begins = copies.join(ends, ["source", "pass", "bucket"]).withColumn("begin", F.col("before") + F.sum("tokens").over(within) - F.col("tokens"))
    placed = begins.join(per_block, "source").withColumn("block", F.floor(F.col("begin") / F.col("room")).cast("long"))
    return placed.select("block", F.xxhash64(F.lit(seed), F.col("block"), F.col("pass"), F.col(key)).alias("place"), key, "source", "pass", "tokens")


def report(mixed: DataFrame, sources: list[Source]) -> DataFrame:
    """A row a target: what was asked, what there is, what the mix holds."""
    spark = mixed.sparkSession
    asked = spark.createDataFrame([(s.name, s.target, s.max_repeats, s.documents, s.tokens, None if s.exponent is None else round(s.exponent, 6), s.state) for s in sources], "source string, target_share double, max_repeats int, documents long, tokens long, exponent double, state string")
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies"))
    joined = F.broadcast(asked).join(used, "source", "left").fillna(0, ["used_tokens", "used_documents", "most_copies"])
    everything = Window.partitionBy()
    return joined.withColumn("actual_share", F.round(F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(everything)), F.lit(0.0)), 6))
