"""Mixing sources to target weights: subset-sum budget fitting.

Each source gets a word target.  Whole passes over the source are taken first; what the target still lacks is fitted
as a subset sum.  Documents are counted by exact length, a proportional share of every length is taken, and a bounded
knapsack over the counts that are left hits the remaining budget exactly where any choice can.  Which documents stand
for a length's count is a seeded choice.

Only (source, length, count) histograms reach the fitting step, one source per group; documents never do.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, key_of

#: Documents of one source and length are dealt over so many seeded buckets, so that no such group is one task.
BUCKETS = 256
#: The knapsack closes the last words of a budget, at most this many.
WINDOW = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def close_gap(length: np.ndarray, spare: np.ndarray, lack: int) -> np.ndarray:
    """How many of the ``spare`` documents of each length bring the sum as near ``lack`` as any choice of them can.

    A bounded knapsack: the reachable sums are the bits of an integer, widened length by length by its count in powers
    of two, in a fixed shuffled order, until the lack itself is reached.  What a length adds nothing to is not kept.
    """
    extra = np.zeros(len(length), dtype=np.int64)
    usable = np.flatnonzero((spare > 0) & (length > 0))
    if lack <= 0 or not len(usable):
        return extra
    most = lack + int(min(length[usable].min(), lack))  # a sum above the lack may be nearer
    cells = (1 << (most + 1)) - 1
    reach, steps = 1, []
    for i in np.random.Generator(np.random.PCG64(len(usable))).permutation(usable).tolist():
        size = int(length[i])
        if size > most or reach >> lack & 1:
            continue
        wider, left, piece = reach, int(min(spare[i], most // size)), 1
        while left > 0:
            part = min(piece, left)
            wider |= (wider << (part * size)) & cells
            left, piece = left - part, piece * 2
        if wider != reach:
            steps.append((i, reach))
            reach = wider
    at = next(s for d in range(most + 1) for s in (lack - d, lack + d) if 0 <= s <= most and reach >> s & 1)
    for i, before in reversed(steps):
        while not before >> at & 1:
            at -= int(length[i])
            extra[i] += 1
    return extra


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that the taken words come as near ``budget`` as can be.

    Takes the budget's share of every length's count, rounded down, then one more of the lengths with the largest
    fractions until only a few of the longest documents lack, and fits the rest by a bounded knapsack over what is left.
    Where that misses the budget, documents of each length are given back and fitted again, up to ``window`` words.
    """
    length, count = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int((length * count).sum())
    if not len(length) or budget <= 0 or total == 0:
        return np.zeros(len(length), dtype=np.int64)
    if budget >= total:
        return count.copy()
    exact = count * (budget / total)
    start = np.minimum(np.floor(exact).astype(np.int64), count)
    room = min(window, 4 * int(length.max()))
    lack = budget - int((start * length).sum())
    for i in np.lexsort((length, -(exact - start))):
        if lack <= room:
            break
        if start[i] < count[i] and length[i] <= lack:
            start[i] += 1
            lack -= int(length[i])
    best, missed, give = start, abs(lack), 0
    while True:
        base = np.maximum(start - give, 0)
        lack = budget - int((base * length).sum())
        if give and lack > window:
            break
        take = base + close_gap(length, count - base, lack)
        if (off := abs(budget - int((take * length).sum()))) < missed or not give:
            best, missed = take, off
        if not missed or not base.any():
            break
        give = 2 * give or 1
    return best


def in_order(sources: DataFrame) -> DataFrame:
    """Add ``place``, from 0, of each row by ``source``, null last: places within ranges, after the rows of the ranges before."""
    by_source = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sources.repartitionByRange(*by_source).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = sizes.select("range", F.coalesce(earlier, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*by_source))
    return ranged.withColumn("within", within).join(starts, "range").withColumn("place", F.col("start") + F.col("within") - 1)


def source_targets(totals: DataFrame, share: float, most: float) -> DataFrame:
    """Add ``target`` to (skey, source_size, weight): ``share`` of all sizes by weight, none above ``most`` sizes.

    A source that its part of the budget would carry past its limit stops there and the excess is shared again.
    One row per source; the driver sees two sums a round.
    """
    totals = cut(totals)
    cap = F.lit(float(most)) * F.col("source_size")
    row = totals.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = float(share) * float(row["size"] or 0)
    level = budget / row["weight"] if row["weight"] else 0.0
    known = -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        got = totals.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("capped"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count_if(over).alias("n"),
        ).first()
        if not got["n"] or got["n"] == known or not got["free"]:
            break
        known, level = got["n"], (budget - got["capped"]) / got["free"]
    return totals.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")).cast("double"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, and ``carry``) for every row of ``docs``.

    ``weights`` are dealt to the sources in code point order, null last, and repeat.  ``taken`` is a whole multiple
    of ``size``: whole passes, plus one for documents that the fitted subset holds.  Null or empty texts have size 0
    and take 0; an empty table gives an empty result; equal rows are separate documents; a null doc_id is an id like
    any other.  Columns named in ``carry`` pass through and order the rows of one doc_id; others are not looked at.
    """
    base = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            key_of(source).alias("skey"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), key_of(doc_id)).alias("order"),
            *carry,
        ).withColumn("bucket", F.shiftrightunsigned("order", 56).cast("int"))
    )
    hist = cut(base.groupBy("source", "skey", "size", "bucket").agg(F.count("*").alias("n")))
    by_size = hist.groupBy("source", "skey", "size").agg(F.sum("n").alias("n"))
    totals = by_size.groupBy("source", "skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    targets = source_targets(in_order(totals).select("skey", "source_size", dealt.alias("weight")), share, most)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        """One source's lengths (a row per length): whole passes, and the number taken once more of each length."""
        part = part.sort_values("size")  # rows come in any order, and the fit must not depend on it
        whole, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        passes = int(target // whole) if whole else 0
        extra = fit_counts(part["size"], part["n"], round(target - passes * whole))
        return part[["skey", "size", "source_size", "target"]].assign(passes=passes, extra=extra)

    fitted = (
        by_size.join(targets, "skey")
        .groupBy("skey")
        .applyInPandas(fit, "skey string, size long, source_size long, target double, passes long, extra long")
    )
    earlier = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        hist.select("skey", "size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        .join(fitted, ["skey", "size"])
        .select("skey", "size", "bucket", "source_size", "target", "passes", (F.col("extra") - F.col("before")).alias("room"))
    )
    rank = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("order", "doc_id", *carry))
    return (
        base.join(plan, ["skey", "size", "bucket"])
        .withColumn("once", F.when(rank <= F.col("room"), 1).otherwise(0))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("size") * (F.col("passes") + F.col("once"))).cast("long").alias("taken"),
            *carry,
        )
    )
