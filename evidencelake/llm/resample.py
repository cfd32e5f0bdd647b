"""Importance resampling towards a target distribution.

Runs of words are hashed into buckets.  What a bucket gains, from its share among the target texts and among all
documents, is one array, and a document's weight is its features' mean gain.  Weights with a draw of their own make
scores, of which the highest are taken.

The cutoff is found without sorting all scores: a quantile sketch gives a bracket around it, exact counts above and in
the bracket validate it or widen it, and only the bracket is sorted.  What is drawn gets its rank from ranges of scores
that are numbered on their own and put one after the other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BUCKETS, RUNS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Share of the rows on either side of the expected cutoff that the first bracket takes, and the sketch's accuracy.
WIDTH, ACCURACY = 0.01, 10_000
#: A-Z in lower case; other bytes under 128 that are no digit or letter end a word.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: str | None, runs: int, buckets: int) -> tuple[int, np.ndarray]:
    """The words of a text (null: none), and the bucket of each run of 1 to ``runs`` of them.

    A run's checksum goes on from that of the run without its last word.
    """
    words = text.encode().translate(LOWERED).split() if text else []
    sums = list(map(zlib.crc32, words))
    found, more = sums, [b" " + w for w in words]
    for n in range(1, runs):
        sums = list(map(zlib.crc32, more[n:], sums))
        found = found + sums
    return len(words), np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str, *, runs: int, buckets: int) -> list[int]:
    """How many features of all texts each bucket has.  A task gives a row for each bucket; the driver sees ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch["text"]:
                total += np.bincount(features(value.as_py(), runs, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some])})

    counted = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share among target features over that among source features."""
    size, wanted = float(sum(source) + len(source)), float(sum(target) + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * size / ((s + 1) * wanted))) for s, t in zip(source, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, runs: int, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight`` long: the floored mean gain of a text's features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    shape = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words, count, weight = [], [], []
            for value in batch:
                n, at = features(value.as_py(), runs, len(shared.value))
                words.append(n)
                count.append(len(at))
                weight.append(int(shared.value[at].sum()) // len(at) if len(at) else 0)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, count, weight)], fields=list(shape))

    made = docs.drop("n_words", "n_features", "weight").withColumn("__w", scores.asNondeterministic()(F.col(text)))
    return made.select("*", "__w.n_words", "__w.n_features", "__w.weight").drop("__w")


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel draw for an id, in thousandths: floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256("seed:id")."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``place``, from 1, in the order given: ranges of it are sorted and numbered on their own, then put one after the other."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    here = stage(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    here = here.withColumn("__part", part).withColumn("__at", at)
    sizes = here.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return here.join(F.broadcast(starts), "__part").withColumn("place", F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def bracket(rows: DataFrame, score: str, total: int, taken: int) -> tuple[int, int, int]:
    """(low, high, above): scores that the last of the ``taken`` highest of ``total`` lies between, both included, and how many are above."""
    width, at = WIDTH, 1 - taken / total
    while True:
        ends = F.percentile_approx(score, F.array(F.lit(max(0.0, at - width)), F.lit(min(1.0, at + width))), ACCURACY)
        whole = F.array(F.min(score), F.max(score))
        low, high = rows.agg((whole if width >= 1 else ends).alias("e")).first()["e"]
        seen = rows.agg(F.count_if(F.col(score) > high).alias("above"), F.count_if(F.col(score).between(low, high)).alias("inside")).first()
        if seen["above"] < taken <= seen["above"] + seen["inside"]:
            return low, high, seen["above"]
        width *= 4


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    runs: int = RUNS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank long) for each row of ``docs``; rank is null for what isn't drawn.

    floor(percent / 100) of the rows of ``least_words`` words or more are drawn: those of the highest scores, ties to the
    smaller doc_id, null first; rows that agree in both are drawn in an order that follows from where they are read.
    Null and empty texts have no features and weight 0 and are never drawn while ``least_words`` is over 0.  A null
    doc_id draws as the empty text.  Repeated rows are documents of their own.  Very long texts are read whole.  An empty
    table gives none; an empty target counts as one without features.  Other columns are not looked at.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = [bucket_counts(t, c, runs=runs, buckets=buckets) for t, c in ((named, "text"), (target, target_text))]
    made = weighed(named, gains(*counts), runs=runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = stage(made.select("doc_id", "n_words", "n_features", "weight", "score", F.monotonically_increasing_id().alias("row")))
    fit = F.col("n_words") >= least_words
    total = rows.where(fit).count()
    taken = total * percent // 100
    out = ("doc_id", "n_features", "weight", "score")
    if not taken:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(rows.where(fit), "score", total, taken)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc())
    place = F.col("place").cast("long")
    sure = numbered(rows.where(fit & (F.col("score") > high)), *order).select(*out, place.alias("rank"))
    within = numbered(rows.where(fit & F.col("score").between(low, high)), *order).withColumn("rank", F.lit(above) + place)
    edge = within.select(*out, F.when(F.col("rank") <= taken, F.col("rank")).alias("rank"))
    rest = rows.where(~fit | (F.col("score") < low)).select(*out, F.lit(None).cast("long").alias("rank"))
    return sure.union(edge).union(rest)
