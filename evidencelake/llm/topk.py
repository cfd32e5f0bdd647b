"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (norm) into buckets whose lengths differ by a few percent, and large buckets into
parts of bounded size.  A first pass over the parts with the longest vectors gives every query a lower bound on its
k-th score.  In a bucket with greatest length m, a query of length l needs a cosine of at least bound / (l m): over 1,
the bucket is left out; near 1, candidates are pruned by coordinates, as a high cosine confines each coordinate to a
band around the query's; else by length, as a candidate shorter than bound / l can't reach the bound.  What is left is
scored with exact integer products.

Equal vectors are one class that carries its k + 1 smallest ids, which is all that any answer can use of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import class_key, finite

SCALE, K = 256, 5
#: Ratio of the lengths in a bucket, rows of a part, queries of a block.
RATIO, PART, BLOCK = 1.05, 4096, 1024
#: Local cosine threshold from which coordinates prune, and how many of the query's largest ones are looked at.
HIGH, FOCUS = 0.8, 4
#: Parts, of the longest vectors, that give the first bounds.
SEED_PARTS = 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def survivors(part: np.ndarray, length: np.ndarray, query: np.ndarray, query_length: float, bound: float) -> np.ndarray | None:
    """Rows of a part (by falling length) that can reach ``bound`` with the query; None for all of them."""
    if bound <= 0 or query_length == 0 or not len(part):
        return None if bound <= 0 else np.empty(0, np.int64)
    local = bound / (query_length * length[0]) if length[0] else np.inf
    if local > 1 + 1e-9:
        return np.empty(0, np.int64)  # the whole part is too short
    long_enough = int(np.searchsorted(-length, -(bound / query_length) * (1 - 1e-9), side="right"))
    if local < HIGH:
        return np.arange(long_enough)
    focus = np.argsort(-np.abs(query))[:FOCUS]
    q = query[focus] / query_length
    half = np.sqrt(np.maximum(0.0, (1 - q * q) * (1 - min(1.0, local) ** 2)))
    x = part[:long_enough, focus] / np.maximum(length[:long_enough, None], 1e-300)
    # a unit vector with cosine >= local has each coordinate within this band, open where the query's own pole is inside
    low = np.where(-q >= local, -1.0, q * local - half) - 1e-9
    high = np.where(q >= local, 1.0, q * local + half) + 1e-9
    return np.flatnonzero(((x >= low) & (x <= high)).all(axis=1))


def best(part: np.ndarray, least: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of a part with the k largest products not below its bound, ties to the row of ``least`` id, and those products.

    Products are exact: as doubles where no sum can leave 2^53, else as Python integers.
    """
    length = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1))
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    safe = float(np.abs(part.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * part.shape[1] < 2**53
    exact = np.float64 if safe else object
    rows, asked = part.astype(exact), queries.astype(exact)
    wide = [survivors(part, length, q, ln, float(b)) for q, ln, b in zip(queries, lengths, bounds, strict=True)]
    whole = [i for i, w in enumerate(wide) if w is None or len(w) * 2 > len(part)]
    products = dict(zip(whole, (asked[whole] @ rows.T) if whole else [], strict=True))  # few were pruned: one block product
    out = []
    for i, w in enumerate(wide):
        if i in products:
            at, score = np.arange(len(part)), products[i]
        else:
            at, score = w, rows[w] @ asked[i]
        ok = score >= bounds[i]
        at, score = at[ok], score[ok]
        if len(score) > k:
            edge = np.sort(score)[-k]
            ok = score >= edge
            at, score = at[ok], score[ok]
            first = np.lexsort((least[at], -score))[:k] if safe else sorted(range(len(at)), key=lambda j: (-score[j], least[at[j]]))[:k]
            at, score = at[first], score[first]
        out.append((at, score))
    return out


def top_products(
    vectors: DataFrame, is_query: Column, *, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the k other rows of largest product.

    Ties go to the smaller vec_id; fewer than k are given where there are no more.  "Other" leaves out the query's own
    row only: rows that repeat its vec_id are rows like any other, and each repeated query row has answers of its own.
    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with null vec_id; only
    vectors of equal length are compared.  Zero and negative scores count like any other.  Components and scores beyond
    the range of a long are given as its ends.  Other columns are not looked at.
    """
    kept = vectors.where(F.col(vec_id).isNotNull() & finite(F.col(vector)))
    rows = kept.select(F.col(vec_id).alias("vec_id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(rows.withColumn("ck", class_key(F.col("v"))).withColumn("dim", F.size("v")))
    rank = F.row_number().over(Window.partitionBy("ck").orderBy("vec_id"))
    ids = rows.select("ck", "vec_id").withColumn("r", rank).where(F.col("r") <= k + 1)
    few = ids.groupBy("ck").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = rows.groupBy("ck", "dim").agg(F.any_value("v").alias("v")).join(few, "ck").withColumn("least", F.element_at("ids", 1))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    bucket = F.when(square > 0, F.floor(F.log(square) / (2 * float(np.log(RATIO))))).otherwise(-1).cast("int")
    placed = cut(classes.withColumn("square", square).withColumn("bucket", bucket))
    counts = placed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    placed = placed.join(counts, ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("ck"), F.col("parts")))
    packed = placed.groupBy("dim", "bucket", "part").agg(F.collect_list(F.struct("ck", "v", "least")).alias("m"), F.sqrt(F.max("square")).alias("longest"))
    packs = cut(packed.select("dim", "bucket", "part", "longest", F.col("m.ck").alias("cks"), F.col("m.v").alias("vs"), F.col("m.least").alias("leasts")))

    asking = rows.where("asks").select("ck", "dim", "v", F.sqrt(square).alias("length")).dropDuplicates(["ck"])
    sizes = asking.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    numbered = asking.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "ck"), F.col("blocks")))

    def blocks_of(queries: DataFrame) -> DataFrame:
        """Blocks of queries, and the length that a vector needs at least to matter to any of them."""
        need = F.when((F.col("bound") > 0) & (F.col("length") > 0), F.col("bound") / F.col("length")).otherwise(0.0)
        grouped = queries.groupBy("dim", "block").agg(F.collect_list(F.struct("ck", "v", "bound")).alias("q"), F.min(F.coalesce(need, F.lit(0.0))).alias("need"))
        return grouped.select("dim", "block", "need", F.col("q.ck").alias("qs"), F.col("q.v").alias("qvs"), F.col("q.bound").alias("bounds"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("q", pa.string()), ("ck", pa.string()), ("score", pa.int64())])
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pydict()
                part, queries = np.array(row["vs"][0], np.int64), np.array(row["qvs"][0], np.int64)
                order = np.argsort(-(part.astype(np.float64) ** 2).sum(axis=1), kind="stable")
                bounds = np.array([float("-inf") if b is None else b for b in row["bounds"][0]])
                keys, least = np.array(row["cks"][0], object)[order], np.array(row["leasts"][0], np.int64)[order]
                q, ck, score = [], [], []
                for name, (at, values) in zip(row["qs"][0], best(part[order], least, queries, bounds, k + 1), strict=True):
                    q += [name] * len(at)
                    ck += keys[at].tolist()
                    score += [max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in values]
                yield pa.RecordBatch.from_pydict({"q": q, "ck": ck, "score": score}, shape)

    def search(some: DataFrame, queries: DataFrame) -> DataFrame:
        """Every part meets every block of queries that it is long enough for: the stated query set against all rows."""
        asked = cut(blocks_of(queries))
        near = F.col("longest") >= F.col("need") * (1 - 1e-9)
        # which meet is told from their numbers; only then do the vectors join
        ids = some.select("dim", "bucket", "part", "longest").join(asked.select("dim", "block", "need"), "dim").where(near).select("dim", "bucket", "part", "block")
        work = ids.join(some, ["dim", "bucket", "part"]).join(asked.drop("need"), ["dim", "block"]).drop("longest")
        return work.repartition("bucket", "part", "block").mapInArrow(products, "q string, ck string, score long")

    # the longest vectors first: any k + 1 scores found there bound the k-th from below, the query's own class aside
    first = placed.groupBy("dim").agg(F.max("bucket").alias("bucket")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SEED_PARTS - 1))))
    seeds = packs.join(first, ["dim", "bucket", "part"], "left_semi")
    tried = search(seeds, numbered.withColumn("bound", F.lit(None).cast("double")))
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), "ck")
    kth = tried.where("q <> ck").withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k).groupBy("q").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    bound = kth.where(F.col("n") >= k).select(F.col("q").alias("ck"), F.col("low").cast("double").alias("bound"))
    found = search(packs, numbered.join(bound, "ck", "left"))
    # a row among the k + 1 best, by score and id, is of a class among the k + 1 best by score and least id
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "least")
    top = found.join(placed.select("ck", "least", "ids"), "ck").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    answers = top.select("q", "score", F.explode("ids").alias("vec_id"))
    by_rank = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    answers = answers.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k + 1)
    entry = F.struct(F.col("r"), F.col("vec_id"), F.col("score"))
    per_query = answers.groupBy("q").agg(F.array_sort(F.collect_list(entry)).alias("best"))
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("ck").alias("q"), F.monotonically_increasing_id().alias("n"))
    # the query's own row: the first of its id with the score of its own class
    own = found.where("q = ck").select("q", F.col("score").alias("own")).distinct()
    mine = lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == F.col("own"))
    met = asked.join(per_query, "q").join(own, "q", "left")
    at = F.coalesce(F.get(F.filter("best", mine), F.lit(0))["r"], F.lit(0))
    chosen = met.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["r"] != at), 1, k)).alias("at", "b"))
    return chosen.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
