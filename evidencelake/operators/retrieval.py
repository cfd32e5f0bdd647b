"""Scoring and ranking: BM25, dense products in blocks, fusion, candidate unions and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored
from . import blocks as B

DIGITS = 9  # scores that agree to so many places tie, and the id decides


def ranked(scores: DataFrame, k: int, *, score: str = "score", query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their 1-based rank; ties to the smaller item."""
    order = Window.partitionBy(query).orderBy(F.round(score, DIGITS).desc(), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hash_vectors(docs: DataFrame, dim: int = 384) -> DataFrame:
    """(doc_id, slot, value): signed sums of hashed features at length one; texts whose features cancel or that have none give no row."""
    features = docs.select("doc_id", F.explode(T.hashed_features(F.col("text"))).alias("f"))
    slot, sign = T.slot_and_sign(F.col("f"), dim)
    sums = features.select("doc_id", slot.alias("slot"), sign.alias("sign")).groupBy("doc_id", "slot").agg(F.sum("sign").alias("v")).where("v <> 0")
    norms = sums.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("norm"))
    return sums.join(norms, "doc_id").select("doc_id", "slot", (F.col("v") / F.col("norm")).alias("value"))


def dense_topk(queries: DataFrame, items: DataFrame, k: int, *, eligible: DataFrame | B.Every = B.EVERY, block: int = B.BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): exact inner products in doubles, a query's own id left out.

    queries(query_id, v), items(vec_id, v), v array<double>; ids of any type; ``eligible`` as in blocks.block_pairs().
    Vectors that are null, hold null or non-finite components or have another length than the queries' longest take no
    part.  Blocks of queries meet blocks of items in one matrix product, of which k rows a query leave the task.
    """
    dim = queries.agg(F.max(F.size("v"))).first()[0] or 0
    whole = F.coalesce((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))

    def kernel(row: dict) -> dict:
        return B.ranked_block(row, row["qb_v"] @ row["ib_v"].T, k, DIGITS)

    pairs = B.block_pairs(queries.where(whole), items.where(whole), ["v"], ["v"], size=block, eligible=eligible)
    met = B.blockwise(pairs, kernel, f"query_id {B.kind(queries, 'query_id')}, vec_id {B.kind(items, 'vec_id')}, score double")
    return ranked(met, k, item="vec_id")


def zscore(value: Column, *by: str, eps: float = 0.0) -> Column:
    """Population z-score within groups; 0 where the group has no variance."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > eps, (value - F.avg(value).over(w)) / sd).otherwise(F.lit(0.0))


def grouped_zscore(rows: DataFrame, value: str, by: str) -> DataFrame:
    """zscore() by partial aggregates and a join: no group's rows are gathered, so a hot group is no hot task."""
    stats = rows.groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = F.when(F.col("__s") > 1e-12, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(F.lit(0.0))
    return rows.join(stats, by).withColumn("z", z).drop("__m", "__s")


def fuse(scores: DataFrame, semantic: str, lexical: str, weight: float = 0.75) -> DataFrame:
    """Add z_semantic, z_lexical and their weighted sum ``fused``, by query: statistics by partial aggregates, no query's rows are gathered."""
    stats = scores.groupBy("query_id").agg(*[f(c).alias(f"__{k}_{c}") for c in (semantic, lexical) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"__s_{c}") > 1e-12, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.lit(0.0))
    out = scores.join(stats, "query_id").withColumn("z_semantic", z(semantic)).withColumn("z_lexical", z(lexical))
    return out.withColumn("fused", weight * F.col("z_semantic") + (1 - weight) * F.col("z_lexical")).drop(*[f"__{k}_{c}" for c in (semantic, lexical) for k in "ms"])


def rank_of(score: str) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(score, DIGITS).desc(), "doc_id")) - 1


def candidate_features(candidates: DataFrame) -> DataFrame:
    """Six features of lexical.candidates(): both scores as they are and as z-scores, the fused one, and reciprocal ranks."""
    ranks = [F.col(f"r_{n}").alias(f"r_{k}") for n, k in (("jaccard", "sem"), ("bm25", "lex"), ("fused", "fused"))]
    return candidates.select("query_id", "doc_id", "bm25", F.col("jaccard").alias("f1"), F.col("z_semantic").alias("f2"), F.col("fused").alias("f3"), F.col("z_lexical").alias("f4"), (1.0 / (1 + F.col("r_jaccard"))).alias("f5"), (1.0 / (1 + F.col("r_bm25"))).alias("f6"), *ranks)


def containment(items: DataFrame, docs: DataFrame, *, width: int = 4, short_items: int = 1000) -> DataFrame:
    """(query_id, doc_id) where the document contains the item's text verbatim.

    The item's tokens 2 to width + 1 are an anchor that every such document has in a row; documents are joined on
    hashed anchors and the text is then compared.  Items with too few tokens are compared with every document, in
    broadcast batches of ``short_items``.
    """
    runs = F.arrays_zip(*[F.slice("t", F.lit(i + 1), F.size("t")) for i in range(width)])
    anchored = items.select("query_id", F.col("text").alias("item"), T.tokens(F.col("text")).alias("t")).withColumn("long", F.size("t") > width + 1)
    keys = anchored.where("long").select("query_id", "item", F.xxhash64(*[F.get("t", F.lit(i + 1)) for i in range(width)]).alias("gram"))
    listed = docs.select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") >= width)
    spread = listed.select("doc_id", F.explode(runs).alias("r")).select("doc_id", F.xxhash64(*[f"r.{i}" for i in range(width)]).alias("gram"))
    pairs = spread.join(keys, "gram").select("query_id", "doc_id", "item").distinct()
    found = pairs.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("query_id", "doc_id")
    short = stored(anchored.where(~F.col("long")).select("query_id", "item", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)).alias("b")))
    batches = -(-short.count() // short_items)
    for n in range(batches):
        some = short.where(F.col("b") % batches == n).select("query_id", "item")
        found = found.union(docs.join(F.broadcast(some), F.contains(docs["text"], some["item"])).select("query_id", "doc_id"))
    return found
