"""A stored index of int8 codes with bounds for whole blocks: what can't reach a query's k-th score never meets it.

Vectors go to the nearest of a bounded number of centres and are written in blocks of bounded size, with their codes, the
scale and the residual length of each.  Beside them stands a directory of the blocks: the mean of each, how far its
farthest vector is from it, and how many it has.  By these a query's product with any vector of a block is bounded from
above.  The blocks of the highest bounds give each query a k-th lower bound; then only blocks whose bound reaches it meet
the query, and of these only vectors whose own upper bound reaches it are told, to be scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import blocks as B

#: Rows of a block, about; centres, at most, and numbers in them, at most: 32 MB.
BLOCK, CENTRES, NUMBERS = 1024, 4096, 1 << 22
#: Queries that meet a block in one task, about.
TOGETHER = 1024
SLACK = 1e-9


@dataclass(frozen=True)
class ResidualIndex:
    """blocks(block, centre, radius, n, ids, z, scale, gap): a row for each block, z its codes one after the other."""

    blocks: DataFrame
    dim: int
    kind: str

    @property
    def directory(self) -> DataFrame:
        return self.blocks.select(F.col("block").alias("vec_id"), "centre", "radius", F.col("n").cast("double").alias("n"))


def valid(dim: int):
    return F.coalesce((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def build(items: DataFrame, *, size: int = BLOCK, most_centres: int = CENTRES) -> ResidualIndex:
    """The index of items(vec_id, v array<double>), written once.

    The centres are rows of the smallest hashes, a bounded sample; every row is indexed.  Vectors that are null, hold
    null or non-finite components or aren't of the longest one's length take no part.
    """
    dim = items.agg(F.max(F.size("v"))).first()[0] or 0
    rows = items.where(valid(dim)).select("vec_id", "v")
    most = max(1, min(most_centres, NUMBERS // max(dim, 1), -(-rows.count() // size)))
    sample = rows.orderBy(F.xxhash64("v")).limit(most).collect()
    centres = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), dim)
    square = (centres**2).sum(axis=1)
    kind = B.kind(rows, "vec_id")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            near = np.concatenate([(square - 2 * x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(near.astype(np.int64))], names=["vec_id", "v", "centre"])

    near = stored(rows.mapInArrow(placed, f"vec_id {kind}, v array<double>, centre long"))
    parts = near.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(size)).alias("parts"))  # a row for each centre
    # rows are dealt by where they stand, as equal vectors may be a large share of all
    dealt = near.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(parts), "centre")
    dealt = dealt.withColumn("block", F.shiftleft("centre", 32) + F.pmod(F.xxhash64("at"), F.col("parts"))).select("block", "vec_id", "v")

    def packed(part: pa.Table) -> pa.Table:
        x = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
        centre = x.mean(axis=0)
        scale = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
        z = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
        gap = np.sqrt(((x - z * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-12)
        ids = pa.array([part["vec_id"].to_pylist()], pa.list_(part["vec_id"].type))
        lists = [pa.array([v], pa.list_(pa.float64())) for v in (scale, gap)]
        return pa.table([part["block"].slice(0, 1).combine_chunks(), pa.array([centre], pa.list_(pa.float64())), pa.array([radius]), pa.array([len(x)], pa.int32()), ids, pa.array([z.tobytes()], pa.binary()), *lists], names=["block", "centre", "radius", "n", "ids", "z", "scale", "gap"])

    shape = f"block long, centre array<double>, radius double, n int, ids array<{kind}>, z binary, scale array<double>, gap array<double>"
    return ResidualIndex(stored(dealt.groupBy("block").applyInArrow(packed, shape)), dim, kind)


def _most(row: dict) -> np.ndarray:
    """The upper bound of each query's products with each block."""
    return row["qb_v"] @ row["ib_centre"].T + row["qb_length"][:, None] * row["ib_radius"][None, :] + 1e-10


def floors(bounds: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the k-th largest lower bound of each query that has so many."""
    from .retrieval import ranked

    low = ranked(bounds.select("query_id", "vec_id", (F.col("mid") - F.col("slack")).alias("score")), k, item="vec_id")
    return low.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")


def meetings(queries: DataFrame, index: ResidualIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """(asks, pairs): the queries with their lengths, and pairs(query_id, block, floor) of what must meet."""
    length = F.sqrt(B.dot("v", "v"))
    asks = stored(queries.where(valid(index.dim)).select("query_id", "v", length.alias("length")))
    kind = B.kind(asks, "query_id")
    pairs = B.block_pairs(asks, index.directory, ["v", "length"], ["centre", "radius", "n"])

    def first(row: dict) -> dict:
        most, out = _most(row), ([], [], [], [])
        order = np.argsort(-most, axis=1, kind="stable")
        have = np.cumsum(row["ib_n"][order], axis=1) - row["ib_n"][order]
        for i, j in zip(*np.nonzero(have < k + 1)):
            at = order[i, j]
            for c, v in zip(out, (row["qb_ids"][i], row["ib_ids"][at], most[i, at], row["ib_n"][at]), strict=True):
                c.append(v)
        return dict(zip(("query_id", "block", "most", "n"), out, strict=True))

    tops = B.blockwise(pairs, first, f"query_id {kind}, block long, most double, n double")
    before = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = tops.withColumn("have", F.coalesce(F.sum("n").over(before), F.lit(0.0))).where(F.col("have") < k + 1)
    tried = scored(asks, seeds.select("query_id", "block", F.lit(float("-inf")).alias("floor")), index, k)
    known = stored(asks.join(floors(tried, k), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))

    def open_(row: dict) -> dict:
        i, j = np.nonzero(_most(row) >= row["qb_floor"][:, None] - SLACK)
        return {"query_id": [row["qb_ids"][n] for n in i.tolist()], "block": [row["ib_ids"][n] for n in j.tolist()], "floor": row["qb_floor"][i]}

    again = B.block_pairs(known, index.directory, ["v", "length", "floor"], ["centre", "radius", "n"])
    return asks, B.blockwise(again, open_, f"query_id {kind}, block long, floor double")


def scored(asks: DataFrame, pairs: DataFrame, index: ResidualIndex, k: int) -> DataFrame:
    """(query_id, vec_id, mid, slack) of pairs(query_id, block, floor): vectors whose upper bound reaches the floor and the block's own k-th lower bound."""
    packs = max(1, -(-asks.count() // TOGETHER))
    met = pairs.join(asks, "query_id").withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs)))
    grouped = met.groupBy("block", "pack").agg(F.collect_list(F.struct("query_id", "v", "length", "floor")).alias("m"))
    wide = grouped.select("block", F.col("m.query_id").alias("q"), F.col("m.v").alias("qv"), F.col("m.length").alias("length"), F.col("m.floor").alias("floor"))
    dim = index.dim

    def kernel(row: dict) -> dict:
        z = np.frombuffer(row["z"], np.int8).reshape(-1, dim).astype(np.float64)
        mid = row["qv"] @ z.T * row["scale"]
        slack = row["length"][:, None] * row["gap"] + 1e-10
        asked, ids = (np.array(row[c], object) if isinstance(row[c], list) else row[c] for c in ("q", "ids"))
        low = np.where(asked[:, None] == ids[None, :], -np.inf, mid - slack)
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((mid + slack >= np.maximum(row["floor"], kth)[:, None] - SLACK) & (low > -np.inf))
        return {"query_id": [row["q"][n] for n in i.tolist()], "vec_id": [row["ids"][n] for n in j.tolist()], "mid": mid[i, j], "slack": slack[i, j]}

    work = wide.join(index.blocks.select("block", "ids", "z", "scale", "gap"), "block")
    return B.blockwise(work, kernel, f"query_id {B.kind(asks, 'query_id')}, vec_id {index.kind}, mid double, slack double")


def search(queries: DataFrame, index: ResidualIndex, items: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k largest exact products of queries(query_id, v) with items(vec_id, v), own ids left out.

    items are the rows that the index was made of; ids must be their own.
    """
    from .retrieval import ranked

    asks, pairs = meetings(queries, index, k)
    bounds = stored(scored(asks, pairs, index, k))
    live = bounds.join(floors(bounds, k), "query_id", "left").where(F.col("floor").isNull() | (F.col("mid") + F.col("slack") >= F.col("floor") - SLACK)).select("query_id", "vec_id")
    exact = live.join(items.select("vec_id", "v"), "vec_id").join(asks.select("query_id", F.col("v").alias("q")), "query_id")
    return ranked(exact.select("query_id", "vec_id", B.dot("q", "v").alias("score")), k, item="vec_id")
