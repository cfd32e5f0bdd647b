"""A stated set of queries against all rows, block by block: what meets in a task leaves it as k rows a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a block, about.
BLOCK = 2048


class Every:
    """Said in place of a list of eligible rows: every row is, and the caller answers for that."""


EVERY = Every()


def kind(frame: DataFrame, column: str) -> str:
    """A column's type as schemas are written: ids may be numbers or texts."""
    return frame.schema[column].dataType.simpleString()


def packed(frame: DataFrame, key: str, columns: list[str], name: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(name, ids, columns as lists) of blocks of about ``size`` rows dealt by hash, and their number as one row."""
    count = frame.agg(F.greatest(F.ceil(F.count("*") / F.lit(size)), F.lit(1)).cast("int").alias("blocks"))
    dealt = frame.crossJoin(F.broadcast(count)).withColumn(name, F.pmod(F.xxhash64(key), F.col("blocks")))  # count is one row
    packs = dealt.groupBy(name).agg(F.collect_list(F.struct(key, *columns)).alias("m"))
    return packs.select(name, F.col(f"m.{key}").alias(f"{name}_ids"), *[F.col(f"m.{c}").alias(f"{name}_{c}") for c in columns]), count


def block_pairs(queries: DataFrame, items: DataFrame, asked: list[str], given: list[str], *, size: int = BLOCK, eligible: DataFrame | Every = EVERY) -> DataFrame:
    """A row for each block of queries(query_id, asked) and each block of items(vec_id, given), with their columns as lists.

    ``eligible`` has the rows that may be given: (vec_id) for all queries, or (query_id, vec_id).  The latter come as
    ``may_q`` and ``may_i``, places in the two blocks; blocks of queries and items without any don't meet.  None is an
    error.  Blocks of queries are written once for each block of items and joined on its number; nothing is broadcast
    but one row.
    """
    if eligible is None:
        raise ValueError("eligible rows must be given, or EVERY")
    if eligible is not EVERY and "query_id" not in eligible.columns:
        items, eligible = items.join(eligible.select("vec_id").distinct(), "vec_id", "left_semi"), EVERY
    q, _ = packed(queries, "query_id", asked, "qb", size)
    x, count = packed(items, "vec_id", given, "ib", size)
    if eligible is EVERY:
        spread = q.crossJoin(F.broadcast(count)).withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return spread.join(x.hint("shuffle_merge"), "ib").repartition("qb", "ib")
    from ..sources.tables import stored

    q, x = stored(q), stored(x)  # places are told of them as they are written
    asks = q.select("qb", F.posexplode("qb_ids").alias("qp", "query_id"))
    gives = x.select("ib", F.posexplode("ib_ids").alias("ip", "vec_id"))
    met = eligible.select("query_id", "vec_id").distinct().join(asks, "query_id").join(gives, "vec_id")
    may = met.groupBy("qb", "ib").agg(F.collect_list(F.struct("qp", "ip")).alias("m")).select("qb", "ib", F.col("m.qp").alias("may_q"), F.col("m.ip").alias("may_i"))
    return may.join(q.hint("shuffle_merge"), "qb").join(x.hint("shuffle_merge"), "ib").repartition("qb", "ib")


def barred(row: dict, score: np.ndarray) -> np.ndarray:
    """Scores with -inf where an item may not be given: a query's own id, and what isn't eligible for it."""
    asked, ids = (np.array(row[c], object) if isinstance(row[c], list) else row[c] for c in ("qb_ids", "ib_ids"))
    open_ = asked[:, None] != ids[None, :]
    if "may_q" in row:
        may = np.zeros(score.shape, bool)
        may[row["may_q"], row["may_i"]] = True
        open_ = open_ & may
    return np.where(open_, score, -np.inf)


def cell(value: pa.Scalar) -> object:
    """A list of numbers as an array, one of equally long lists of numbers as a matrix, anything else as Python has it."""
    if not isinstance(value, pa.ListScalar):
        return value.as_py()
    inner = value.values
    if pa.types.is_list(inner.type):
        return inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1)
    return inner.to_numpy(zero_copy_only=False) if pa.types.is_primitive(inner.type) else inner.to_pylist()


def blockwise(pairs: DataFrame, kernel: Callable[[dict], dict], schema: str) -> DataFrame:
    """What ``kernel`` makes of each row of block_pairs(), as columns."""
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(kernel({name: cell(batch.column(name)[at]) for name in batch.schema.names}), shape)

    return pairs.mapInArrow(run, schema)


def best_of(score: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best of each row of a score matrix; scores that agree in so many digits tie, and the smaller id goes first.  -inf is out."""
    keys = np.round(score, digits)
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(-keys[:, by_id], axis=1, kind="stable")[:, :k]]
    rows, cols = np.repeat(np.arange(len(score)), order.shape[1]), order.ravel()
    ok = keys[rows, cols] > -np.inf
    return rows[ok], cols[ok]


def ranked_block(row: dict, score: np.ndarray, k: int, digits: int) -> dict:
    """The k best of each query in a block, among what it may be given."""
    ids = np.array(row["ib_ids"], object) if isinstance(row["ib_ids"], list) else row["ib_ids"]
    score = barred(row, score)
    i, j = best_of(score, ids, k, digits)
    return {"query_id": [row["qb_ids"][n] for n in i.tolist()], "vec_id": [row["ib_ids"][n] for n in j.tolist()], "score": score[i, j]}


def hamming_topk(queries: DataFrame, items: DataFrame, k: int, *, views: list[tuple[int, float]], eligible: DataFrame | Every = EVERY, digits: int = 9, size: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score) with the k best of each block at least: packed codes by weighted agreement of their views.

    queries(query_id, code), items(vec_id, code), binary; ``views`` has the bytes and the weight of each view in the
    code's order; ``eligible`` as in block_pairs().  Codes that are null or of another width take no part.
    """
    width, total = sum(n for n, _ in views), sum(w for _, w in views)
    fits = F.octet_length("code") == width

    def kernel(row: dict) -> dict:
        a, b = (np.frombuffer(b"".join(row[c]), np.uint8).reshape(-1, width) for c in ("qb_code", "ib_code"))
        score, at = np.zeros((len(a), len(b))), 0
        for n, weight in views:
            apart = sum(np.bitwise_count(a[:, None, i] ^ b[None, :, i]).astype(np.int32) for i in range(at, at + n))
            score += (1 - apart / (8.0 * n)) * (weight / total)
            at += n
        return ranked_block(row, score, k, digits)

    pairs = block_pairs(queries.where(fits), items.where(fits), ["code"], ["code"], size=size, eligible=eligible)
    return blockwise(pairs, kernel, f"query_id {kind(queries, 'query_id')}, vec_id {kind(items, 'vec_id')}, score double")


def residual_topk(queries: DataFrame, items: DataFrame, k: int, *, eligible: DataFrame | Every = EVERY, size: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, mid, slack): rows whose upper bound reaches their block's k-th lower bound.

    queries(query_id, v, length), items(vec_id, z array<tinyint>, scale, gap): the product of v with scale * z is off by
    gap * length at most; ``eligible`` as in block_pairs().  What is dropped can't be among the k best of its block, so
    not of all.
    """

    def kernel(row: dict) -> dict:
        mid = row["qb_v"] @ row["ib_z"].astype(np.float64).T * row["ib_scale"]
        slack = row["qb_length"][:, None] * row["ib_gap"] + 1e-10
        low = barred(row, mid - slack)
        floor = np.sort(low, axis=1)[:, -min(k, low.shape[1])]
        i, j = np.nonzero((mid + slack >= floor[:, None] - 1e-9) & (low > -np.inf))
        return {"query_id": [row["qb_ids"][n] for n in i.tolist()], "vec_id": [row["ib_ids"][n] for n in j.tolist()], "mid": mid[i, j], "slack": slack[i, j]}

    pairs = block_pairs(queries, items, ["v", "length"], ["z", "scale", "gap"], size=size, eligible=eligible)
    return blockwise(pairs, kernel, f"query_id {kind(queries, 'query_id')}, vec_id {kind(items, 'vec_id')}, mid double, slack double")


def dot(a: str | Column, b: str | Column) -> Column:
    """The product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
