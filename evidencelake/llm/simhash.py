"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints are 64-bit SimHashes over three-word shingles.  Equal fingerprints are one node.  Nodes within the radius
are found with bit masks made from the nonzero vectors v of a binary space of dimension radius + 1: bit i of a word
belongs to a fixed nonzero vector m(i), and the mask of v keeps the bits with <m(i), v> = 1.  Any ``radius`` differing
bits span at most ``radius`` dimensions, so some v is orthogonal to all of them and its mask hides every difference:
each pair within the radius shares a masked value in some table, with certainty.

A bucket of few fingerprints compares its members.  Members of larger buckets are linked another exact way without
pairs: two words within two bits of each other are both within one bit of a common word, so every member is written
to the 65 words of its own ball and members that meet at a word are chained to the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, key_of

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Members of a bucket up to which they are compared with each other.
SMALL = 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one whole text: A-Z lower-cased, words split at ASCII white space, repeats counted."""
    words = (text or "").encode().lower().split()  # bytes: ASCII only, both in lower() and in split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(plain[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = [fingerprint_of(v.as_py()) for v in batch]
            yield pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())

    return prints(text)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers."""
    space = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(bits) if ((1 + i % space) & v).bit_count() & 1) for v in range(1, space + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between the distinct ``fp`` longs of ``prints`` that connect all words within ``radius`` (2) bits.

    Members of small buckets get all their links, members of larger ones links through common words of their balls.
    """
    if radius != 2:
        raise ValueError("words that meet in balls of one bit are within two bits of each other: the radius must be 2")
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    tables = prints.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(tables.join(shared, ["t", "key"]))
    left, right = members.where(F.col("n") <= SMALL).select("t", "key", F.col("fp").alias("a")), members.where(F.col("n") <= SMALL)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("fp")) & near).select("a", F.col("fp").alias("b"))
    crowd = members.where(F.col("n") > SMALL).select("fp").distinct()
    flips = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    ball = F.array(*[F.lit(x).cast("long") for x in flips])
    spread = crowd.select("fp", F.explode(F.transform(ball, lambda x: x.bitwiseXOR(F.col("fp")))).alias("hub"))
    met = spread.groupBy("hub").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(star).distinct()


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rid, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id of the documents reachable over links, a document itself included.  Null and
    empty texts, and texts without a word, have fingerprint zero and link like any other.  Rows that repeat a doc_id
    count each with its own text.  A null doc_id takes part; a component of nothing else has a null component_id.
    Other columns are not looked at.
    """
    marked = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes.select("fp"), radius))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, of which each near-duplicate group keeps one: that of its smallest doc_id.

    Of rows that repeat the kept doc_id within a group, one stays.  A group of null doc_ids alone keeps one row.
    """
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    named = docs.select(F.struct(F.col(doc_id).alias("id"), body.alias("body")).alias("doc_id"), F.col(text).alias("text"))
    found = near_duplicates(named)
    # a component's least (id, body); null ids come last
    known = F.struct(F.col("doc_id.id").isNull().alias("none"), F.col("doc_id.id").alias("id"), F.col("doc_id.body").alias("body"))
    stay = found.groupBy("component_id").agg(F.min(known).alias("s"))
    keys = stay.select(F.concat_ws(":", key_of("s.id"), F.col("s.body")).alias("__row")).distinct()
    rows = docs.withColumn("__row", F.concat_ws(":", key_of(doc_id), body))
    return rows.join(keys, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)
