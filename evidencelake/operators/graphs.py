"""Relationship graphs: bindings of edges to node versions, groups, revisions and hop features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lifecycle import shared

#: Kinds of relationships.
KINDS = ("depends_on", "supports", "contradicts", "produced_by", "related_to")


def put(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with those of ``new`` added; a key that is there is replaced.  Both have the same columns, ``key`` among them."""
    return nodes.join(new.select("key"), "key", "left_anti").unionByName(new)


def link(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected) after new(source, target, kind, provenance) is bound to the present versions of its endpoints.

    nodes(key, digest, revision).  A relationship of the same source, target and kind is replaced.  Rejected rows carry
    a ``reject_reason``: an unknown kind, a loop, or an endpoint that isn't there.
    """
    ends = nodes.select("key", "digest", "revision")
    a = ends.select(F.col("key").alias("source"), F.col("digest").alias("source_digest"), F.col("revision").alias("source_revision"))
    b = ends.select(F.col("key").alias("target"), F.col("digest").alias("target_digest"), F.col("revision").alias("target_revision"))
    bound = new.join(a, "source", "left").join(b, "target", "left")
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind").when(F.col("source") == F.col("target"), "loop")
        .when(F.col("source_digest").isNull() | F.col("target_digest").isNull(), "endpoint")
    )
    judged = shared(bound.withColumn("reject_reason", reason))
    good = judged.where("reject_reason is null").select(*edges.columns)
    kept = edges.join(good.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti")
    return kept.select(*edges.columns).unionByName(good), judged.where("reject_reason is not null").select(*new.columns, "reject_reason")


def edge_currency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``current`` to edges: both endpoints have the digest and the revision that the edge was bound to."""
    for end in ("source", "target"):
        now = nodes.select(F.col("key").alias(end), F.struct("digest", "revision").alias(f"__{end}"))
        edges = edges.join(now, end, "left")
    same = lambda end: F.coalesce((F.col(f"__{end}.digest") == F.col(f"{end}_digest")) & (F.col(f"__{end}.revision") == F.col(f"{end}_revision")), F.lit(False))
    return edges.withColumn("current", same("source") & same("target")).drop("__source", "__target")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the least node that a path of links joins it with.

    Stars and roots in turn: every node is linked to the least of its neighbourhood, larger ones by larger neighbours,
    then smaller ones by smaller, until nothing moves.  Neighbourhoods meet in partial minima only.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = shared(edges)

    def sums(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())

    before = None
    while (now := sums(edges)) != before:
        before = now
        # large star: each larger neighbour of u points at the least of u's neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared(large)
        # small star: u and its smaller neighbours point at the least of these
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = shared(small.union(lower.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def graph_revision(edges: DataFrame, *by: str) -> DataFrame:
    """(by, n_edges, revision): a digest of the set of (source, target, kind, weight), whatever the order of rows.

    The digest is of eight sums of 32-bit parts of the edges' digests: no edge list is ever gathered.
    """
    one = F.sha2(F.to_json(F.struct("source", "target", "kind", "weight")), 256)
    part = lambda i: F.sum(F.conv(F.substring("__d", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    told = edges.withColumn("__d", one).groupBy(*by).agg(F.count("*").alias("n_edges"), F.concat_ws(",", *[part(i) for i in range(8)]).alias("__s"))
    return told.select(*by, "n_edges", F.sha2(F.concat_ws("|", F.col("n_edges").cast("string"), "__s"), 256).alias("revision"))


def relation_features(roots: DataFrame, edges: DataFrame, *, dim: int = 64, hops: int = 2, restart: float = 0.35, decay: float = 0.7) -> DataFrame:
    """(root, slot, value): hashed features of a diffusion from each root over edges(source, target, kind, weight), length one.

    Each hop sends a node's mass along its arcs, forward and reverse, by weight; an arc's share counts for the feature
    "h<hop>:<direction>:<kind>:<target>", less by ``decay`` for each hop.  Mass without arcs returns to the root.
    """
    forward = edges.select("source", "target", "kind", "weight", F.lit("forward").alias("way"))
    arcs = forward.union(edges.select("target", "source", "kind", "weight", F.lit("reverse")))
    total = arcs.groupBy("source").agg(F.sum("weight").alias("total"))
    step = shared(arcs.join(total, "source").select(F.col("source").alias("node"), "target", "kind", "way", (F.col("weight") / F.col("total")).alias("share")))
    rooted = roots.select("root")
    state = rooted.select("root", F.col("root").alias("node"), F.lit(1.0).alias("mass"))
    made = rooted.select("root", F.concat(F.lit("root:"), "root").alias("token"), F.lit(1.0).alias("value"))
    for hop in range(1, hops + 1):
        sent = shared(state.join(step, "node", "left").withColumn("sent", (1 - restart) * F.col("mass") * F.coalesce("share", F.lit(1.0))))
        token = F.concat_ws(":", F.lit(f"h{hop}"), "way", "kind", "target")
        made = made.union(sent.where("target is not null").select("root", token, F.col("sent") * F.lit(decay ** (hop - 1))))
        back = rooted.select("root", F.col("root").alias("node"), F.lit(restart).alias("mass"))
        state = sent.select("root", F.coalesce("target", "root").alias("node"), F.col("sent").alias("mass")).union(back).groupBy("root", "node").agg(F.sum("mass").alias("mass"))
    slot, sign = T.slot_and_sign(F.col("token"), dim)
    summed = made.groupBy("root", slot.alias("slot")).agg(F.sum(sign * F.col("value")).alias("value"))
    norms = summed.groupBy("root").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return summed.join(norms, "root").where("norm > 0").select("root", "slot", (F.col("value") / F.col("norm")).alias("value"))

