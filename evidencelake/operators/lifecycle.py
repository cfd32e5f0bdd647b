"""Versioned items: freshness, upserts, explanations, visibility and dependency closures."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .payloads import handoff_header

#: Rounds of a closure after which what was found is written as one table again.
ROUNDS = 8
#: What stands for no dependencies.
NONE = "array<struct<name:string,version:string>>"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only for a session in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def shared(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's checkpoint folder."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def freshness(items: DataFrame, revisions: DataFrame | None) -> DataFrame:
    """Add ``freshness`` to items(source, digest, stale, ...): invalidated, unchecked, unknown_version, stale_version or current."""
    stale = F.when(F.col("stale"), "invalidated")
    if revisions is None:
        return items.withColumn("freshness", stale.otherwise("unchecked"))
    known = items.join(revisions.select("source", F.col("revision").alias("__r")), "source", "left")
    state = stale.when(F.col("__r").isNull(), "unknown_version").when(F.col("__r") != F.col("digest"), "stale_version").otherwise("current")
    return known.withColumn("freshness", state).drop("__r")


def explain_versions(dependencies: DataFrame, revisions: DataFrame) -> DataFrame:
    """(source, n_missing, n_changed, status) from dependencies(source, dependency, expected)."""
    seen = dependencies.join(revisions.select(F.col("source").alias("dependency"), "revision"), "dependency", "left")
    gone, changed = F.col("revision").isNull(), F.coalesce(F.col("revision") != F.col("expected"), F.lit(False))
    counted = seen.groupBy("source").agg(F.count_if(gone).alias("n_missing"), F.count_if(changed).alias("n_changed"))
    return counted.withColumn("status", F.when(F.col("n_changed") > 0, "stale").when(F.col("n_missing") > 0, "unknown").otherwise("current"))


def upsert_status(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """(source, status) of a batch against a snapshot, both (source, digest, stale): added, updated, refreshed or unchanged; kept if only the snapshot has it."""
    old = snapshot.select("source", F.col("digest").alias("old"), F.col("stale").alias("was_stale"))
    both = old.join(batch.select("source", F.col("digest").alias("new")), "source", "full_outer")
    state = (
        F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "updated")
        .when(F.col("was_stale"), "refreshed").otherwise("unchanged")
    )
    return both.select("source", state.alias("status"))


def _canonical(dependencies: str) -> Column:
    return F.array_sort(F.coalesce(F.col(dependencies), F.array().cast(NONE)))


def dependency_edges(items: DataFrame) -> DataFrame:
    """(source, target) for items(source, dependencies array<struct<name, version>>)."""
    return items.select("source", F.explode("dependencies").alias("d")).select("source", F.col("d.name").alias("target"))


def upsert(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The next snapshot (source, text, digest, dependencies, stale) and each row's ``status``.

    snapshot has these columns, batch(source, text, digest, dependencies) is applied at once.  Sources whose text or
    dependencies change make everything stale that the old snapshot's dependencies reach from them; rows of the batch
    themselves are fresh.  Status: added, updated, refreshed, unchanged, or kept for rows that the batch doesn't name.
    """
    old = snapshot.select("source", F.col("text").alias("t0"), F.col("digest").alias("d0"), _canonical("dependencies").alias("e0"), F.col("stale").alias("s0"))
    new = batch.select("source", F.col("text").alias("t1"), F.col("digest").alias("d1"), _canonical("dependencies").alias("e1"))
    both = shared(old.join(new, "source", "full_outer"))
    given, known = F.col("d1").isNotNull(), F.col("d0").isNotNull()
    moved = given & known & ((F.col("d0") != F.col("d1")) | (F.col("e0") != F.col("e1")))
    reached = affected(both.where(moved).select(F.col("source").alias("node")), dependency_edges(snapshot))
    status = (
        F.when(~given, "kept").when(~known, "added").when(F.col("d0") != F.col("d1"), "updated")
        .when((F.col("e0") == F.col("e1")) & ~F.col("s0"), "unchanged").otherwise("refreshed")
    )
    told = both.join(reached.select(F.col("node").alias("source"), F.lit(True).alias("hit")), "source", "left")
    stale = ~given & (F.coalesce("s0", F.lit(False)) | F.col("hit").isNotNull())
    now = [F.when(given, F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(n) for c, n in (("t", "text"), ("d", "digest"), ("e", "dependencies"))]
    return told.select("source", *now, stale.alias("stale"), status.alias("status"))


def forget(snapshot: DataFrame, names: DataFrame) -> DataFrame:
    """The snapshot without the sources of names(source); all that depends on them is stale."""
    reached = affected(names.select(F.col("source").alias("node")), dependency_edges(snapshot))
    left = snapshot.join(names.select("source"), "source", "left_anti")
    hit = left.join(reached.select(F.col("node").alias("source"), F.lit(True).alias("__hit")), "source", "left")
    return hit.withColumn("stale", F.col("stale") | F.col("__hit").isNotNull()).drop("__hit")


def lookup(snapshot: DataFrame, source: str) -> DataFrame:
    """The row of one source, or none."""
    return snapshot.where(F.col("source") == source)


def recall(ranked: DataFrame, limit: int = 5) -> DataFrame:
    """The best ``limit`` usable rows of each query: ranked(query_id, source, score, freshness, ...) that are current or unchecked, with ``place``."""
    if not 0 <= limit <= 100:
        raise ValueError("the limit must be between 0 and 100")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "source")
    usable = ranked.where(F.col("freshness").isin("current", "unchecked"))
    return usable.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def visible(nodes: DataFrame, role: str | Column, revisions: DataFrame) -> DataFrame:
    """Nodes(key, revision, roles) that the role may see at their present revision."""
    now = revisions.select("key", F.col("revision").alias("__r"))
    return nodes.where(F.array_contains("roles", role)).join(now, "key").where(F.col("__r") == F.col("revision")).drop("__r")


def _spread(start: DataFrame, arcs: DataFrame) -> DataFrame:
    """All rows of ``start`` (node and more columns) and what arcs(node, to) lead to from them, the other columns kept.

    Nodes that lead nowhere are set aside and come by one join at the end.  Of the others, those with a single way on
    form paths, which are walked by doubling: jump i goes 2^i steps, and a set that has all within 2^i steps of it has
    all within twice as many after it.  So a path of any length takes as many rounds as its length has binary digits,
    and only where paths part or meet a breadth-first round is needed.  Known rows are dropped, so cycles end.
    """
    names = start.columns
    follow = lambda rows, ways: rows.join(ways, "node").drop("node").withColumnRenamed("to", "node").select(*names)
    arcs = shared(arcs.where("node <> to").distinct())
    leading = arcs.select(F.col("node").alias("to")).distinct()
    inner, last = shared(arcs.join(leading, "to", "left_semi").select("node", "to")), arcs.join(leading, "to", "left_anti").select("node", "to")
    counted = inner.join(inner.groupBy("node").agg(F.count("*").alias("n")), "node")
    jump, parting = shared(counted.where("n = 1").select("node", "to")), shared(counted.where("n > 1").select("node", "to"))
    paths = jump.count()
    jumps = [jump] if paths else []

    def walked(rows: DataFrame) -> DataFrame:
        """The rows and all that single ways lead to from them; jumps are made when they are first needed."""
        n, level = rows.count(), 0
        while level < len(jumps):
            rows = shared(rows.union(follow(rows, jumps[level])).distinct())
            before, n = n, rows.count()
            if n == before:
                break  # no step leads out of the set, so no jump does
            level += 1
            if level == len(jumps) and 1 << level <= paths:
                half = jumps[-1]
                twice = shared(half.join(half.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
                if not twice.isEmpty():
                    jumps.append(twice)
        return rows

    seen = frontier = walked(shared(start.distinct()))
    rounds = 0
    while not frontier.isEmpty():
        found = shared(follow(frontier, parting).distinct().join(seen, names, "left_anti"))
        frontier = shared(walked(found).join(seen, names, "left_anti"))
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % ROUNDS == 0:
            seen = shared(seen)
    return seen.union(follow(seen, last)).distinct()


def closure(roots: DataFrame, edges: DataFrame, *, root: str = "root", node: str = "node") -> DataFrame:
    """(root, node): all nodes that a root reaches over edges(source, target), itself included; cycles are fine."""
    start = roots.select(F.col(root).alias("root"), F.col(root).alias("node"))
    seen = _spread(start, edges.select(F.col("source").alias("node"), F.col("target").alias("to")))
    return seen.select(F.col("root").alias(root), F.col("node").alias(node))


def affected(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(node): everything that depends on a changed node, itself included; dependencies(source depends on target).

    The state holds nodes, not pairs, so it never outgrows the graph.
    """
    return _spread(changed.select("node"), dependencies.select(F.col("target").alias("node"), F.col("source").alias("to")))


def handoff(roots: DataFrame, edges: DataFrame, nodes: DataFrame, *, role: str, budget_bytes: int) -> DataFrame:
    """(root, status, reason, n_sources, units): whole dependency closures or nothing.

    nodes(key, text, revision, roles, current); edges(source, target) depend, or by ``kind`` if there is one: depends_on
    edges are followed, and two nodes of a packet that a contradicts edge joins make it conflicting_context.  A node that
    is missing, hidden from the role or out of date, or a followed edge that is not ``current`` (if there is such a
    column), makes a root's packet unavailable without naming it; so does a packet beyond the budget.
    """
    depends = edges.where("kind = 'depends_on'") if "kind" in edges.columns else edges
    reached = shared(closure(roots, depends))
    known = reached.join(nodes.withColumnRenamed("key", "node"), "node", "left")
    if "current" in depends.columns:
        old = depends.where("not current").select(F.col("source").alias("node"), F.lit(True).alias("old")).distinct()
        known = known.join(old, "node", "left")
    else:
        known = known.withColumn("old", F.lit(None).cast("boolean"))
    fine = F.coalesce(F.array_contains("roles", role) & F.col("current") & F.col("old").isNull(), F.lit(False))
    header = F.octet_length(handoff_header(F.col("node").cast("string"), F.col("revision"), F.sha2("text", 256)))
    units = F.sum(header + F.octet_length("text") + 2) - 2
    packed = known.groupBy("root").agg(F.bool_and(fine).alias("fine"), units.alias("size"), F.count("*").alias("n"))
    clash = F.lit(None).cast("boolean")
    if "kind" in edges.columns:
        ends = reached.join(edges.where("kind = 'contradicts'").select(F.col("source").alias("node"), F.col("target").alias("other")), "node")
        both = ends.select("root", F.col("other").alias("node")).join(reached, ["root", "node"], "left_semi").select("root").distinct()
        packed, clash = packed.join(both.withColumn("clash", F.lit(True)), "root", "left"), F.col("clash")
    reason = (
        F.when(~F.col("fine"), "unavailable_context").when(clash.isNotNull(), "conflicting_context")
        .when(F.col("size") > budget_bytes, "budget_exceeded").otherwise("dependency_closure")
    )
    done = F.col("reason") == "dependency_closure"
    told = packed.withColumn("reason", reason)
    return told.select("root", F.when(done, "complete").otherwise("insufficient").alias("status"), "reason", F.when(done, F.col("n")).otherwise(0).cast("long").alias("n_sources"), F.when(done, F.col("size")).otherwise(0).cast("long").alias("units"))


def diffusion(roots: DataFrame, arcs: DataFrame, *, hops: int = 2, restart: float = 0.35) -> DataFrame:
    """(root, node, mass) after ``hops`` steps of personalised diffusion over arcs(source, target, weight).

    Mass of a node without arcs returns to the root.
    """
    total = arcs.groupBy("source").agg(F.sum("weight").alias("total"))
    step = arcs.groupBy("source", "target").agg(F.sum("weight").alias("weight")).join(total, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share"))
    state = roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("mass"))
    for _ in range(hops):
        moved = state.join(step, state["node"] == step["source"], "left")
        target, part = F.coalesce("target", "root"), F.coalesce("share", F.lit(1.0))
        flow = moved.select("root", target.alias("node"), ((1 - restart) * F.col("mass") * part).alias("mass"))
        back = roots.select("root", F.col("root").alias("node"), F.lit(restart).alias("mass"))
        state = flow.union(back).groupBy("root", "node").agg(F.sum("mass").alias("mass"))
    return state
