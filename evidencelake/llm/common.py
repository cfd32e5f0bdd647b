"""Helpers that the corpus operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Has the shuffle files of a query go when it ends, and not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one of the given tables."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, named by the cluster in ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder, and any other an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: later reads survive a lost executor and do no work again."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stage(frame: DataFrame, compression: str = "snappy", per_file: int = 0) -> DataFrame:
    """Like cut(), as a compressed Parquet table in the shared folder, of so many rows a file at most if that is given.

    Shuffle files of its making are gone by then.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.options(compression=compression, maxRecordsPerFile=per_file).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the files of a table made by stage() that no frame in use depends on."""
    spark = staged.sparkSession
    for folder in {re.match(r"(.*/stage-[0-9a-f]{32})/", file)[1] for file in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(frame: DataFrame) -> None:
    """Have the driver notice which shuffles are done with, so that their files go now and not at its next collection."""
    gc.collect()
    frame.sparkSession._jvm.System.gc()


def key_of(column: str) -> Column:
    """A string key that is never null: equal for equal values, and null has one of its own."""
    return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("n"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4 (null: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in ``links``: nodes have equal roots iff a path of links joins them.

    Randomised contraction.  In each round every node points at the neighbour (or itself) of smallest hashed id, the
    pointers are followed once more, and the graph is rewritten over the nodes pointed at.  The hash differs by round,
    so in expectation a constant share of the nodes goes in each, for chains as well as for stars, and the number of
    rounds is logarithmic.  Joins are sort-merge joins, whose skewed keys Spark can split; nothing is broadcast.  A node's neighbourhood is only ever reduced by a partial minimum, never collected, so a
    node with most of the links is no hot task.  Each round ends in a checkpoint.
    """
    ends = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    graph = cut(ends.withColumn("turn", F.lit(0)))
    # the round's number is data, so that all rounds share their compiled code
    rank = lambda c: F.struct(F.xxhash64("turn", c).alias("h"), F.col(c).alias("id"))
    labels = None
    while not graph.isEmpty():
        both = graph.select(F.col("a").alias("u"), F.col("b").alias("v"), "turn").union(graph.select("b", "a", "turn"))
        least = both.groupBy("u").agg(F.min(rank("v")).alias("m"), F.max("turn").alias("turn"))
        step = least.select("u", F.least(F.col("m"), rank("u"))["id"].alias("p"))
        up = step.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = cut(step.join(up.hint("merge"), "p").select("u", F.col("pp").alias("p")))
        if labels is None:
            labels = jump.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = labels.join(jump.select(F.col("u").alias("root"), F.col("p").alias("to")).hint("merge"), "root", "left")
            labels = cut(moved.select("node", F.coalesce("to", "root").alias("root")))
        ja, jb = (jump.select(F.col("u").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        ends = graph.join(ja.hint("merge"), "a").join(jb.hint("merge"), "b").where("pa <> pb")
        moved = ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), (F.col("turn") + 1).alias("turn"))
        graph = cut(moved.distinct())
    if labels is None:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
