"""Readers and writers: the given tables, retrieval collections, files, versioned snapshots and checksummed results."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TEXT = 65_536


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with _id, title and text: (doc_id, text), title and text joined by a blank."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", "title", "text")).alias("text"))


def read_qrels(spark: SparkSession, path: str, *, positive: bool = False) -> DataFrame:
    """Tab-separated judgments with a header: (query_id, doc_id, gain)."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int")
    named = rows.toDF("query_id", "doc_id", "gain")
    return named.where("gain > 0") if positive else named


def read_files(spark: SparkSession, root: str, paths: list[str], *, most: int = MAX_TEXT, allowed: int = 128) -> DataFrame:
    """(source, text, digest, status) of allow-listed files below a root: current, missing or too_large.

    At most ``allowed`` paths, which are looked up one by one through the store's own file system: no other file is
    listed or read.  A link that leads out of the root is missing.
    """
    for path in paths:
        if path.startswith("/") or ".." in PurePosixPath(path).parts:
            raise ValueError(f"{path} leaves the root")
    if len(paths) > allowed:
        raise ValueError(f"at most {allowed} paths")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(conf)
    top = store.resolvePath(top)
    if store.getScheme() == "file":
        top = jvm.org.apache.hadoop.fs.Path(jvm.java.io.File(top.toUri().getPath()).toPath().toRealPath(spark._sc._gateway.new_array(jvm.java.nio.file.LinkOption, 0)).toUri())
    there = {}
    for path in paths:
        full = jvm.org.apache.hadoop.fs.Path(top, path)
        if store.exists(full) and store.getFileStatus(full).isFile() and _plain(jvm, store, full):
            there[str(full)] = path
    listed = spark.createDataFrame([(p,) for p in paths], "source string")
    named = spark.createDataFrame(list(there.items()), "path string, source string")
    if not there:
        return listed.select("source", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("digest"), F.lit("missing").alias("status"))
    found = spark.read.format("binaryFile").load(list(there))
    body = F.when(F.col("length") <= most, F.decode("content", "UTF-8"))
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")  # noqa: E731  with or without a scheme
    read = found.select(plain(F.col("path")).alias("path"), "length", body.alias("text")).join(F.broadcast(named.withColumn("path", plain(F.col("path")))), "path")
    joined = listed.join(read, "source", "left")
    status = F.when(F.col("path").isNull(), "missing").when(F.col("length") > most, "too_large").otherwise("current")
    return joined.select("source", "text", F.sha2("text", 256).alias("digest"), status.alias("status"))


def _plain(jvm, store, full) -> bool:
    """No link on the way; only local folders have them."""
    local = full.toUri().getPath()
    return store.getScheme() != "file" or jvm.java.io.File(local).getCanonicalPath() == local


def stored(frame: DataFrame) -> DataFrame:
    """Written as a table in the shared checkpoint folder and read again: made once, and safe from lost executors."""
    from ..operators.lifecycle import checkpoint_dir

    path = f"{checkpoint_dir(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def version_map(text: Column) -> Column:
    """map<string,string> of a JSON text; null unless it is an object whose values are texts."""
    made = F.from_json(text, "map<string,string>")
    kinds = F.from_json(text, "map<string,variant>")
    return F.when(F.forall(F.map_values(kinds), lambda v: F.schema_of_variant(v) == "STRING"), made)


def read_vectors(spark: SparkSession, path: str, column: str, digest: str | None = None) -> DataFrame:
    """A Parquet table of vectors; with ``digest``, that of vector_digest(), an error if its content is another."""
    rows = spark.read.parquet(path)
    if digest is not None and vector_digest(rows, column) != digest:
        raise ValueError(f"{path} does not have the content it should have")
    return rows


def vector_digest(rows: DataFrame, column: str) -> str:
    """An order-free checksum of a column's vectors and their number."""
    part = F.pmod(F.xxhash64(column), F.lit(1 << 31)).cast("decimal(38,0)")
    told = rows.agg(F.count("*").alias("n"), F.sum(part).alias("s"), F.sum(F.pmod(F.xxhash64(F.lit(1), column), F.lit(1 << 31)).cast("decimal(38,0)")).alias("t")).first()
    return f"{told['n']}-{told['s'] or 0}-{told['t'] or 0}"


def quarantine(items: DataFrame, *, most: int = MAX_TEXT) -> DataFrame:
    """Add ``reject_reason``: null for rows within bounds, else what is wrong with source or text."""
    reason = (
        F.when(F.col("source").isNull() | (F.octet_length("source") > 512), "source")
        .when(F.col("source").rlike(r"[\x00-\x1f\x7f]"), "control_character")
        .when(F.col("text").isNull(), "no_text").when(F.octet_length("text") > most, "text_too_large")
    )
    return items.withColumn("reject_reason", reason)


#: What the rows of a store are.
ITEMS = "source string, text string, digest string, stamp string, dependencies array<struct<name:string,version:string>>, stale boolean"


def write_snapshot(items: DataFrame, root: str, family_identity: str) -> str:
    """A new immutable version below root, with a metadata row that names the projection family; its path."""
    path = f"{root}/version-{uuid.uuid4().hex}"
    items.write.parquet(f"{path}/items")
    items.sparkSession.createDataFrame([("1", family_identity)], "schema string, family string").coalesce(1).write.json(f"{path}/meta")
    return path


def read_snapshot(spark: SparkSession, path: str, family_identity: str) -> DataFrame:
    meta = spark.read.schema("schema string, family string").json(f"{path}/meta").first()
    if (meta["schema"], meta["family"]) != ("1", family_identity):
        raise ValueError("the snapshot has another schema or projection family")
    return spark.read.parquet(f"{path}/items")


def open_store(spark: SparkSession, path: str, family_identity: str) -> DataFrame:
    """The items of a snapshot, as ITEMS; an error if the family is another or a column is missing or of another kind."""
    items = read_snapshot(spark, path, family_identity)
    wanted = spark.createDataFrame([], ITEMS).schema
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    if any(kinds.get(f.name) != f.dataType.simpleString() for f in wanted):
        raise ValueError("the snapshot does not have the columns of a store")
    return items.select(*wanted.names)


def write_checked(rows: DataFrame, path: str) -> str:
    """JSON rows and a manifest with their number and an order-free checksum of their content; the manifest's text."""
    rows.write.json(f"{path}/rows")
    body = F.to_json(F.struct(*sorted(rows.columns)))
    # 31 bits of each row's hash: sums of decimals neither overflow nor depend on order
    sums = rows.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.sha2(body, 256), 1, 8), 16, 10).cast("decimal(38,0)")).alias("checksum")).first()
    text = json.dumps({"rows": sums["rows"], "checksum": str(sums["checksum"] or 0), "columns": sorted(rows.columns)}, sort_keys=True)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return text
