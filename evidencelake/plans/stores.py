"""Queries over a store of versioned items and the graph between them, made from the conversations: a turn depends on the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import graphs as G
from ..operators import lifecycle as V
from ..operators import payloads as P
from ..operators import retrieval as R
from ..operators import routing as RO
from ..operators import selection as S
from ..sources.tables import stored, table
from ..streaming import receipts as RC
from .documents import BM25, _best, _docs, _queries
from .registry import query

#: What happens to an item is told from its key's digest.
_B = "('0x' || substr(sha256(conv_id || '/' || turn), 1, 8))::UBIGINT % 10"
_TURNS = f"t AS (SELECT conv_id, turn, role, text, conv_id || '/' || turn AS key, {_B} AS b FROM conversations)"


def _number(key: Column) -> Column:
    return T.head_number(T.digest(key)) % 10


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    return rows.withColumn("b", _number(F.col("key")))


def _depends(version: Column) -> Column:
    """On the turn before, in the given version."""
    before = F.struct(F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("name"), version.alias("version"))
    return F.when(F.col("turn") > 0, F.array(before)).otherwise(F.array().cast(V.NONE))


def _snapshot(turns: DataFrame) -> DataFrame:
    text = F.when(F.col("b") == 2, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    rows = turns.where("b <> 1").select(F.col("key").alias("source"), text.alias("text"), _depends(F.when(F.col("b") == 4, "v0").otherwise("v1")).alias("dependencies"), (F.col("b") == 3).alias("stale"))
    return rows.withColumn("digest", T.digest(F.col("text")))


@query(f"""
WITH RECURSIVE {_TURNS}, hit AS (
  SELECT conv_id, turn FROM t WHERE b = 2 OR (b = 4 AND turn > 0)
  UNION SELECT t.conv_id, t.turn FROM t JOIN hit ON t.conv_id = hit.conv_id AND t.turn = hit.turn + 1 WHERE t.b <> 1)
SELECT key AS source, CASE WHEN b NOT BETWEEN 1 AND 5 THEN 'kept' WHEN b = 1 THEN 'added' WHEN b = 2 THEN 'updated' WHEN b = 3 OR (b = 4 AND turn > 0) THEN 'refreshed' ELSE 'unchanged' END AS status,
b NOT BETWEEN 1 AND 5 AND (conv_id, turn) IN (SELECT (conv_id, turn) FROM hit) AS stale, sha256(text) AS digest FROM t
""")
def q47_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    batch = turns.where("b between 1 and 5").select(F.col("key").alias("source"), "text", T.digest(F.col("text")).alias("digest"), _depends(F.lit("v1")).alias("dependencies"))
    return V.upsert(_snapshot(turns), batch).select("source", "status", "stale", "digest")


@query(f"""
WITH RECURSIVE {_TURNS}, hit AS (
  SELECT conv_id, turn FROM t WHERE role = 'system'
  UNION SELECT t.conv_id, t.turn FROM t JOIN hit ON t.conv_id = hit.conv_id AND t.turn = hit.turn + 1 WHERE t.b <> 1)
SELECT key AS source, b = 3 OR (conv_id, turn) IN (SELECT (conv_id, turn) FROM hit) AS stale FROM t WHERE b <> 1 AND role <> 'system'
""")
def q48_store_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    names = turns.where("role = 'system'").select(F.col("key").alias("source"))
    return V.forget(_snapshot(turns), names).select("source", "stale")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, freshness) as in q22."""
    b = _number(F.col("doc_id").cast("string"))
    state = F.when(b == 0, "invalidated").when(b == 1, "unknown_version").when(b == 2, "stale_version").otherwise("current")
    return _docs(spark, sf_dir).select("doc_id", state.alias("freshness"))


_STATES = "fr AS (SELECT doc_id, CASE b WHEN 0 THEN 'invalidated' WHEN 1 THEN 'unknown_version' WHEN 2 THEN 'stale_version' ELSE 'current' END AS freshness FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 10 AS b FROM documents))"


@query(f"""
WITH {BM25}, {_STATES}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
u AS (SELECT query_id, doc_id, score, freshness, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM r JOIN fr USING (doc_id) WHERE rank <= 20 AND freshness = 'current')
SELECT query_id, doc_id AS source, place, round(score, 6) AS score FROM u WHERE place <= 5
""")
def q49_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _best(spark, sf_dir, 20).join(_states(spark, sf_dir), "doc_id").select("query_id", F.col("doc_id").alias("source"), "score", "freshness")
    return V.recall(ranked).select("query_id", "source", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best documents of each item as chunks with their freshness."""
    docs, digest = _docs(spark, sf_dir), T.digest(F.col("text"))
    chunk = P.evidence_chunk(F.col("doc_id").cast("string"), digest, F.col("text"))
    sized = docs.select("doc_id", digest.alias("digest"), F.octet_length(chunk).alias("bytes"), T.words(F.col("text")).alias("words"))
    best = stored(_best(spark, sf_dir, k).select("query_id", "rank", "doc_id", "score"))
    met = best.join(sized, "doc_id").join(_states(spark, sf_dir), "doc_id")
    return met.withColumn("dependencies", F.lit("")).withColumnRenamed("doc_id", "source")


@query(f"""
WITH RECURSIVE {BM25}, {_STATES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
c AS (SELECT query_id, rank, doc_id, score, freshness, sha256(text) AS digest, octet_length(encode('{{"source": "' || doc_id || '", "sha256": "' || sha256(text) || '"}}' || chr(10) || text)) AS bytes
      FROM r JOIN documents USING (doc_id) JOIN fr USING (doc_id) WHERE rank <= 10),
go AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, []::VARCHAR[] AS seen, '' AS reason, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL SELECT query_id, rank, CASE WHEN why = 'selected' THEN used + cost ELSE used END, CASE WHEN why = 'selected' THEN list_append(seen, digest) ELSE seen END, why, doc_id FROM (
    SELECT c.query_id, c.rank, used, seen, c.doc_id, digest, bytes + CASE WHEN used > 0 THEN 2 ELSE 0 END AS cost,
      CASE WHEN freshness <> 'current' THEN freshness WHEN score < 8 THEN 'below_threshold' WHEN list_contains(seen, digest) THEN 'exact_duplicate'
           WHEN used + bytes + CASE WHEN used > 0 THEN 2 ELSE 0 END > 4096 THEN 'budget' ELSE 'selected' END AS why
    FROM go JOIN c ON c.query_id = go.query_id AND c.rank = go.rank + 1))
SELECT query_id, rank, doc_id AS source, reason, (max(used) OVER (PARTITION BY query_id))::BIGINT AS units FROM go WHERE rank > 0
""")
def q50_pack_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _candidates(spark, sf_dir, 10).select("query_id", "rank", "source", "score", "digest", "dependencies", "freshness", "bytes")
    return S.pack_budget(ready, 4096, min_score=8.0).withColumn("rank", F.col("rank").cast("long"))


@query()
def q51_select_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy utility under a budget; the best document of each item is required."""
    rows = _candidates(spark, sf_dir, 20).withColumn("required", F.col("rank") == 1)
    asked = _queries(spark, sf_dir).select("query_id", T.words(F.col("text")).alias("query_words"))
    return S.select_evidence(rows.join(asked, "query_id"), 8192)


def _edges(turns: DataFrame) -> DataFrame:
    """What turns depend on, bound to versions of which some are old, and contradictions of the first and third turn of some conversations."""
    bound = lambda kind, other: turns.select(
        F.col("key").alias("source"), F.concat_ws("/", "conv_id", other).alias("target"), F.lit(kind).alias("kind"), F.lit("table").alias("provenance"),
        F.when(F.col("b") == 0, "old").otherwise(T.digest(F.col("text"))).alias("source_digest"), F.lit("r1").alias("source_revision"), "turn", "conv_id",
    )
    edges = bound("depends_on", F.col("turn") - 1).where("turn > 0").unionByName(bound("contradicts", F.lit(0)).where("turn = 2 and conv_id % 7 = 0"))
    digests = turns.select(F.col("key").alias("target"), T.digest(F.col("text")).alias("target_digest"), F.lit("r1").alias("target_revision"))
    return edges.drop("turn", "conv_id").join(digests, "target")


_COLUMNS = ("source", "target", "kind", "provenance", "source_digest", "target_digest", "source_revision", "target_revision")


@query(f"""
WITH {_TURNS} SELECT conv_id || '/' || turn AS source, conv_id || '/' || (turn - 1) AS target, 'depends_on' AS kind, b <> 0 AS current FROM t WHERE turn > 0
UNION ALL SELECT conv_id || '/' || turn, conv_id || '/0', 'contradicts', b <> 0 FROM t WHERE turn = 2 AND conv_id % 7 = 0
""")
def q52_edge_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    nodes = turns.select("key", T.digest(F.col("text")).alias("digest"), F.lit("r1").alias("revision"))
    return G.edge_currency(_edges(turns), nodes).select("source", "target", "kind", "current")


@query(f"""
WITH {_TURNS}, p AS (SELECT conv_id, max(turn) AS last, bool_and(role <> 'system') AS fine, bool_and(b <> 0 OR turn = 0) AS fresh, count(*) > 2 AND conv_id % 7 = 0 AS clash, count(*) AS n,
  sum(octet_length(encode('{{"revision": "r1", "sha256": "' || sha256(text) || '", "source": "' || key || '"}}' || chr(10) || text)) + 2) - 2 AS size FROM t GROUP BY conv_id),
r AS (SELECT conv_id || '/' || last AS root, CASE WHEN NOT fine OR NOT fresh THEN 'unavailable_context' WHEN clash THEN 'conflicting_context' WHEN size > 8192 THEN 'budget_exceeded' ELSE 'dependency_closure' END AS reason, n, size FROM p)
SELECT root, CASE WHEN reason = 'dependency_closure' THEN 'complete' ELSE 'insufficient' END AS status, reason,
CASE WHEN reason = 'dependency_closure' THEN n ELSE 0 END::BIGINT AS n_sources, CASE WHEN reason = 'dependency_closure' THEN size ELSE 0 END::BIGINT AS units FROM r
""")
def q53_handoff_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handoffs that fail closed on stale edges and contradictions too."""
    turns = _turns(spark, sf_dir)
    roots = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.concat_ws("/", "conv_id", "turn").alias("root"))
    roles = F.when(F.col("role") == "system", F.array(F.lit("admin"))).otherwise(F.array(F.lit("admin"), F.lit("reader")))
    nodes = turns.select("key", "text", T.digest(F.col("text")).alias("digest"), F.lit("r1").alias("revision"), roles.alias("roles"), F.lit(True).alias("current"))
    return V.handoff(roots, G.edge_currency(_edges(turns), nodes), nodes, role="reader", budget_bytes=8192)


@query(f"""
WITH {_TURNS} SELECT CASE WHEN b = 5 THEN 'kind' WHEN b = 6 THEN 'loop' WHEN b = 7 THEN 'endpoint' WHEN turn = 0 THEN 'endpoint' WHEN b = 8 THEN 'replaced' ELSE 'added' END AS outcome, count(*) AS n
FROM t GROUP BY 1
""")
def q54_graph_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New relationships of every turn: rejected by reason, in place of an old one, or added."""
    turns = _turns(spark, sf_dir)
    known = turns.where("b = 8").select(F.col("key").alias("source"))
    old = _edges(turns).where("kind = 'depends_on'").join(known, "source", "left_semi").withColumn("provenance", F.lit("before")).select(*_COLUMNS)
    target = F.when(F.col("b") == 6, F.col("key")).when(F.col("b") == 7, "nowhere").otherwise(F.concat_ws("/", "conv_id", F.col("turn") - 1))
    new = turns.select(F.col("key").alias("source"), target.alias("target"), F.when(F.col("b") == 5, "likes").otherwise("depends_on").alias("kind"), F.lit("now").alias("provenance"))
    nodes = turns.select("key", T.digest(F.col("text")).alias("digest"), F.lit("r1").alias("revision"))
    edges, rejected = G.link(old, nodes, new)
    known = old.select("source", "target", "kind", F.lit("replaced").alias("outcome"))
    told = edges.where("provenance = 'now'").join(known, ["source", "target", "kind"], "left").select(F.coalesce("outcome", F.lit("added")).alias("outcome"))
    return told.unionByName(rejected.select(F.col("reject_reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE qr AS (SELECT item_id AS q, doc_id AS d FROM benchmark b, documents t WHERE contains(t.text, b.text)),
e AS (SELECT DISTINCT a.q AS a, b.q AS b FROM qr a JOIN qr b USING (d)),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
g AS (SELECT a AS query_id, min(b) AS root FROM reach GROUP BY 1)
SELECT query_id, root, count(*) OVER (PARTITION BY root) AS size FROM g
""")
def q55_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share a relevant document, over any number of steps, are one group, so that a split can keep them together."""
    qrels = stored(R.containment(_queries(spark, sf_dir), _docs(spark, sf_dir)))
    # documents come after all items, so that a group's least node is an item
    links = qrels.select(F.concat(F.lit("a"), F.lpad(F.col("query_id").cast("string"), 20, "0")).alias("a"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("b"))
    found = G.components(links).where("node like 'a%'").select(F.expr("cast(substr(node, 2) as bigint)").alias("query_id"), F.expr("cast(substr(root, 2) as bigint)").alias("root"))
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    return found.join(sizes, "root").select("query_id", "root", "size")


_SPLIT = "CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 100 < 85 THEN 'tune' ELSE 'test' END"


@query(f"""
WITH s AS (SELECT doc_id, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS k, {_SPLIT} AS split FROM documents),
h AS (SELECT DISTINCT k FROM s WHERE split <> 'train'), l AS (SELECT k FROM s GROUP BY k HAVING count(DISTINCT split) > 1)
SELECT split, count(*) AS docs, count(*) FILTER (k IN (SELECT k FROM l)) AS leaking, count(*) FILTER (split <> 'train' OR k NOT IN (SELECT k FROM h)) AS kept FROM s GROUP BY split
""".replace("\\\\", "\\"))
def q56_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each split, those whose normalised text stands in another one too, and what is left when training gives way."""
    n = T.head_number(T.digest(F.col("doc_id").cast("string"))) % 100
    split = F.when(n < 70, "train").when(n < 85, "tune").otherwise("test")
    rows = stored(_docs(spark, sf_dir).select("doc_id", T.digest(T.normalised(F.col("text"))).alias("k"), split.alias("split")))
    leaks = rows.join(E.leakage(rows, F.col("k")).select(F.col("key").alias("k")), "k", "left_semi").groupBy("split").agg(F.count("*").alias("leaking"))
    kept = E.without_leakage(rows, F.col("k")).groupBy("split").agg(F.count("*").alias("kept"))
    told = rows.groupBy("split").agg(F.count("*").alias("docs")).join(leaks, "split", "left").join(kept, "split", "left")
    return told.select("split", "docs", F.coalesce("leaking", F.lit(0)).alias("leaking"), F.coalesce("kept", F.lit(0)).alias("kept"))


_MAP = """
e AS (SELECT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b, 'contains' AS k, 1.0::DOUBLE AS w FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 's' || c_mktsegment, 'serves', count(*)::DOUBLE FROM customer GROUP BY ALL),
arcs AS (SELECT a AS source, b AS target, k, 'forward' AS d, w FROM e UNION ALL SELECT b, a, k, 'reverse', w FROM e),
t AS (SELECT source, sum(w) AS t FROM arcs GROUP BY 1), step AS (SELECT source, target, k, d, w / t AS share FROM arcs JOIN t USING (source)),
s0 AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 1.0::DOUBLE AS mass FROM region),
m1 AS (SELECT root, target, 'h1:' || d || ':' || k || ':' || target AS token, 0.65 * mass * share AS sent FROM s0 JOIN step ON source = node),
s1 AS (SELECT root, node, sum(mass) AS mass FROM (SELECT root, target AS node, sent AS mass FROM m1 UNION ALL SELECT root, root, 0.35 FROM s0) GROUP BY ALL),
m2 AS (SELECT root, target, 'h2:' || d || ':' || k || ':' || target AS token, 0.65 * mass * share AS sent FROM s1 JOIN step ON source = node),
f AS (SELECT root, 'root:' || root AS token, 1.0 AS v FROM s0 UNION ALL SELECT root, token, sent FROM m1 UNION ALL SELECT root, token, 0.7 * sent FROM m2),
h AS (SELECT root, ('0x' || substr(sha256(token), 1, 8))::UBIGINT % 64 AS slot, CASE WHEN ('0x' || substr(sha256(token), 9, 2))::UBIGINT % 2 = 1 THEN v ELSE -v END AS v FROM f),
z AS (SELECT root, slot, sum(v) AS v FROM h GROUP BY ALL)"""


def _map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    upper = table(spark, sf_dir, "nation").select(tag("r", "n_regionkey").alias("source"), tag("n", "n_nationkey").alias("target"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))
    lower = table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("double").alias("weight"))
    return upper.union(lower.select(tag("n", "c_nationkey"), tag("s", "c_mktsegment"), F.lit("serves"), "weight"))


@query(f"WITH {_MAP} SELECT root, slot::BIGINT AS slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY root)), 6) + 0.0 AS value FROM z")
def q57_relation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    made = G.relation_features(roots, _map_edges(spark, sf_dir))
    return made.select("root", "slot", (F.round("value", 6) + 0.0).alias("value"))


@query("""
WITH e AS (SELECT o_orderpriority AS kind, sha256('{"source":"c' || o_custkey || '","target":"o' || o_orderkey || '","kind":"' || o_orderpriority || '","weight":1}') AS d FROM orders),
s AS (SELECT kind, count(*) AS n_edges, """ + " || ',' || ".join(f"sum(('0x' || substr(d, {8 * i + 1}, 8))::UBIGINT)::VARCHAR" for i in range(8)) + """ AS s FROM e GROUP BY kind)
SELECT kind, n_edges, sha256(n_edges || '|' || s) AS revision FROM s
""")
def q58_graph_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = orders.select(tag("c", "o_custkey").alias("source"), tag("o", "o_orderkey").alias("target"), F.col("o_orderpriority").alias("kind"), F.lit(1).alias("weight"))
    return G.graph_revision(edges, "kind")


@query("""
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
SELECT user_id, event_id, event_type, place FROM r WHERE place <= 16
""")
def q59_recent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = RC.recent(table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", most=16)
    return told.select("user_id", "event_id", "event_type", F.col("place").cast("long").alias("place"))


@query("""
SELECT c.event_id AS call_id, EXISTS (SELECT 1 FROM events m WHERE m.event_type = 'error' AND m.user_id = c.user_id AND m.ts > c.ts AND m.ts <= c.ts + INTERVAL 6 HOUR) AS changed
FROM events c WHERE c.event_type <> 'error'
""")
def q60_context_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an error of the same user falls into the six hours after an event."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    calls = rows.where("event_type <> 'error'").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("key"), F.col("ts").alias("began"), (F.col("ts") + F.expr("interval 6 hours")).alias("ended"))
    told = RC.context_changed(calls, rows.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").alias("at")))
    return told.select("call_id", "changed")


@query(f"""
WITH {BM25}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
x AS (SELECT query_id, CASE WHEN query_id % 5 = 1 AND rank = 2 THEN -1 WHEN query_id % 5 = 2 AND rank = 3 THEN NULL ELSE doc_id END AS item, rank, CASE WHEN query_id % 5 = 3 AND rank = 4 THEN 1e9 ELSE score END AS score FROM r WHERE rank <= 10)
SELECT query_id, count(*) AS n, query_id % 5 NOT IN (1, 2, 3) AS valid FROM x GROUP BY query_id
""")
def q61_ranking_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of which some name an unknown item, none, or rise: the checks that a callback's result must pass."""
    best = stored(_best(spark, sf_dir, 10).withColumn("score", F.round("score", R.DIGITS)))
    q, rank = F.col("query_id") % 5, F.col("rank")
    item = F.when((q == 1) & (rank == 2), F.lit(-1)).when((q == 2) & (rank == 3), F.lit(None)).otherwise(F.col("doc_id"))
    rows = best.select("query_id", item.cast("long").alias("item"), F.col("rank").alias("place"), F.when((q == 3) & (rank == 4), 1e9).otherwise(F.col("score")).alias("score"))
    return RO.check_ranking(rows, best.select("query_id", F.col("doc_id").alias("item")), 10)
