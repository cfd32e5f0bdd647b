"""Queries over graphs, claims, and events in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as V
from ..operators import selection as S
from ..sources.tables import table
from ..streaming import receipts as RC
from .registry import query


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))


def _chain(turns: DataFrame) -> DataFrame:
    """Each turn depends on the one before."""
    before = F.concat_ws("/", "conv_id", F.col("turn") - 1)
    return turns.where("turn > 0").select(F.col("key").alias("source"), before.alias("target"))


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, role FROM conversations),
hit AS (SELECT conv_id, turn FROM t WHERE role = 'system' UNION SELECT t.conv_id, t.turn FROM t JOIN hit ON t.conv_id = hit.conv_id AND t.turn = hit.turn + 1)
SELECT conv_id || '/' || turn AS node FROM hit
""")
def q25_invalidate_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return V.affected(turns.where("role = 'system'").select(F.col("key").alias("node")), _chain(turns))


@query("""
WITH t AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
p AS (SELECT conv_id, any_value(last) AS last, bool_and(role <> 'system') AS fine, count(*) AS n,
  sum(octet_length(encode('{"revision": "r1", "sha256": "' || sha256(text) || '", "source": "' || conv_id || '/' || turn || '"}' || chr(10) || text)) + 2) - 2 AS size FROM t GROUP BY 1),
r AS (SELECT conv_id || '/' || last AS root, CASE WHEN NOT fine THEN 'unavailable_context' WHEN size > 8192 THEN 'budget_exceeded' ELSE 'dependency_closure' END AS reason, n, size FROM p)
SELECT root, CASE WHEN reason = 'dependency_closure' THEN 'complete' ELSE 'insufficient' END AS status, reason,
CASE WHEN reason = 'dependency_closure' THEN n ELSE 0 END::BIGINT AS n_sources, CASE WHEN reason = 'dependency_closure' THEN size ELSE 0 END::BIGINT AS units FROM r
""")
def q26_handoff_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    roots = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.concat_ws("/", "conv_id", "turn").alias("root"))
    roots = roots.withColumn("node", F.col("root"))
    roles = F.when(F.col("role") == "system", F.array(F.lit("admin"))).otherwise(F.array(F.lit("admin"), F.lit("reader")))
    nodes = turns.select("key", "text", F.lit("r1").alias("revision"), roles.alias("roles"), F.lit(True).alias("current"))
    return V.handoff(roots, _chain(turns), nodes, role="reader", budget_bytes=8192)


@query("""
SELECT conv_id || '/' || turn AS key FROM conversations WHERE role <> 'system' AND ('0x' || substr(sha256(conv_id || '/' || turn), 1, 8))::UBIGINT % 5 <> 0
""")
def q27_role_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.when(F.col("role") == "system", F.array(F.lit("admin"))).otherwise(F.array(F.lit("admin"), F.lit("reader")))
    nodes = _turns(spark, sf_dir).select("key", roles.alias("roles"), F.sha2("text", 256).alias("revision"))
    moved = F.conv(F.substring(F.sha2("key", 256), 1, 8), 16, 10).cast("long") % 5 == 0
    now = nodes.select("key", F.when(moved, "newer").otherwise(F.col("revision")).alias("revision"))
    return V.visible(nodes, "reader", now).select("key")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order requires a return flag and a line status; its lines claim them, and open orders' lines claim nothing."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    joined = orders.join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    some = F.explode(F.array(F.struct(F.lit("flag").alias("requirement"), F.col("l_returnflag").alias("value")), F.struct(F.lit("status").alias("requirement"), F.col("l_linestatus").alias("value"))))
    claims = joined.select(F.col("o_orderkey").alias("request"), "o_orderstatus", F.concat(F.lit("line-"), "l_linenumber").alias("source"), some.alias("c"))
    eligible = F.col("o_orderstatus") != "P"
    return claims.select("request", "c.requirement", F.when(eligible, F.col("source")).alias("source"), F.when(eligible, F.col("c.value")).alias("value"), F.lit(40).alias("bytes"))


@query("""
WITH c AS (SELECT o_orderkey AS request, CASE WHEN o_orderstatus <> 'P' THEN l_returnflag END AS f, CASE WHEN o_orderstatus <> 'P' THEN l_linestatus END AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
g AS (SELECT request, count(DISTINCT f) AS f, count(DISTINCT s) AS s FROM c GROUP BY 1)
SELECT request, (f = 0)::BIGINT + (s = 0)::BIGINT AS n_missing, (f > 1)::BIGINT + (s > 1)::BIGINT AS n_conflicts FROM g
""")
def q31_requirement_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.requirement_state(_claims(spark, sf_dir))


@query()
def q31b_requirement_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.requirement_cover(_claims(spark, sf_dir), 2048)


@query("""
WITH e AS (SELECT user_id, event_type = 'error' AS m, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
h AS (SELECT user_id, m, max(CASE WHEN NOT m THEN n END) OVER u AS handoff, max(CASE WHEN m THEN n END) OVER u AS mine, max(CASE WHEN m THEN n END) OVER a AS anyone
      FROM e WINDOW u AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, count(*) FILTER (NOT m) AS handoffs, count(*) FILTER (m) AS mutations, count(*) FILTER (NOT m AND handoff > coalesce(mine, 0)) AS hits,
count(*) FILTER (NOT m AND handoff > coalesce(anyone, 0)) AS hits_global FROM h GROUP BY user_id
""")
def q34_receipt_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = RC.replay(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type"), F.col("event_type") == "error")
    return told.groupBy("user_id").agg(F.count_if(~F.col("m")).alias("handoffs"), F.count_if("m").alias("mutations"), F.count_if("hit_selective").alias("hits"), F.count_if("hit_global").alias("hits_global"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS m, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
h AS (SELECT event_id, m, max(CASE WHEN NOT m THEN n END) OVER u AS handoff, max(CASE WHEN m THEN n END) OVER u AS mine, max(CASE WHEN m THEN n END) OVER a AS anyone
      FROM e WINDOW u AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT 100 + event_id % 900 AS units, coalesce(handoff > coalesce(mine, 0), false) AS s, coalesce(handoff > coalesce(anyone, 0), false) AS g FROM h WHERE NOT m),
x AS (SELECT 'exact_graph' AS method, units, false AS hit, units AS moved FROM w UNION ALL SELECT 'selective_cache', units, s, CASE WHEN s THEN 32 ELSE units + 32 END FROM w
  UNION ALL SELECT 'global_cache', units, g, CASE WHEN g THEN 32 ELSE units + 32 END FROM w)
SELECT method, count(*) AS handoffs, count(*) FILTER (hit) AS hits, sum(moved)::BIGINT AS transfer, sum(units)::BIGINT AS resolved FROM x GROUP BY method
""")
def q90_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that handoffs move without receipts, under selective and under global invalidation."""
    told = RC.replay(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type"), F.col("event_type") == "error").where("not m")
    ways = {"exact_graph": F.lit(None), "selective_cache": F.col("hit_selective"), "global_cache": F.col("hit_global")}
    return RC.accounting(told, ways, 100 + F.col("event_id") % 900)


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o),
w AS (SELECT user_id, n, count(*) AS c FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(c) AS longest, sum(c)::BIGINT AS events FROM w GROUP BY user_id
""")
def q35_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = RC.sessions(table(spark, sf_dir, "events", "user_id", "ts"))
    return told.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


@query("""
SELECT sha256(event_type || '|' || props) AS identity, count(*) AS n, count(*) - 1 AS hits, (count(*) - 1) * max(octet_length(encode(props))) AS saved FROM events GROUP BY 1
""")
def q36_computation_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_type", "props")
    return RC.reuse(rows, F.sha2(F.concat_ws("|", "event_type", "props"), 256), F.octet_length("props").cast("long"))


@query()
def q37_ttl_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return RC.ttl_lru(rows.select(F.col("user_id").alias("principal"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("item")))


DIFFUSION = """
e AS (SELECT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b, 1.0::DOUBLE AS w FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 's' || c_mktsegment, count(*) FROM customer GROUP BY ALL),
arcs AS (SELECT a AS source, b AS target, w FROM e UNION ALL SELECT b, a, w FROM e),
t AS (SELECT source, sum(w) AS t FROM arcs GROUP BY 1), step AS (SELECT source, target, sum(w) / any_value(t) AS share FROM arcs JOIN t USING (source) GROUP BY ALL),
s0 AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 1.0::DOUBLE AS mass FROM region),
s1 AS (SELECT root, node, sum(mass) AS mass FROM (SELECT root, target AS node, 0.65 * mass * share AS mass FROM s0 JOIN step ON source = node UNION ALL SELECT root, root, 0.35 FROM s0) GROUP BY ALL),
s2 AS (SELECT root, node, sum(mass) AS mass FROM (SELECT root, target AS node, 0.65 * mass * share AS mass FROM s1 JOIN step ON source = node UNION ALL SELECT root, root, 0.35 FROM s0) GROUP BY ALL)"""


@query(f"WITH {DIFFUSION} SELECT root, node, round(mass, 6) AS mass FROM s2")
def q39_relation_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment")
    region = table(spark, sf_dir, "region")
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    upper = nation.select(tag("r", "n_regionkey").alias("a"), tag("n", "n_nationkey").alias("b"), F.lit(1.0).alias("weight"))
    lower = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("double").alias("weight"))
    edges = upper.union(lower.select(tag("n", "c_nationkey"), tag("s", "c_mktsegment"), "weight"))
    arcs = edges.select(F.col("a").alias("source"), F.col("b").alias("target"), "weight").union(edges.select("b", "a", "weight"))
    roots = region.select(tag("r", "r_regionkey").alias("root"))
    return V.diffusion(roots, arcs).select("root", "node", F.round("mass", 6).alias("mass"))
