"""Queries over receipts of handoffs by session, made from the events: views and clicks ask for packets, the rest change sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import sessions as S
from .registry import query

#: Events that ask for a packet, and that add an edge; others change a source.
ASKS, LINKS = ("view", "click"), ("signup",)
BOUNDS = {"most_entries": 3, "most_bytes": 1000, "seconds": 3 * 86_400.0}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six requests of two sources each for every user."""
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    asks, n = F.col("event_type").isin(*ASKS), F.col("event_id") % 6
    name = lambda kind, at: F.concat(F.lit(kind), (at % 6).cast("string"))
    versions = F.create_map(name("s", n), F.lit("r"), name("s", n + 1), F.lit("r"))
    op = F.when(asks, "issue").when(F.col("event_type").isin(*LINKS), "link").otherwise("put")
    return rows.select(
        F.col("user_id").alias("session"), "event_id", "ts", op.alias("op"), F.when(asks, name("q", n)).otherwise(name("s", n)).alias("item"),
        F.when(asks, versions).alias("versions"), F.when(asks, 100 * (n + 1)).alias("units"),
    )


@query("""
WITH RECURSIVE ev AS (SELECT user_id AS session, event_id, epoch_us(ts) AS tm, CASE WHEN event_type IN ('view', 'click') THEN 'issue' ELSE 'put' END AS op, event_id % 6 AS m,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
go AS (
  SELECT session, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS outcome, 0 AS dropped, []::STRUCT(k BIGINT, u BIGINT, e BIGINT)[] AS live FROM (SELECT DISTINCT session FROM ev)
  UNION ALL
  SELECT session, n, event_id, outcome, (had - len(live) + CASE WHEN outcome = 'issued' THEN 1 ELSE 0 END)::INT AS dropped, live FROM (
    SELECT session, n, event_id, had, outcome,
      CASE outcome WHEN 'changed' THEN alive
        WHEN 'reused' THEN list_append(list_filter(alive, lambda x: x.k <> m), list_filter(alive, lambda x: x.k = m)[1])
        ELSE list_append(list_filter(alive, lambda x, i: len(alive) - i < 2 AND list_sum(list_transform(alive[i:], lambda y: y.u)) + 100 * (m + 1) <= 1000), {'k': m, 'u': 100 * (m + 1), 'e': tm + 259200000000}) END AS live
    FROM (SELECT *, CASE WHEN op <> 'issue' THEN 'changed' WHEN list_contains(list_transform(alive, lambda x: x.k), m) THEN 'reused' ELSE 'issued' END AS outcome
      FROM (SELECT e.session, e.n, e.event_id, e.tm, e.op, e.m, len(g.live) AS had,
              list_filter(g.live, lambda x: x.e > e.tm AND NOT (e.op <> 'issue' AND (x.k = e.m OR (x.k + 1) % 6 = e.m))) AS alive
            FROM go g JOIN ev e ON e.session = g.session AND e.n = g.n + 1))))
SELECT session, event_id, outcome, dropped, len(live)::INT AS entries, coalesce(list_sum(list_transform(live, lambda x: x.u)), 0)::BIGINT AS bytes FROM go WHERE n > 0
""")
def q84_session_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.replay(_events(spark, sf_dir), **BOUNDS)
