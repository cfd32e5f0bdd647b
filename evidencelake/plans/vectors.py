"""Queries over embeddings: dense ranking, sign-bit codes, pruned exact search, redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import residual as RX
from ..operators import retrieval as R
from ..operators import selection as S
from ..operators import stamps as ST
from ..operators.lifecycle import shared
from ..operators.routing import RoutingPolicy, progressive_route
from ..sources.tables import stored, table
from .registry import query

FAMILY = ST.Family("embedding-64", 64, 64)
#: Searches ask with every row whose id is divisible by this.
EACH = 20


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def _asked(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), *columns)


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return R.dense_topk(_asked(rows, "v"), rows.select("vec_id", "v"), k)


V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
DENSE = f"""{V}, sc AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) AS score FROM v a, v b WHERE a.vec_id % {EACH} = 0 AND a.vec_id <> b.vec_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc)"""


@query(f"WITH {DENSE} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM dr WHERE rank <= 10")
def q06_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN s > 1e-12 THEN (l_extendedprice - m) / s ELSE 0 END, 3) + 0.0 AS z FROM lineitem
JOIN (SELECT l_partkey, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1) USING (l_partkey)
""")
def q07_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return R.grouped_zscore(rows, "l_extendedprice", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", (F.round("z", 3) + 0.0).alias("z"))


PLANES = "pl(bit, w) AS (VALUES " + ", ".join(f"({i}, {[float(x) for x in row]})" for i, row in enumerate(FAMILY.planes())) + ")"
CODES = f"{V}, {PLANES}, bits AS (SELECT vec_id, bit, list_dot_product(v, w::DOUBLE[]) >= 0 AS b FROM v, pl), codes AS (SELECT vec_id, list(b ORDER BY bit) AS c FROM bits GROUP BY 1)"
HAMMING = f"""{CODES}, hs AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - len(list_filter(list_zip(a.c, b.c), lambda x: x[1] <> x[2])) / 64 AS score FROM codes a, codes b WHERE a.vec_id % {EACH} = 0 AND a.vec_id <> b.vec_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM hs)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(_vectors(spark, sf_dir).select("vec_id", ST.lanes(F.col("v"), FAMILY).alias("c")))


def _hamming(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The stated query set against all codes, in blocks."""
    codes = _codes(spark, sf_dir).select("vec_id", ST.pack({"semantic": (F.col("c"), 64)}).alias("code"))
    return R.ranked(B.hamming_topk(_asked(codes, "code"), codes, k, views=[(8, 1.0)]), k, item="vec_id")


@query(f"WITH {HAMMING} SELECT query_id, vec_id, rank, score FROM hr WHERE rank <= 10")
def q18_stamp_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hamming(spark, sf_dir, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "score")


@query(f"""WITH {HAMMING}, e AS (SELECT a.query_id, a.vec_id, row_number() OVER (PARTITION BY a.query_id ORDER BY round(list_dot_product(x.v, y.v), 9) DESC, a.vec_id) AS r
  FROM hr a JOIN v x ON x.vec_id = a.query_id JOIN v y ON y.vec_id = a.vec_id WHERE rank <= 50),
sc AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) AS score FROM v a, v b WHERE a.vec_id % {EACH} = 0 AND a.vec_id <> b.vec_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc)
SELECT dr.query_id, round(count(e.vec_id) / 10, 6) AS recall FROM dr LEFT JOIN e ON e.query_id = dr.query_id AND e.vec_id = dr.vec_id AND e.r <= 10 WHERE dr.rank <= 10 GROUP BY 1""")
def q19_binary_then_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "v")
    short = shared(_hamming(spark, sf_dir, 50).select("query_id", "vec_id"))
    near = short.join(rows, "vec_id").join(_asked(rows, F.col("v").alias("q")), "query_id")
    best = R.ranked(near.select("query_id", "vec_id", B.dot("q", "v").alias("score")), 10, item="vec_id").select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = _dense(spark, sf_dir, 10).select("query_id", "vec_id")
    return exact.join(best, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / 10, 6).alias("recall"))


@query(f"""WITH {DENSE}, ag AS (SELECT query_id, max(score) FILTER (rank = 10) AS kth, max(score) FILTER (rank = 10) - max(score) FILTER (rank = 11) AS margin, list(vec_id ORDER BY rank) FILTER (rank <= 10) AS top FROM dr WHERE rank <= 11 GROUP BY 1),
{HAMMING.removeprefix(V + ', ')}, hb AS (SELECT query_id, list(vec_id ORDER BY rank) AS htop FROM hr WHERE rank <= 10 GROUP BY 1)
SELECT query_id, round(kth, 6) AS kth_score, round(margin, 6) AS margin, len(list_intersect(top, htop))::BIGINT AS shared, top = htop AS same_order FROM ag JOIN hb USING (query_id)""")
def q16_rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda frame, name: frame.where("rank <= 10").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id")))["vec_id"].alias(name))
    dense = shared(_dense(spark, sf_dir, 11))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    edges = dense.groupBy("query_id").agg(F.round(at(10), 6).alias("kth_score"), F.round(at(10) - at(11), 6).alias("margin"))
    both = top(dense, "a").join(top(_hamming(spark, sf_dir, 10), "b"), "query_id").join(edges, "query_id")
    return both.select("query_id", "kth_score", "margin", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), (F.col("a") == F.col("b")).alias("same_order"))


@query(f"""WITH {DENSE}, ag AS (SELECT query_id, max(score) FILTER (rank = 10) AS s, max(score) FILTER (rank = 10) - max(score) FILTER (rank = 11) AS m, count(*) AS n FROM dr GROUP BY 1)
SELECT CASE WHEN query_id % 200 = 0 THEN 'exact' WHEN n <= 10 THEN 'precise' WHEN s >= 0.25 AND m >= 0.002 THEN 'compact' ELSE 'precise' END AS route,
CASE WHEN query_id % 200 = 0 THEN 'authorized_exact_id' WHEN n <= 10 THEN 'compact_policy_scope_mismatch' WHEN s >= 0.25 AND m >= 0.002 THEN 'calibrated_compact_exit' ELSE 'compact_threshold_rejected' END AS reason, count(*) AS n FROM ag GROUP BY ALL""")
def q33_progressive_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _dense(spark, sf_dir, 11)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    total = table(spark, sf_dir, "embeddings", "vec_id").agg((F.count("*") - 1).alias("n_eligible"))
    cases = dense.groupBy("query_id").agg(at(10).alias("score"), (at(10) - at(11)).alias("margin")).crossJoin(F.broadcast(total))  # total is one row
    cases = cases.withColumn("exact_key", F.when(F.col("query_id") % 200 == 0, F.col("query_id"))).withColumn("exact_ok", F.lit(True))
    policy = RoutingPolicy("embeddings", 10, 0.25, 0.002, True, 0.03, 100)
    return progressive_route(cases, policy, scope="embeddings", limit=10).groupBy("route", "reason").agg(F.count("*").alias("n"))


PROFILE = ST.profile_families("embedding-64", 64)
#: Bits of the packed 256-bit code in its order, high bit first: (view, bit of the view).
PACKED = [(name, bit) for name in sorted(PROFILE) for bit in reversed(range(PROFILE[name].bits))]
WEIGHTS = {name: float(i + 1) for i, name in enumerate(sorted(PROFILE))}
_ROWS = {name: family.planes() for name, family in PROFILE.items()}
CODE256 = f"{V}, pl(pos, w) AS (VALUES " + ", ".join(f"({i}, {[float(x) for x in _ROWS[name][bit]]})" for i, (name, bit) in enumerate(PACKED)) + """),
bits AS (SELECT vec_id, pos, list_dot_product(v, w::DOUBLE[]) >= 0 AS b FROM v, pl), codes AS (SELECT vec_id, list(b::INT ORDER BY pos) AS c FROM bits GROUP BY 1)"""


def _views(vector: str) -> dict:
    """All views of the profile look at one vector here; their planes differ."""
    return {name: F.col(vector) for name in PROFILE}


def _codes256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, lanes of each view): packed into 32 bytes."""
    made = _vectors(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in ST.spherical(_views("v"), PROFILE).items()])
    return stored(made.withColumn("code", ST.pack({n: (F.col(n), f.bits) for n, f in PROFILE.items()})))


@query(f"WITH {CODE256}, s AS (SELECT a.vec_id AS query_id, b.vec_id, (" + " + ".join(
    f"{WEIGHTS[n]} * (1 - (list_sum(list_transform(list_zip(a.c[{lo + 1}:{lo + PROFILE[n].bits}], b.c[{lo + 1}:{lo + PROFILE[n].bits}]), lambda x: abs(x[1] - x[2]))) / {float(PROFILE[n].bits)}))"
    for n in sorted(PROFILE) for lo in [min(i for i, (name, _) in enumerate(PACKED) if name == n)]
) + f""") / {sum(WEIGHTS.values())} AS score FROM codes a, codes b WHERE a.vec_id % {EACH} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 5) AS score FROM r WHERE rank <= 10""")
def q20_multiview_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted agreement of the views of 256-bit codes."""
    codes = _codes256(spark, sf_dir).select("vec_id", "code")
    views = [(PROFILE[n].bits // 8, WEIGHTS[n]) for n in sorted(PROFILE)]
    best = R.ranked(B.hamming_topk(_asked(codes, "code"), codes, 10, views=views), 10, item="vec_id")
    return best.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"WITH {CODE256} SELECT vec_id, array_to_string(list_transform(range(64), lambda i: substr('0123456789abcdef', (8 * c[4 * i + 1] + 4 * c[4 * i + 2] + 2 * c[4 * i + 3] + c[4 * i + 4] + 1), 1)), '') AS code, true AS same, true AS same_text FROM codes")
def q21_pack32_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-byte codes; whether unpacking them, and the compact text form, gives the views and the code again."""
    schema = ST.schema_identity(PROFILE)
    codes = _codes256(spark, sf_dir)
    back = ST.unpack(F.col("code"), {n: f.bits for n, f in PROFILE.items()})
    same = F.lit(True)
    for n in PROFILE:
        same = same & (back[n] == F.col(n))
    text = ST.parse_payload(ST.payload(F.col("code"), schema), schema)
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), same.alias("same"), (text == F.col("code")).alias("same_text"))


@query(f"WITH {CODES}, p AS (SELECT bit, avg(b::INT) AS p FROM bits GROUP BY 1) SELECT bit::INTEGER AS bit, round(p, 6) AS p, round(CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END, 6) AS entropy FROM p")
def q44_bit_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ST.bit_entropy(_codes(spark, sf_dir), "c", 64)
    return told.select("bit", F.round("p", 6).alias("p"), F.round("entropy", 6).alias("entropy"))


@query()
def q29_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "v")
    return S.mmr(shared(_dense(spark, sf_dir, 50)).join(rows, "vec_id"))


def _residual(rows: DataFrame, asked: DataFrame, k: int, eligible: DataFrame | B.Every = B.EVERY) -> DataFrame:
    """int8 codes and residual lengths bound each product; only rows whose upper bound reaches the k-th lower bound are scored exactly."""
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    coded = rows.select("vec_id", "v", F.greatest(top / 127.0, F.lit(1e-300)).alias("scale")).withColumn("z", F.transform("v", lambda x: F.round(x / F.col("scale")).cast("tinyint")))
    gap = F.sqrt(F.aggregate(F.zip_with("v", "z", lambda x, z: x - z * F.col("scale")), F.lit(0.0), lambda a, d: a + d * d))
    index = stored(coded.select("vec_id", "z", "scale", gap.alias("gap")))
    asked = asked.withColumn("length", F.sqrt(B.dot("v", "v")))
    bounds = shared(B.residual_topk(asked, index, k, eligible=eligible))
    low = R.ranked(bounds.select("query_id", "vec_id", (F.col("mid") - F.col("slack")).alias("score")), k, item="vec_id").groupBy("query_id").agg(F.min("score").alias("floor"))
    live = bounds.join(low, "query_id").where(F.col("mid") + F.col("slack") >= F.col("floor") - 1e-9).select("query_id", "vec_id")
    exact = live.join(rows, "vec_id").join(asked.select("query_id", F.col("v").alias("q")), "query_id").select("query_id", "vec_id", B.dot("q", "v").alias("score"))
    return R.ranked(exact, k, item="vec_id")


@query(f"WITH {DENSE} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM dr WHERE rank <= 10")
def q38_residual_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_vectors(spark, sf_dir).select("vec_id", "v"))
    return RX.search(_asked(rows, "v"), RX.build(rows), rows, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {V}, c AS (SELECT i, sum(v[i]) AS s FROM v, range(1, 65) r(i) GROUP BY 1), t AS (SELECT list(s ORDER BY i) AS t, (SELECT count(*) FROM v) AS n FROM c)
SELECT vec_id, round((list_dot_product(v, t) - list_dot_product(v, v)) / (n - 1), 6) AS similarity FROM v, t""")
def q42_mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean product with all other rows, from one sum vector: linear in the rows."""
    rows = _vectors(spark, sf_dir)
    sums = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    total = sums.agg(F.array_sort(F.collect_list(F.struct("i", "s")))["s"].alias("t"))  # one row of fixed width
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n)).select("vec_id", F.round((B.dot("v", "t") - B.dot("v", "v")) / (F.col("n") - 1), 6).alias("similarity"))


@query(f"""WITH {DENSE} SELECT query_id, count(*) FILTER (score >= 0.9) AS near, round(count(*) FILTER (score >= 0.9) / count(*), 9) AS rate FROM dr GROUP BY 1""")
def q43_dup_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    n = rows.agg(F.count("*").alias("n"))

    def near(row: dict) -> dict:
        score = row["qb_v"] @ row["ib_v"].T
        score[row["qb_ids"][:, None] == row["ib_ids"][None, :]] = -1
        return {"query_id": row["qb_ids"], "near": (score >= 0.9).sum(axis=1)}

    met = B.blockwise(B.block_pairs(_asked(rows, "v"), rows.select("vec_id", "v"), ["v"], ["v"]), near, "query_id long, near long")
    got = met.groupBy("query_id").agg(F.sum("near").alias("near")).crossJoin(F.broadcast(n))  # n is one row
    return got.select("query_id", "near", F.round(F.col("near") / (F.col("n") - 1), 9).alias("rate"))


@query(f"""WITH {HAMMING}, {DENSE[DENSE.index("sc AS"):]},
al AS (SELECT 'dense' AS scorer, query_id, vec_id, score FROM sc UNION ALL SELECT 'residual', query_id, vec_id, score FROM sc UNION ALL SELECT 'hamming', query_id, vec_id, score FROM hs),
ra AS (SELECT *, row_number() OVER (PARTITION BY scorer, query_id ORDER BY round(score, 9) DESC, 'v' || vec_id) AS rank FROM al WHERE abs(vec_id // 50 - query_id // 50) <= 2)
SELECT scorer, 'v' || query_id AS query_id, 'v' || vec_id AS vec_id, rank, round(score, 6) AS score FROM ra WHERE rank <= 10""")
def q87_eligible_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, residual and binary search among the rows that each query may be given: those of five neighbouring shelves of fifty.  Ids are texts."""
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    rows = stored(_vectors(spark, sf_dir).select(name.alias("vec_id"), "v", F.expr("vec_id div 50").alias("shelf"), (F.col("vec_id") % EACH == 0).alias("asks")))
    asks = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v", "shelf")
    near = asks.select("query_id", F.explode(F.sequence(F.col("shelf") - 2, F.col("shelf") + 2)).alias("shelf"))
    eligible = stored(near.join(rows.select("vec_id", "shelf"), "shelf").select("query_id", "vec_id"))
    given, asked = rows.select("vec_id", "v"), asks.select("query_id", "v")
    codes = stored(rows.select("vec_id", ST.pack({"semantic": (ST.lanes(F.col("v"), FAMILY), 64)}).alias("code"), "asks"))
    coded = codes.where("asks").select(F.col("vec_id").alias("query_id"), "code")
    found = {
        "dense": R.dense_topk(asked, given, 10, eligible=eligible),
        "residual": _residual(given, asked, 10, eligible),
        "hamming": R.ranked(B.hamming_topk(coded, codes.select("vec_id", "code"), 10, views=[(8, 1.0)], eligible=eligible), 10, item="vec_id"),
    }
    out = None
    for scorer, part in found.items():
        part = part.select(F.lit(scorer).alias("scorer"), "query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))
        out = part if out is None else out.union(part)
    return out
