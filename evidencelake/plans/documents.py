"""Queries over documents and the benchmark: text features, BM25, fusion, metrics, facets and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import facets as FA
from ..operators import learning as L
from ..operators import lexical as X
from ..operators import payloads as P
from ..operators import retrieval as R
from ..operators import selection as S
from ..operators.lifecycle import shared
from ..sources.tables import stored, table
from .registry import query

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best documents of each item by BM25."""
    queries = _queries(spark, sf_dir)
    return R.ranked(X.best(queries, X.text_index(_docs(spark, sf_dir), queries), k), k)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


@query("""
SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER w AS duplicate_of, count(*) OVER w AS copies
FROM documents WINDOW w AS (PARTITION BY text)
""")
def q01_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _docs(spark, sf_dir).select("doc_id", T.digest(F.col("text")).alias("digest"))
    groups = marked.groupBy("digest").agg(F.min("doc_id").alias("duplicate_of"), F.count("*").alias("copies"))
    return marked.join(groups, "digest").select("doc_id", "digest", "duplicate_of", "copies")


@query(f"""
WITH t AS (SELECT lang, {TOKENS} AS w, octet_length(encode(text)) AS b FROM documents)
SELECT lang, count(*) AS docs, sum(len(w))::BIGINT AS tokens, sum(len(list_distinct(w)))::BIGINT AS words, sum(b)::BIGINT AS bytes FROM t GROUP BY lang
""")
def q02_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "documents", "lang", "text").select("lang", T.tokens(F.col("text")).alias("w"), F.octet_length("text").alias("b"))
    size = F.size(F.array_distinct("w"))
    return listed.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size("w")).alias("tokens"), F.sum(size).alias("words"), F.sum("b").alias("bytes"))


@query("""
WITH b AS (SELECT doc_id, ('0x' || substr(sha256(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')), 1, 8))::UBIGINT % 100 AS n FROM documents)
SELECT CASE WHEN n < 70 THEN 'train' WHEN n < 80 THEN 'tune' WHEN n < 90 THEN 'calibration' ELSE 'test' END AS split, count(*) AS docs, count(DISTINCT n) AS buckets FROM b GROUP BY 1
""".replace("\\\\", "\\"))
def q04_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = T.bucket(F.col("text"))
    return _docs(spark, sf_dir).select(bucket.alias("n")).groupBy(T.split_of(F.col("n")).alias("split")).agg(F.count("*").alias("docs"), F.count_distinct("n").alias("buckets"))


BM25 = f"""
d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM q JOIN p USING (term) JOIN f USING (term), stat GROUP BY ALL)"""


@query(f"""
WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def q05_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir, 10)
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""
WITH docs AS (SELECT lang || '/' || doc_id AS doc_id, text FROM documents), asks AS (SELECT 'item ' || item_id AS item_id, text FROM benchmark UNION ALL VALUES ('nothing', 'zzqx-unheard'), ('little', 'zzqx scheme'), ('empty', '')),
{BM25.replace("FROM documents", "FROM docs").replace("FROM benchmark", "FROM asks")},
whole AS (SELECT item_id AS query_id, docs.doc_id, coalesce(score, 0) AS score FROM asks CROSS JOIN docs LEFT JOIN bm ON bm.query_id = item_id AND bm.doc_id = docs.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM whole)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def q85_complete_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents for every query, known by texts of their own: those without a shared term score 0 and come by id."""
    asks = _queries(spark, sf_dir).withColumn("query_id", F.concat(F.lit("item "), "query_id"))
    more = spark.createDataFrame([("nothing", "zzqx-unheard"), ("little", "zzqx scheme"), ("empty", "")], "query_id string, text string")
    asks = asks.unionByName(more)
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").select(F.concat_ws("/", "lang", "doc_id").alias("doc_id"), "text")
    best = X.complete(X.best(asks, X.text_index(docs, asks), 10), asks, docs, 10)
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _fusion(spark: SparkSession, sf_dir: str) -> X.Fusion:
    queries = _queries(spark, sf_dir)
    return X.fusion(queries, X.text_index(_docs(spark, sf_dir), queries))


BOTH = f"""{BM25},
qn AS (SELECT query_id, count(*) AS qn FROM q GROUP BY 1), dn AS (SELECT doc_id, len(list_distinct(t)) AS dn FROM d),
sh AS (SELECT query_id, doc_id, count(*) AS shared FROM q JOIN p USING (term) GROUP BY ALL),
two AS (SELECT query_id, doc_id, score AS bm25, shared / (qn + dn - shared) AS jaccard FROM bm JOIN sh USING (query_id, doc_id) JOIN qn USING (query_id) JOIN dn USING (doc_id)),
st AS (SELECT query_id, avg(bm25) AS mb, stddev_pop(bm25) AS sb, avg(jaccard) AS mj, stddev_pop(jaccard) AS sj FROM two GROUP BY 1),
z AS (SELECT query_id, doc_id, bm25, jaccard, CASE WHEN sj > 1e-12 THEN (jaccard - mj) / sj ELSE 0 END AS zs, CASE WHEN sb > 1e-12 THEN (bm25 - mb) / sb ELSE 0 END AS zl FROM two JOIN st USING (query_id)),
fu AS (SELECT *, 0.75 * zs + 0.25 * zl AS fused FROM z),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(jaccard, 9) DESC, doc_id) - 1 AS rs,
              row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) - 1 AS rl,
              row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, doc_id) - 1 AS rf FROM fu)"""


@query(f"""
WITH {BM25}, qw AS (SELECT item_id AS query_id, list_distinct({TOKENS}) AS qw FROM benchmark),
b AS (SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
o AS (SELECT query_id, doc_id, score, qw, list_distinct(t) AS dw, bytes FROM r JOIN d USING (doc_id) JOIN qw USING (query_id) JOIN b USING (doc_id) WHERE rank <= 10)
SELECT query_id, doc_id, round(len(list_intersect(qw, dw)) / greatest(len(qw), 1), 6) AS recall,
       round(len(list_intersect(qw, dw)) / (len(qw) + len(dw) - len(list_intersect(qw, dw))), 6) AS jaccard, round(score, 6) AS base,
       round(least(bytes / 65536, 1.0), 6) AS size_share, CASE WHEN len(list_intersect(qw, dw)) = len(qw) AND len(qw) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS full_cover
FROM o
""")
def q03_lexical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = _queries(spark, sf_dir), _docs(spark, sf_dir)
    best = shared(_best(spark, sf_dir, 10).select("query_id", "doc_id", "score"))
    texts = docs.select("doc_id", T.words(F.col("text")).alias("dw"), F.octet_length("text").alias("bytes"))
    near = best.join(texts, "doc_id").join(queries.select("query_id", T.words(F.col("text")).alias("qw")), "query_id")
    made = T.lexical_features(F.col("qw"), F.col("dw"), F.col("score"), F.col("bytes"))
    return near.select("query_id", "doc_id", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query(f"WITH {BOTH} SELECT query_id, doc_id, (rf + 1)::BIGINT AS rank, round(fused, 6) AS fused FROM rk WHERE rf < 10")
def q08_hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.ranked(X.lists(_fusion(spark, sf_dir), {"fused": 10}), 10, score="fused")
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("fused", 6).alias("fused"))


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidate_features(X.candidates(_fusion(spark, sf_dir), {"jaccard": 96, "bm25": 96, "fused": 64}))


UNION = f"{BOTH}, un AS (SELECT * FROM rk WHERE rs < 96 OR rl < 96 OR rf < 64)"


@query(f"""WITH {UNION} SELECT query_id, doc_id, round(jaccard, 6) AS f1, round(zs, 6) AS f2, round(fused, 6) AS f3, round(zl, 6) AS f4,
round(1 / (1 + rs), 6) AS f5, round(1 / (1 + rl), 6) AS f6 FROM un""")
def q09_candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir).select("query_id", "doc_id", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(1, 7)])


ROUTE = ", ".join(
    f"round(max({x}), 6) AS {n}_top, round(max({x}) - coalesce(max({x}) FILTER ({r} = 1), max({x})), 6) AS {n}_lead, "
    f"round(max({x}) - coalesce(max({x}) FILTER ({r} = 9), max({x})), 6) AS {n}_tenth, round(stddev_pop({x}), 6) AS {n}_spread"
    for n, x, r in (("semantic", "jaccard", "rs"), ("fused", "fused", "rf"), ("lexical", "bm25", "rl"))
)


@query(f"""WITH {UNION} SELECT query_id, round(count(*) / 256, 6) AS size_share, round(count(*) FILTER (rs < 10 AND rl < 10) / 10, 6) AS agreement, {ROUTE} FROM un GROUP BY query_id""")
def q10_route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = []
    for name, value, rank in (("semantic", "f1", "r_sem"), ("fused", "f3", "r_fused"), ("lexical", "bm25", "r_lex")):
        top = F.max(value)
        at = lambda place, value=value, rank=rank, top=top: F.coalesce(F.max(F.when(F.col(rank) == place, F.col(value))), top)
        made += [F.round(top, 6).alias(f"{name}_top"), F.round(top - at(1), 6).alias(f"{name}_lead"), F.round(top - at(9), 6).alias(f"{name}_tenth"), F.round(F.stddev_pop(value), 6).alias(f"{name}_spread")]
    union = _union(spark, sf_dir)
    shared_top = F.count_if((F.col("r_sem") < 10) & (F.col("r_lex") < 10)) / 10
    return union.groupBy("query_id").agg(F.round(F.count("*") / 256, 6).alias("size_share"), F.round(shared_top, 6).alias("agreement"), *made)


QRELS = "qr AS (SELECT item_id AS query_id, doc_id, 1 AS gain FROM benchmark b, documents d WHERE contains(d.text, b.text))"
METRICS = f"""{BOTH}, {QRELS},
runs AS (SELECT 'semantic' AS method, query_id, doc_id, rs + 1 AS rank FROM rk WHERE rs < 10 UNION ALL SELECT 'lexical', query_id, doc_id, rl + 1 FROM rk WHERE rl < 10
         UNION ALL SELECT 'fused', query_id, doc_id, rf + 1 FROM rk WHERE rf < 10),
ideal AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) END) AS ideal, count(*) AS n_rel FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id) AS r FROM qr) GROUP BY 1),
hit AS (SELECT method, query_id, sum(1 / log2(rank + 1)) AS dcg, count(*) AS n, min(rank) AS first FROM runs JOIN qr USING (query_id, doc_id) GROUP BY ALL),
mt AS (SELECT method, query_id, coalesce(dcg / ideal, 0) AS ndcg, coalesce(n / n_rel, 0) AS recall, coalesce(1 / first, 0) AS mrr
       FROM (SELECT DISTINCT method FROM runs) CROSS JOIN ideal LEFT JOIN hit USING (method, query_id))"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = shared(X.lists(_fusion(spark, sf_dir), {"jaccard": 10, "bm25": 10, "fused": 10}))
    runs = None
    for method, score in (("semantic", "jaccard"), ("lexical", "bm25"), ("fused", "fused")):
        run = R.ranked(fused, 10, score=score).select(F.lit(method).alias("method"), "query_id", "doc_id", "rank")
        runs = run if runs is None else runs.union(run)
    qrels = R.containment(_queries(spark, sf_dir), _docs(spark, sf_dir)).withColumn("gain", F.lit(1))
    return E.metrics(shared(runs), shared(qrels))


@query(f"WITH {METRICS} SELECT method, query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM mt")
def q11_ndcg_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("method", "query_id", *[F.round(m, 6).alias(m) for m in ("ndcg", "recall", "mrr")])


@query(f"""WITH {UNION}, {QRELS} SELECT query_id, count(*) AS relevant, count(un.doc_id) AS found, round(count(un.doc_id) / count(*), 6) AS recall FROM qr LEFT JOIN un USING (query_id, doc_id) GROUP BY query_id""")
def q12_oracle_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = R.containment(_queries(spark, sf_dir), _docs(spark, sf_dir))
    got = qrels.join(_union(spark, sf_dir).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return got.groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query(f"""WITH {METRICS}, b AS (SELECT query_id, ndcg AS b FROM mt WHERE method = 'lexical')
SELECT method, count(*) AS n_queries, round(avg(ndcg), 6) AS mean, round(quantile_cont(ndcg, 0.5), 6) AS median, round(quantile_cont(ndcg, 0.95), 6) AS p95,
count(*) FILTER (ndcg - b > 1e-12) AS wins, count(*) FILTER (abs(ndcg - b) <= 1e-12) AS ties, count(*) FILTER (ndcg - b < -1e-12) AS losses FROM mt JOIN b USING (query_id) GROUP BY method""")
def q13_method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = E.summary(shared(_metrics(spark, sf_dir)), "lexical")
    return told.select("method", "n_queries", *[F.round(m, 6).alias(m) for m in ("mean", "median", "p95")], "wins", "ties", "losses")


@query(f"""WITH {BOTH}, {QRELS} SELECT query_id, count(*) AS positives, round(max(coalesce(jaccard, 0)), 6) AS most_overlap, max(coalesce(jaccard, 0)) <= 0.1 AS low_overlap
FROM qr LEFT JOIN two USING (query_id, doc_id) GROUP BY query_id""")
def q14_low_overlap_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = R.containment(_queries(spark, sf_dir), _docs(spark, sf_dir))
    words = lambda frame, key, name: frame.select(key, T.words(F.col("text")).alias(name))
    met = qrels.join(words(_queries(spark, sf_dir), "query_id", "qw"), "query_id").join(words(_docs(spark, sf_dir), "doc_id", "dw"), "doc_id")
    near = met.withColumn("j", T.jaccard(F.col("qw"), F.col("dw")))
    most = F.max("j")
    return near.groupBy("query_id").agg(F.count("*").alias("positives"), F.round(most, 6).alias("most_overlap"), (most <= 0.1).alias("low_overlap"))


@query()
def q15_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = shared(_metrics(spark, sf_dir))
    base = scored.where("method = 'lexical'").select("query_id", F.col("ndcg").alias("b"))
    deltas = scored.where("method <> 'lexical'").join(base, "query_id").select("method", "query_id", (F.col("ndcg") - F.col("b")).alias("delta"))
    return E.scope_certificate(E.poisson_bootstrap(deltas, by="method", value="delta", key="query_id"))


HASHED = r"""m AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]') AS m FROM documents),
f AS (SELECT doc_id, unnest(list_concat(list_transform(m, lambda x: 't:' || x), list_transform(list_zip(m[:-2], m[2:]), lambda x: 'b:' || x[1] || chr(0) || x[2]))) AS f FROM m),
h AS (SELECT doc_id, sha256(f) AS h FROM f),
s AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::UBIGINT % 384 AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 2))::UBIGINT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL)"""


@query(f"WITH {HASHED}, n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM s GROUP BY 1) SELECT doc_id, slot::BIGINT AS slot, round(v / n, 6) AS value FROM s JOIN n USING (doc_id) WHERE v <> 0")
def q80_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hash_vectors(_docs(spark, sf_dir)).select("doc_id", "slot", F.round("value", 6).alias("value"))


@query(f"WITH {HASHED} SELECT doc_id, count(*) FILTER (v <> 0) AS slots, sum(v * v)::BIGINT AS square, sum(abs(v))::BIGINT AS mass FROM s GROUP BY doc_id")
def q17_hash_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _docs(spark, sf_dir).select("doc_id", F.explode(T.hashed_features(F.col("text"))).alias("f"))
    slot, sign = T.slot_and_sign(F.col("f"), 384)
    sums = features.select("doc_id", slot.alias("slot"), sign.alias("sign")).groupBy("doc_id", "slot").agg(F.sum("sign").alias("v"))
    return sums.groupBy("doc_id").agg(F.count_if(F.col("v") != 0).alias("slots"), F.sum(F.col("v") * F.col("v")).alias("square"), F.sum(F.abs("v")).alias("mass"))


@query(f"""
WITH RECURSIVE {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
c AS (SELECT query_id, rank, doc_id, sha256(text) AS digest, octet_length(encode('{{"source": "' || doc_id || '", "sha256": "' || sha256(text) || '"}}' || chr(10) || text)) AS bytes
      FROM r JOIN documents USING (doc_id) WHERE rank <= 10),
go AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, []::VARCHAR[] AS seen, '' AS reason, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL SELECT c.query_id, c.rank, CASE WHEN list_contains(seen, digest) OR used + bytes + CASE WHEN used > 0 THEN 2 ELSE 0 END > 4096 THEN used ELSE used + bytes + CASE WHEN used > 0 THEN 2 ELSE 0 END END,
    CASE WHEN list_contains(seen, digest) OR used + bytes + CASE WHEN used > 0 THEN 2 ELSE 0 END > 4096 THEN seen ELSE list_append(seen, digest) END,
    CASE WHEN list_contains(seen, digest) THEN 'exact_duplicate' WHEN used + bytes + CASE WHEN used > 0 THEN 2 ELSE 0 END > 4096 THEN 'budget' ELSE 'selected' END, c.doc_id
  FROM go JOIN c ON c.query_id = go.query_id AND c.rank = go.rank + 1)
SELECT query_id, rank, doc_id AS source, reason, (max(used) OVER (PARTITION BY query_id))::BIGINT AS units FROM go WHERE rank > 0
""")
def q28_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    best = _best(spark, sf_dir, 10).select("query_id", "rank", "doc_id")
    digest = T.digest(F.col("text"))
    chunk = P.evidence_chunk(F.col("doc_id").cast("string"), digest, F.col("text"))
    sized = docs.select("doc_id", digest.alias("digest"), F.octet_length(chunk).alias("bytes"))
    ready = shared(best).join(sized, "doc_id").select("query_id", "rank", F.col("doc_id").alias("source"), "digest", F.lit("").alias("dependencies"), F.lit("unchecked").alias("freshness"), "bytes")
    return S.pack_budget(ready, 4096).withColumn("rank", F.col("rank").cast("long"))


@query()
def q30_coverage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = _queries(spark, sf_dir), _docs(spark, sf_dir)
    best = shared(_best(spark, sf_dir, 50).select("query_id", "rank", "doc_id", "score"))
    texts = docs.select("doc_id", T.words(F.col("text")).alias("words"))
    lists = best.join(texts, "doc_id").join(queries.select("query_id", T.words(F.col("text")).alias("query_words")), "query_id")
    return S.coverage_select(lists)


_ENT = FA.ENTITY.replace("'", "''")
#: Values in order, joined while the whole stays within the bound, and "open" until one didn't fit.
_FOLD = "list_reduce(list_prepend({{'t': '', 'o': true}}, list_transform({values}, lambda x: {{'t': x, 'o': true}})), lambda a, x: {{'t': CASE WHEN a.o AND octet_length(encode(CASE WHEN a.t = '' THEN x.t ELSE a.t || ', ' || x.t END)) <= 512 THEN CASE WHEN a.t = '' THEN x.t ELSE a.t || ', ' || x.t END ELSE a.t END, 'o': a.o AND octet_length(encode(CASE WHEN a.t = '' THEN x.t ELSE a.t || ', ' || x.t END)) <= 512}}).t"
_BY_NAME = "list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(t, '{pattern}')), lambda x: {{'low': lower(x), 'x': x}})), lambda s: s.x)"


@query("WITH p AS (SELECT doc_id, text AS t, lower(text) AS l FROM documents UNION ALL SELECT -1 - page_id, html, lower(html) FROM pages) SELECT doc_id, "
    + "nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(l, '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{w}' END" for w in FA.INTENTS) + "], lambda x: x IS NOT NULL), ', '), '') AS task, "
    + "nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(l, '{w}') THEN '{w}' END" for w in FA.RELATIONS) + "], lambda x: x IS NOT NULL), ', '), '') AS relation, "
    + f"nullif({_FOLD.format(values=_BY_NAME.format(pattern=FA.VERSION))}, '') AS temporal, nullif({_FOLD.format(values=_BY_NAME.format(pattern=_ENT))}, '') AS entity FROM p")
def q40_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    made = FA.facets(F.col("text"))
    return _docs(spark, sf_dir).unionByName(pages).select("doc_id", *[c.alias(n) for n, c in made.items()])


@query("WITH d AS (SELECT doc_id, lower(text) AS l, source, lang FROM documents WHERE regexp_matches(text, '\\S')), r AS (SELECT doc_id, source, lang, "
    + "nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(l, '{w}') THEN '{w}' END" for w in FA.RELATIONS) + "], lambda x: x IS NOT NULL), ', '), '') AS relation FROM d) "
    + """SELECT doc_id, CASE WHEN relation IS NULL THEN source ELSE relation || ', ' || source END AS relation, CASE WHEN relation IS NULL THEN 'asserted-v1' ELSE 'combined-v1' END AS rule, lang AS authority
FROM r WHERE doc_id % 4 <> 0""")
def q81_compiled_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of documents whose host asserts a workflow and an authority; those that it calls a hologram don't compile."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    modality = F.when(F.col("doc_id") % 4 == 0, "hologram").otherwise("text")
    said = F.create_map(F.lit("workflow"), "source", F.lit("authority"), "lang", F.lit("modality"), modality)
    made = rows.select("doc_id", FA.compiled(F.col("text"), said).alias("f")).where("f is not null")
    return made.select("doc_id", F.col("f.relation.value").alias("relation"), F.col("f.relation.rule").alias("rule"), F.col("f.authority.value").alias("authority"))


@query(f"""WITH {BM25}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' AND score >= 1.0)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def q41_constrained_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    allowed = docs.where("lang = 'en'").select("doc_id")
    queries = _queries(spark, sf_dir)
    scored = X.best(queries, X.text_index(docs, queries), 5, allowed=allowed)
    return R.ranked(scored.where("score >= 1.0"), 5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.words(F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), F.size(words).alias("w"), F.octet_length("text").alias("b"))
    return rows.join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id").select(
        "doc_id", F.lit(1.0).alias("x0"), F.log1p(F.col("n").cast("double")).alias("x1"), (F.col("w") / F.greatest("n", F.lit(1))).alias("x2"), F.least(F.col("b") / 65536.0, F.lit(1.0)).alias("x3"), F.col("quality").cast("double").alias("y")
    )


LABELLED = f"""
t AS (SELECT doc_id, {TOKENS} AS t, octet_length(encode(text)) AS b FROM documents),
x AS (SELECT doc_id, 1.0::DOUBLE AS x0, ln(1 + len(t)) AS x1, len(list_distinct(t)) / greatest(len(t), 1) AS x2, least(b / 65536, 1.0) AS x3, quality::DOUBLE AS y FROM t JOIN labels USING (doc_id))"""


@query(f"WITH {LABELLED} SELECT doc_id, round(1 / (1 + exp(-(0.5 + 0.2 * x1 - 1.5 * x2 + 0.7 * x3))), 6) AS score FROM x")
def q45_logistic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = L.sigmoid([F.col("x1"), F.col("x2"), F.col("x3")], [0.2, -1.5, 0.7], 0.5)
    return _labelled(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"))


@query(f"WITH {LABELLED} SELECT count(*) AS n, round(sum(y), 4) AS y, " + ", ".join(f"round(sum(x{i} * x{j}), 4) AS xx_{i}_{j}" for i in range(4) for j in range(i, 4)) + ", " + ", ".join(f"round(sum(x{i} * y), 4) AS xy_{i}" for i in range(4)) + " FROM x")
def q46_ridge_normal_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = L.normal_equations(_labelled(spark, sf_dir), ["x0", "x1", "x2", "x3"], "y")
    return sums.select("n", *[F.round(c, 4).alias(c) for c in sums.columns if c != "n"])


@query(f"""WITH {LABELLED}, g AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS minimum_score), s AS (SELECT 1 / (1 + exp(-(0.5 + 0.2 * x1 - 1.5 * x2 + 0.7 * x3))) AS score, x2 AS margin, y = 1 AS correct FROM x)
SELECT minimum_score::DOUBLE AS minimum_score, minimum_margin::DOUBLE AS minimum_margin, count(*) FILTER (score >= minimum_score AND margin >= minimum_margin) AS accepted,
count(*) FILTER (score >= minimum_score AND margin >= minimum_margin AND NOT correct) AS errors FROM s, g, (SELECT unnest([0.0, 0.3, 0.6]) AS minimum_margin) GROUP BY ALL""")
def q32_policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = L.sigmoid([F.col("x1"), F.col("x2"), F.col("x3")], [0.2, -1.5, 0.7], 0.5)
    cases = _labelled(spark, sf_dir).select(score.alias("score"), F.col("x2").alias("margin"), (F.col("y") == 1).alias("correct"))
    return E.policy_grid(cases, [0.2, 0.4, 0.6, 0.8], [0.0, 0.3, 0.6])


@query("""
WITH r AS (SELECT doc_id, sha256(text) AS digest, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 10 AS b FROM documents),
s AS (SELECT doc_id AS source, CASE WHEN b = 0 THEN 'invalidated' WHEN b = 1 THEN 'unknown_version' WHEN b = 2 THEN 'stale_version' ELSE 'current' END AS freshness FROM r)
SELECT * FROM s
""")
def q22_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import lifecycle as V

    b = T.head_number(T.digest(F.col("doc_id").cast("string"))) % 10
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("source"), T.digest(F.col("text")).alias("digest"), (b == 0).alias("stale"), b.alias("b"))
    revisions = rows.where("b <> 1").select("source", F.when(F.col("b") == 2, "changed").otherwise(F.col("digest")).alias("revision"))
    return V.freshness(rows.select("source", "digest", "stale"), revisions).select("source", "freshness")


@query("""
WITH r AS (SELECT doc_id, source, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 10 AS b FROM documents)
SELECT source, count(*) FILTER (b = 1) AS n_missing, count(*) FILTER (b = 2) AS n_changed,
CASE WHEN count(*) FILTER (b = 2) > 0 THEN 'stale' WHEN count(*) FILTER (b = 1) > 0 THEN 'unknown' ELSE 'current' END AS status FROM r GROUP BY source
""")
def q23_version_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import lifecycle as V

    b = T.head_number(T.digest(F.col("doc_id").cast("string"))) % 10
    rows = table(spark, sf_dir, "documents", "doc_id", "source", "text").select("source", F.col("doc_id").alias("dependency"), T.digest(F.col("text")).alias("expected"), b.alias("b"))
    revisions = rows.where("b <> 1").select(F.col("dependency").alias("source"), F.when(F.col("b") == 2, "changed").otherwise(F.col("expected")).alias("revision"))
    return V.explain_versions(rows, revisions)


@query("""
WITH r AS (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 10 AS b FROM documents)
SELECT CASE WHEN b = 0 THEN 'kept' WHEN b = 1 THEN 'added' WHEN b = 2 THEN 'updated' WHEN b = 3 THEN 'refreshed' ELSE 'unchanged' END AS status, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM r GROUP BY 1
""")
def q24_upsert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import lifecycle as V

    b = T.head_number(T.digest(F.col("doc_id").cast("string"))) % 10
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("source"), T.digest(F.col("text")).alias("digest"), b.alias("b"))
    old = rows.where("b <> 1").select("source", F.when(F.col("b") == 2, "old").otherwise(F.col("digest")).alias("digest"), (F.col("b") == 3).alias("stale"))
    new = rows.where("b <> 0").select("source", "digest", F.lit(False).alias("stale"))
    return V.upsert_status(old, new).groupBy("status").agg(F.count("*").alias("n"), F.sum("source").alias("ids"))
