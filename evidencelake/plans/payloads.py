"""Queries over portable payloads and packet chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import payloads as P
from ..sources.tables import table
from .registry import query

_STAMP = "'cs1:' || sha256({family}) || ':64:' || substr(sha256({text}), 1, 16)"


@query(f"""
WITH s AS (SELECT doc_id, {_STAMP.format(family="'meaning'", text="text")} AS a, {_STAMP.format(family="'origin'", text="source")} AS b FROM documents),
f AS (SELECT doc_id, a, b, unnest(['canonical', 'any order', 'repeated key', 'extra key', 'other format', 'more behind', 'no stamp', '8192 bytes', '8193 bytes']) AS form FROM s)
SELECT doc_id, form, form IN ('canonical', 'any order', '8192 bytes') AS accepted,
CASE WHEN form IN ('canonical', 'any order', '8192 bytes') THEN sha256('{{"format":"scqr1","views":{{"meaning":"' || a || '","origin":"' || b || '"}}}}') END AS canonical_sha256 FROM f
""")
def q82_portable_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's stamps as a payload in nine forms, read strictly and written canonically again."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    stamp = lambda family, text: F.concat(F.lit("cs1:"), F.sha2(F.lit(family), 256), F.lit(":64:"), F.substring(F.sha2(text, 256), 1, 16))
    stamped = rows.select("doc_id", stamp("meaning", F.col("text")).alias("a"), stamp("origin", F.col("source")).alias("b"))
    stamped = stamped.withColumn("whole", P.portable({"origin": F.col("b"), "meaning": F.col("a")}))
    whole = F.col("whole")
    said = lambda *parts: F.concat(*[F.col(p) if p in ("a", "b") else F.lit(p) for p in parts])
    forms = {
        "canonical": whole,
        "any order": said(' {"views": {"origin": "', "b", '", "meaning": "', "a", '"}, "format": "scqr1"} '),
        "repeated key": said('{"format":"scqr1","views":{"meaning":"', "a", '","meaning":"', "b", '"}}'),
        "extra key": said('{"format":"scqr1","views":{"meaning":"', "a", '"},"x":1}'),
        "other format": said('{"format":"scqr2","views":{"meaning":"', "a", '"}}'),
        "more behind": F.concat(whole, F.lit(" {}")),
        "no stamp": P.portable({"meaning": F.substring("a", 1, 80)}),
        **{f"{n} bytes": F.concat(whole, F.repeat(F.lit(" "), n - F.length(whole))) for n in (8192, 8193)},
    }
    given = F.explode(F.array(*[F.struct(F.lit(n).alias("form"), c.alias("payload")) for n, c in forms.items()]))
    read = stamped.select("doc_id", given.alias("g")).select("doc_id", "g.form", P.parse_portable(F.col("g.payload")).alias("views"))
    return read.select("doc_id", "form", F.col("views").isNotNull().alias("accepted"), F.sha2(P.canonical(F.col("views")), 256).alias("canonical_sha256"))


@query(r"""
WITH p AS (SELECT page_id, url, sha256(html) AS d, html FROM pages),
e AS (SELECT page_id, d, html, replace(replace('page "' || url || '" \ é' || chr(10), '\', '\\'), '"', '\"') AS s FROM p)
SELECT page_id, octet_length(encode('{"source": "' || replace(s, chr(10), '\n') || '", "sha256": "' || d || '"}' || chr(10) || html)) AS evidence_bytes,
octet_length(encode('{"revision": "r1", "sha256": "' || d || '", "source": "' || replace(replace(s, chr(10), '\n'), 'é', '\u00e9') || '"}' || chr(10))) AS header_bytes, sha256(html) AS back FROM e
""")
def q83_packet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as packet chunks under sources that need escaping, and what reading a chunk gives back."""
    rows = table(spark, sf_dir, "pages", "page_id", "url", "html")
    source, digest = F.concat(F.lit('page "'), "url", F.lit('" \\ é\n')), T.digest(F.col("html"))
    made = rows.select("page_id", source.alias("source"), digest.alias("digest"), P.evidence_chunk(source, digest, F.col("html")).alias("chunk"), P.handoff_header(source, F.lit("r1"), digest).alias("header"))
    read = made.withColumn("f", P.chunk_fields(F.col("chunk")))
    same = (F.col("f.fields")["source"] == F.col("source")) & (F.col("f.fields")["sha256"] == F.col("digest"))
    return read.select("page_id", F.octet_length("chunk").cast("long").alias("evidence_bytes"), F.octet_length("header").cast("long").alias("header_bytes"), F.when(same, F.sha2("f.text", 256)).alias("back"))


@query(r"""
WITH t AS (SELECT conv_id, turn, role, conv_id || '/' || turn AS id, sha256(text) AS d FROM conversations),
c AS (SELECT conv_id, max(turn) AS last, count(*) AS n, string_agg('["' || id || '","r' || turn || '","' || d || '"]', ',' ORDER BY id) AS sources FROM t GROUP BY 1)
SELECT c.conv_id, n AS n_sources, CASE WHEN c.conv_id % 5 <> 0 THEN sha256('{"model":"m-1","policy":"' || CASE WHEN c.conv_id % 2 = 0 THEN 'open' ELSE 'priv\u00e9' END || '","principal":"user ' || c.conv_id
|| '","prompt":"p\"1\"","request":"' || d || '","sources":[' || sources || '],"tenant":"t","tool":"none"}') END AS identity FROM c JOIN t ON t.conv_id = c.conv_id AND t.turn = c.last
""")
def q91_computation_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's answer as a computation over its turns; where the request is no digest there is no identity."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    source = F.struct(F.concat_ws("/", "conv_id", "turn").alias("id"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("revision"), T.digest(F.col("text")).alias("digest"))
    whole = turns.groupBy("conv_id").agg(F.collect_list(source).alias("sources"), F.max_by(T.digest(F.col("text")), "turn").alias("request"), F.count("*").alias("n_sources"))
    parts = {
        "tenant": F.lit("t"), "principal": F.concat(F.lit("user "), F.col("conv_id").cast("string")), "model": F.lit("m-1"), "prompt": F.lit('p"1"'), "tool": F.lit("none"),
        "policy": F.when(F.col("conv_id") % 2 == 0, "open").otherwise("privé"),
    }
    request = F.when(F.col("conv_id") % 5 == 0, F.upper("request")).otherwise(F.col("request"))
    return whole.select("conv_id", "n_sources", P.computation_identity(parts, request, F.col("sources")).alias("identity"))
