"""BM25 and its fusion with word overlap over a block index of texts: bounds before scores, lists and not pairs.

The index is made where the texts are: a task tokenises its documents and writes them as blocks of bounded size, each with
its postings by term.  No posting is shuffled.  Queries are packed into blocks of bounded size and sent to the index a
few at a time.  What leaves a task is a few rows of each query: bounds, sums, or its best documents.

best() prunes by maximum scores.  A term's largest weight in a block bounds what it adds there.  A query is first scored
in the one block whose bound is highest, which gives it a k-th score; blocks whose bound is below that are left out for
it, and in the others terms that can't lift a document over it are only looked up for documents that are still in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored
from . import blocks as B

#: Scores that agree to so many places tie, and the id decides.
DIGITS = 9
SLACK = 1e-8
#: Documents and postings of a block, at most, but for a single document of more.
BLOCK_DOCS, BLOCK_POSTINGS = 2048, 1 << 20
#: Different query terms that are sent to all tasks, at most; beyond, the index takes all terms.
MOST_TERMS = 1 << 20
#: Query terms of a pack, about, and packs that are broadcast together: some 50 MB.
PACK_TERMS, PACKS = 1 << 17, 16
WORD = re.compile(r"\w+")


def number(term: str) -> int:
    """The 64-bit hash that stands for a term, as Spark's xxhash64 gives it."""
    n = xxhash.xxh64_intdigest(term.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


@dataclass(frozen=True)
class TextIndex:
    """blocks(block, ids, dl, dn, t, n, d, tf): a row for each block; dl and dn are tokens and distinct ones of its
    documents, t its terms, n how many postings each has, d and tf the postings' places and counts, by term."""

    blocks: DataFrame
    docs: int
    tokens: int
    kind: str


def _batches(known: dict[str, int] | None, most_docs: int, most_postings: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, memo = TaskContext.get().partitionId() << 32, {}
        ids, dl, dn, t, d, tf, like = [], [], [], [], [], [], None

        def block() -> pa.RecordBatch:
            terms, place = np.array(t, np.int64), np.array(d, np.int32)
            order = np.argsort(terms, kind="stable")
            some, count = np.unique(terms, return_counts=True)
            made = [some, count.astype(np.int32), place[order], np.array(tf, np.int32)[order]]
            lists = [pa.array([x]) for x in (np.array(dl, np.int32), np.array(dn, np.int32), *made)]
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids], pa.list_(like)), *lists], names=["block", "ids", "dl", "dn", "t", "n", "d", "tf"])

        for batch in batches:
            like = batch.schema.field("id").type
            for one, value in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                tokens = WORD.findall((value.as_py() or "").lower())
                counts = Counter(tokens)
                if known is not None:
                    hits = [(known[w], counts[w]) for w in counts.keys() & known.keys()]
                else:
                    hits = [(memo.get(w) or memo.setdefault(w, number(w)), c) for w, c in counts.items()]
                    memo = memo if len(memo) < MOST_TERMS else {}
                if ids and (len(ids) >= most_docs or len(t) + len(hits) > most_postings):
                    yield block()
                    at += 1
                    ids, dl, dn, t, d, tf = [], [], [], [], [], []
                t += [h for h, _ in hits]
                tf += [c for _, c in hits]
                d += [len(ids)] * len(hits)
                ids.append(one)
                dl.append(len(tokens))
                dn.append(len(counts))
        if ids:
            yield block()

    return build


def text_index(docs: DataFrame, queries: DataFrame | None = None, *, item: str = "doc_id", text: str = "text", most_docs: int = BLOCK_DOCS, most_postings: int = BLOCK_POSTINGS) -> TextIndex:
    """The index of docs(item, text), written once; with ``queries``(text), of their terms only.

    Ids may be of any type; rows that share one are documents of their own.  A null text has no tokens.
    """
    rows = docs.select(F.col(item).alias("id"), F.col(text).alias("text"))
    known = None
    if queries is not None:
        terms = queries.select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct().limit(MOST_TERMS + 1).collect()
        known = {r["term"]: number(r["term"]) for r in terms} if len(terms) <= MOST_TERMS else None
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(shared.value, most_docs, most_postings)(batches)

    shape = f"block long, ids array<{kind}>, dl array<int>, dn array<int>, t array<long>, n array<int>, d array<int>, tf array<int>"
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores:  # a few files may be read by a single task each
        rows = rows.repartition(cores)
    blocks = stored(rows.mapInArrow(build, shape))
    size = blocks.agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda s, x: s + x)).alias("tokens")).first()
    return TextIndex(blocks, size["docs"] or 0, size["tokens"] or 0, kind)


@dataclass(frozen=True)
class Asked:
    """packs(qb, q, sizes, qt, qw, qn): queries, how many terms each has, the terms one after the other, weights, distinct words."""

    packs: DataFrame
    blocks: int
    kind: str


def asked(queries: DataFrame, index: TextIndex, *, distinct: bool = True) -> Asked:
    """The terms of queries(query_id, text) that the index has, with their weights: idf, times their count unless ``distinct``."""
    df = index.blocks.select(F.explode(F.arrays_zip("t", "n")).alias("z")).groupBy(F.col("z.t").alias("t")).agg(F.sum("z.n").alias("df"))
    listed = queries.select("query_id", T.tokens(F.col("text")).alias("w"))
    terms = listed.select("query_id", F.size(F.array_distinct("w")).alias("qn"), F.explode("w").alias("term")).groupBy("query_id", "qn", "term").agg(F.count("*").alias("times"))
    idf = F.log1p((F.lit(float(index.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf if distinct else idf * F.col("times")
    met = terms.withColumn("t", F.xxhash64("term")).join(df, "t").select("query_id", "qn", "t", weight.alias("w"))
    each = met.groupBy("query_id", "qn").agg(F.collect_list(F.struct("t", "w")).alias("m"))
    each = stored(each.select("query_id", "qn", F.col("m.t").alias("t"), F.col("m.w").alias("w")))
    blocks = max(1, -(-(each.agg(F.sum(F.size("t"))).first()[0] or 0) // PACK_TERMS))
    packs = each.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).groupBy("qb").agg(F.collect_list(F.struct("query_id", "qn", "t", "w")).alias("m"))
    sizes = F.transform("m.t", lambda x: F.size(x))
    flat = packs.select("qb", F.col("m.query_id").alias("q"), sizes.alias("sizes"), F.flatten("m.t").alias("qt"), F.flatten("m.w").alias("qw"), F.col("m.qn").alias("qn"))
    return Asked(stored(flat), blocks, queries.schema["query_id"].dataType.simpleString())


def run(index: TextIndex, ask: Asked, kernel: Callable[[dict], dict], schema: str, *, blocks: DataFrame | None = None, more: DataFrame | None = None, together: int = PACKS) -> DataFrame:
    """What ``kernel`` makes of each block of the index and each pack of queries, ``together`` packs at a time; ``more``(qb, ...) adds columns to packs."""
    out = None
    packs = ask.packs if more is None else ask.packs.join(more, "qb")
    for lo in range(0, ask.blocks, together):
        some = packs.where(F.col("qb").between(lo, lo + together - 1)) if ask.blocks > together else packs
        met = (blocks if blocks is not None else index.blocks).crossJoin(F.broadcast(some))  # some 50 MB at most
        made = B.blockwise(met, kernel, schema)
        out = made if out is None else out.union(made)
    return out


class Postings:
    """A block's postings with the BM25 weight of each, without idf."""

    def __init__(self, row: dict, docs: int, tokens: int, k1: float, b: float):
        self.size = len(row["dl"])
        self.terms, self.d, self.tf = row["t"], row["d"], row["tf"]
        self.ends = np.cumsum(row["n"])
        length = row["dl"][self.d] * (docs / max(tokens, 1))
        self.w = self.tf * (k1 + 1) / (self.tf + k1 * (1 - b + b * length))
        self.top = np.maximum.reduceat(self.w, self.ends - row["n"]) if len(self.w) else np.empty(0)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each term is in the block; -1 if it isn't."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def of(self, place: int) -> slice:
        return slice(self.ends[place - 1] if place else 0, self.ends[place])

    def bound(self, terms: np.ndarray, weights: np.ndarray) -> float:
        at = self.places(terms)
        return float((weights * np.where(at >= 0, self.top[at], 0.0)).sum()) if len(self.top) else 0.0

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, bound: float, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the documents that may be among the k best with ``bound`` or more, and how many postings were scored.

        All that tie with the k-th are given.
        """
        at = self.places(terms)
        here = at >= 0
        at, weights = at[here], weights[here]
        most = weights * self.top[at]
        order = np.argsort(-most, kind="stable")
        at, weights = at[order], weights[order]
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)  # what the terms from each one on can add
        total, seen, touched = np.zeros(self.size), np.zeros(self.size, bool), 0
        n = 0
        while n < len(at) and rest[n] >= bound - SLACK:
            where = self.of(at[n])
            total[self.d[where]] += weights[n] * self.w[where]
            seen[self.d[where]] = True
            touched += where.stop - where.start
            n += 1
        if allowed is not None:
            seen &= allowed
        left = np.flatnonzero(seen)
        while len(left):
            if len(left) > k:
                bound = max(bound, float(np.partition(total[left], -k)[-k]))
            left = left[total[left] + rest[n] >= bound - SLACK]
            if n == len(at):
                break
            where = self.of(at[n])
            place = np.searchsorted(self.d[where], left)
            place[place == where.stop - where.start] = 0
            hit = self.d[where][place] == left
            total[left[hit]] += weights[n] * self.w[where][place[hit]]
            touched += len(left)
            n += 1
        return left, total[left], touched

    def all(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of every document, and how many of the terms it has."""
        total, shared = np.zeros(self.size), np.zeros(self.size, np.int64)
        for place, weight in zip(self.places(terms).tolist(), weights.tolist(), strict=True):
            if place >= 0:
                where = self.of(place)
                total[self.d[where]] += weight * self.w[where]
                shared[self.d[where]] += 1
        return total, shared


def each_query(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number in the pack, terms, weights) of each query of a pack."""
    at = 0
    for n, size in enumerate(row["sizes"].tolist()):
        yield n, row["qt"][at : at + size], row["qw"][at : at + size]
        at += size


def column(parts: list, empty: type) -> np.ndarray | list:
    return np.concatenate(parts) if parts else np.empty(0, empty)


def pick(ids, places: np.ndarray) -> list:
    return [ids[i] for i in places.tolist()]


def eligible_places(index: TextIndex, allowed: DataFrame) -> DataFrame:
    """The index's blocks with ``may``: the places of documents in allowed(doc_id).  Blocks without any are left out.

    Ids meet ids; the postings don't move before that.
    """
    ids = index.blocks.select("block", F.posexplode("ids").alias("p", "doc_id"))
    may = ids.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("p").alias("may"))
    return index.blocks.join(may, "block")


def best(queries: DataFrame, index: TextIndex, k: int, *, k1: float = 1.5, b: float = 0.75, distinct: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): documents with a positive score that are among the k best of a query, and those that tie with the k-th.

    queries(query_id, text).  Statistics come from all documents of the index, also where only those in
    ``allowed``(doc_id) may be given.
    """
    ask, docs, tokens = asked(queries, index, distinct=distinct), index.docs, index.tokens
    blocks = index.blocks if allowed is None else stored(eligible_places(index, allowed))

    def bounds(row: dict) -> dict:
        post = Postings(row, docs, tokens, k1, b)
        return {"query_id": row["q"], "block": np.full(len(row["q"]), row["block"]), "most": np.array([post.bound(t, w) for _, t, w in each_query(row)], float)}

    def scores(row: dict) -> dict:
        post = Postings(row, docs, tokens, k1, b)
        may = None
        if "may" in row:
            may = np.zeros(post.size, bool)
            may[row["may"]] = True
        asks, ids, values = [], [], []
        only, least = dict(zip(row.get("only_q", []), row.get("only_block", []))), dict(zip(row.get("least_q", []), row.get("least", [])))
        for n, t, w in each_query(row):
            one = row["q"][n]
            if "only_q" in row and only.get(one) != row["block"]:
                continue
            at, score, _ = post.best(t, w, k, float(least.get(one, 0.0)), may)
            ok = score > 0
            asks += [one] * int(ok.sum())
            ids += pick(row["ids"], at[ok])
            values.append(score[ok])
        return {"query_id": asks, "doc_id": ids, "score": column(values, float)}

    shape = f"query_id {ask.kind}, doc_id {index.kind}, score double"
    pack = F.pmod(F.xxhash64("query_id"), F.lit(ask.blocks)).alias("qb")
    most = run(index, ask, bounds, f"query_id {ask.kind}, block long, most double", blocks=blocks)
    first = most.groupBy("query_id").agg(F.max_by("block", F.struct("most", "block")).alias("block"))
    seeds = stored(first.groupBy(pack).agg(F.collect_list("query_id").alias("only_q"), F.collect_list("block").alias("only_block")))
    tried = run(index, ask, scores, shape, blocks=blocks, more=seeds)
    least = tried.groupBy("query_id").agg(F.count("*").alias("n"), F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("least")).where(F.col("n") >= k)
    grouped = least.groupBy(pack).agg(F.collect_list("query_id").alias("least_q"), F.collect_list("least").alias("least"))
    known = stored(ask.packs.select("qb").join(grouped, "qb", "left").withColumn("least_q", F.coalesce("least_q", F.array().cast(f"array<{ask.kind}>"))).withColumn("least", F.coalesce("least", F.array().cast("array<double>"))))
    return run(index, ask, scores, shape, blocks=blocks, more=known)


def complete(lists: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best of each query with ``rank``: lists(query_id, doc_id, score) of positive scores, then documents of score 0 by id.

    A list lacks k documents at most, so the 2k smallest ids hold all that it can need.
    """
    from .retrieval import ranked

    found = stored(ranked(lists, k).select("query_id", "doc_id", "score"))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.select("query_id").join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    tail = short.crossJoin(F.broadcast(first)).join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return ranked(found.union(tail.select("query_id", "doc_id", F.lit(0.0).alias("score"))), k)


#: The scorers of a fusion: what a result calls each.
SCORERS = ("jaccard", "bm25", "fused")


def _scored(post: Postings, row: dict, n: int, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, word overlap, BM25) of the block's documents that share a term with a query."""
    total, shared = post.all(t, w)
    at = np.flatnonzero(shared)
    return at, shared[at] / (row["qn"][n] + row["dn"][at] - shared[at]), total[at]


def spreads(index: TextIndex, ask: Asked, k1: float, b: float) -> DataFrame:
    """(query_id, mj, sj, mb, sb): mean and population deviation of both scores over the documents that share a term.

    Blocks give counts, means and squares around their own means; these are put together around the common mean.
    """
    docs, tokens = index.docs, index.tokens

    def sums(row: dict) -> dict:
        post, out = Postings(row, docs, tokens, k1, b), []
        for n, t, w in each_query(row):
            at, j, s = _scored(post, row, n, t, w)
            if len(at):
                out.append((row["q"][n], len(at), j.mean(), j.var() * len(at), s.mean(), s.var() * len(at)))
        names = ("query_id", "n", "mj", "vj", "mb", "vb")
        return {name: [o[i] for o in out] for i, name in enumerate(names)} if out else dict(zip(names, ([], np.empty(0, np.int64), *[np.empty(0)] * 4)))

    parts = stored(run(index, ask, sums, f"query_id {ask.kind}, n long, mj double, vj double, mb double, vb double"))
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"a{c[-1]}")
    whole = parts.groupBy("query_id").agg(F.sum("n").alias("all"), mean("mj"), mean("mb"))
    off = lambda c: F.sqrt(F.sum(F.col(f"v{c}") + F.col("n") * F.pow(F.col(f"m{c}") - F.col(f"a{c}"), 2)) / F.any_value("all"))
    told = parts.join(whole, "query_id").groupBy("query_id").agg(F.any_value("aj").alias("mj"), off("j").alias("sj"), F.any_value("ab").alias("mb"), off("b").alias("sb"))
    return stored(told)


def _fused(row: dict, one, j: np.ndarray, s: np.ndarray, known: dict, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(overlap z-score, BM25 z-score, weighted sum) of a query's scores."""
    mj, sj, mb, sb = known[one]
    zj = (j - mj) / sj if sj > 1e-12 else np.zeros(len(j))
    zb = (s - mb) / sb if sb > 1e-12 else np.zeros(len(s))
    return zj, zb, weight * zj + (1 - weight) * zb


def _known(row: dict) -> dict:
    return dict(zip(row["k_q"], zip(row["k_mj"].tolist(), row["k_sj"].tolist(), row["k_mb"].tolist(), row["k_sb"].tolist())))


@dataclass(frozen=True)
class Fusion:
    """What lists and candidates need: the index, the packed queries, and their statistics beside the packs."""

    index: TextIndex
    ask: Asked
    stats: DataFrame
    weight: float
    k1: float
    b: float


def fusion(queries: DataFrame, index: TextIndex, *, weight: float = 0.75, k1: float = 1.5, b: float = 0.75) -> Fusion:
    """Word overlap (Jaccard) and BM25 of queries(query_id, text) over an index, fused as z-scores over the documents that share a term."""
    ask = asked(queries, index)
    pack = F.pmod(F.xxhash64("query_id"), F.lit(ask.blocks)).alias("qb")
    got = spreads(index, ask, k1, b).groupBy(pack).agg(F.collect_list(F.struct("query_id", "mj", "sj", "mb", "sb")).alias("m"))
    return Fusion(index, ask, stored(got.select("qb", F.col("m.query_id").alias("k_q"), *[F.col(f"m.{c}").alias(f"k_{c}") for c in ("mj", "sj", "mb", "sb")])), weight, k1, b)


def lists(fused: Fusion, limits: dict[str, int]) -> DataFrame:
    """(query_id, doc_id, jaccard, bm25, z_semantic, z_lexical, fused): the best documents of each query by each of the scorers in ``limits``, and more."""
    index, ask, weight, k1, b = fused.index, fused.ask, fused.weight, fused.k1, fused.b
    docs, tokens, names = index.docs, index.tokens, ("jaccard", "bm25", "z_semantic", "z_lexical", "fused")

    def tops(row: dict) -> dict:
        post, known = Postings(row, docs, tokens, k1, b), _known(row)
        asks, ids, values = [], [], {n: [] for n in names}
        for n, t, w in each_query(row):
            at, j, s = _scored(post, row, n, t, w)
            if not len(at):
                continue
            zj, zb, f = _fused(row, row["q"][n], j, s, known, weight)
            some = np.zeros(len(at), bool)
            for name, x in (("jaccard", j), ("bm25", s), ("fused", f)):
                if k := limits.get(name, 0):
                    some |= x >= (np.partition(x, -k)[-k] if len(x) > k else -np.inf) - SLACK
            asks += [row["q"][n]] * int(some.sum())
            ids += pick(row["ids"], at[some])
            for name, x in zip(names, (j, s, zj, zb, f), strict=True):
                values[name].append(x[some])
        return {"query_id": asks, "doc_id": ids, **{n: column(values[n], float) for n in names}}

    shape = f"query_id {ask.kind}, doc_id {index.kind}, " + ", ".join(f"{n} double" for n in names)
    return run(index, ask, tops, shape, more=fused.stats)


def candidates(fused: Fusion, limits: dict[str, int]) -> DataFrame:
    """lists() of the documents that are among the best of any scorer, with their places from 0 among all that share a term: r_jaccard, r_bm25, r_fused.

    How many are better is counted block by block for the candidates alone.
    """
    from .retrieval import rank_of

    index, ask, weight, k1, b = fused.index, fused.ask, fused.weight, fused.k1, fused.b
    docs, tokens = index.docs, index.tokens
    near = lists(fused, limits)
    for name in SCORERS:
        near = near.withColumn(f"in_{name}", rank_of(name) < limits.get(name, 0))
    chosen = stored(near.where(" or ".join(f"in_{n}" for n in SCORERS)).drop(*[f"in_{n}" for n in SCORERS]))
    pack = F.pmod(F.xxhash64("query_id"), F.lit(ask.blocks)).alias("qb")
    listed = chosen.groupBy(pack).agg(F.collect_list(F.struct("query_id", "doc_id", *SCORERS)).alias("m"))
    more = fused.stats.join(listed.select("qb", F.col("m.query_id").alias("c_q"), F.col("m.doc_id").alias("c_d"), *[F.col(f"m.{n}").alias(f"c_{n}") for n in SCORERS]), "qb")

    def better(row: dict) -> dict:
        post, known = Postings(row, docs, tokens, k1, b), _known(row)
        mine: dict = {}
        for i, one in enumerate(row["c_q"]):
            mine.setdefault(one, []).append(i)
        ids, asks, named, counts = np.array(row["ids"]), [], [], {n: [] for n in SCORERS}
        for n, t, w in each_query(row):
            at, j, s = _scored(post, row, n, t, w)
            here = mine.get(row["q"][n], [])
            if not len(at) or not here:
                continue
            f = _fused(row, row["q"][n], j, s, known, weight)[2]
            own = np.array(pick(row["c_d"], np.array(here)))
            asks += [row["q"][n]] * len(here)
            named += own.tolist()
            for name, x in (("jaccard", j), ("bm25", s), ("fused", f)):
                x, c = np.round(x, DIGITS), np.round(row[f"c_{name}"][here], DIGITS)
                before = (x[:, None] > c[None, :]) | ((x[:, None] == c[None, :]) & (ids[at][:, None] < own[None, :]))
                counts[name].append(before.sum(axis=0))
        return {"query_id": asks, "doc_id": named, **{f"r_{n}": column(counts[n], np.int64) for n in SCORERS}}

    shape = f"query_id {ask.kind}, doc_id {index.kind}, " + ", ".join(f"r_{n} long" for n in SCORERS)
    # a pack with its candidates is large enough to go alone
    ranks = run(index, ask, better, shape, more=more, together=1).groupBy("query_id", "doc_id").agg(*[F.sum(f"r_{n}").alias(f"r_{n}") for n in SCORERS])
    return chosen.join(ranks, ["query_id", "doc_id"])
