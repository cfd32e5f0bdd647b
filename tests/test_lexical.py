"""BM25 over the block index, its pruning, and the fusion, against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from evidencelake.operators import lexical, retrieval
from evidencelake.sources import tables


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_bm25(queries, docs):
    """{query: [(row, score, shared, distinct words of the document)]} of the rows that share a term."""
    made = [Counter(tokens(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in made]
    mean, df, out = sum(sizes) / max(1, len(docs)), Counter(w for c in made for w in c), {}
    for q, text in queries:
        rows = []
        for i, c in enumerate(made):
            hit = [w for w in set(tokens(text)) if w in c]
            score = sum(math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sizes[i] / mean)) for w in hit)
            if hit:
                rows.append((i, score, len(hit), len(c)))
        out[q] = rows
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    stock = [f"w{i}" for i in range(120)] + ["Ünï", "中文", "x_y"]
    weights = [1 / (i + 1) for i in range(len(stock))]
    docs = [(f"dir/{i:03d}.md", " ".join(rng.choices(stock, weights, k=rng.choice([0, 3, 20, 80])))) for i in range(n)]
    docs += [("twice", "w1 w100"), ("twice", "w1 w100 w100"), ("null", None), ("é", "中文, ünï")]
    queries = [(f"q{i}", " ".join(rng.choices(stock, k=6))) for i in range(12)] + [("none", "unheard of"), ("empty", ""), ("null", None), ("rare", "w119 w119 w0")]
    return queries, docs


def frames(spark, queries, docs):
    return spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(docs, "doc_id string, text string").repartition(3)


@pytest.mark.parametrize("bounded", [True, False])
def test_complete_lists_equal_plain_loops(spark, bounded, monkeypatch):
    queries, docs = corpus(1)
    if not bounded:
        monkeypatch.setattr(lexical, "PACK_TERMS", 4)  # more packs than go together
    q, d = frames(spark, queries, docs)
    index = lexical.text_index(d, q if bounded else None, most_docs=40, most_postings=300)
    assert index.blocks.count() > 7 and index.blocks.selectExpr("max(size(ids))").first()[0] <= 40
    got = defaultdict(list)
    for r in lexical.complete(lexical.best(q, index, 10), q, d, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
    for one, rows in plain_bm25(queries, docs).items():
        score = Counter({i: s for i, s, *_ in rows})
        order = sorted(range(len(docs)), key=lambda i: (-round(score[i], 9), docs[i][0]))[:10]
        # rows that share an id and a score are told apart by nothing
        assert got[one] == [(docs[i][0], round(score[i], 6)) for i in order]


def test_allowed_documents_and_no_rows(spark):
    queries, docs = corpus(2)
    q, d = frames(spark, queries, docs)
    allowed = {i for i, (n, _) in enumerate(docs) if n.endswith(("1.md", "5.md"))}
    may = spark.createDataFrame([(docs[i][0],) for i in allowed], "doc_id string")
    got = retrieval.ranked(lexical.best(q, lexical.text_index(d, q, most_docs=50), 5, allowed=may), 5).collect()
    for one, rows in plain_bm25(queries, docs).items():
        want = sorted(((-round(s, 9), docs[i][0]) for i, s, *_ in rows if i in allowed))[:5]
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == one] == [n for _, n in want]
    none = d.limit(0)
    assert lexical.best(q, lexical.text_index(none, q), 5).count() == 0 and lexical.best(q.limit(0), lexical.text_index(d, q), 5).count() == 0
    assert lexical.best(q, lexical.text_index(d, q), 5, allowed=may.limit(0)).count() == 0


def test_pruning_scores_a_tenth():
    """Frequent terms are looked up for the documents that are still in, and for no other."""
    rng = np.random.default_rng(1)
    docs, terms = 2000, 400
    share = 1 / (1 + np.arange(terms) / 4)
    has = rng.random((docs, terms)) < share
    d = np.concatenate([np.flatnonzero(has[:, t]) for t in range(terms)]).astype(np.int32)
    row = {"dl": np.full(docs, 100), "dn": np.full(docs, 60), "t": np.arange(terms), "n": has.sum(axis=0), "d": d, "tf": rng.integers(1, 4, len(d))}
    post = lexical.Postings(row, docs, 100 * docs, 1.5, 0.75)
    scored = plain = 0
    for _ in range(40):
        asked = np.unique(np.append(rng.integers(0, 8, 6), rng.integers(8, terms, 3)))
        weight = np.log1p((docs - has[:, asked].sum(axis=0) + 0.5) / (has[:, asked].sum(axis=0) + 0.5))
        total, _ = post.all(asked, weight)
        kth = np.sort(total)[-10]
        at, score, touched = post.best(asked, weight, 10, float(kth))
        assert set(np.flatnonzero(total >= kth)) <= set(at.tolist()) and np.allclose(score, total[at])
        assert post.bound(asked, weight) >= total.max() - 1e-9
        scored, plain = scored + touched, plain + int(has[:, asked].sum())
        cold = post.best(asked, weight, 10, 0.0)
        assert set(np.flatnonzero(total >= kth)) <= set(cold[0].tolist())
    assert scored * 10 < plain


def test_fusion_equals_plain_loops(spark, monkeypatch):
    queries, docs = corpus(3, 150)
    monkeypatch.setattr(lexical, "PACK_TERMS", 30)
    docs = [r for r in docs if r[0] != "twice"]
    q, d = frames(spark, queries, docs)
    limits = {"jaccard": 8, "bm25": 8, "fused": 5}
    got = {(r["query_id"], r["doc_id"]): r for r in lexical.candidates(lexical.fusion(q, lexical.text_index(d, q, most_docs=30)), limits).collect()}
    texts, want = dict(queries), {}
    for one, rows in plain_bm25(queries, docs).items():
        if not rows:
            continue
        b = np.array([s for _, s, *_ in rows])
        j = np.array([n / (len(set(tokens(texts[one]))) + dn - n) for _, _, n, dn in rows])
        z = lambda x: (x - x.mean()) / x.std() if x.std() > 1e-12 else x * 0
        f = 0.75 * z(j) + 0.25 * z(b)
        names = [docs[i][0] for i, *_ in rows]
        rank = {n: {i: p for p, i in enumerate(sorted(range(len(rows)), key=lambda i: (-round(x[i], 9), names[i])))} for n, x in (("jaccard", j), ("bm25", b), ("fused", f))}
        for i, name in enumerate(names):
            if any(rank[n][i] < limits[n] for n in limits):
                want[(one, name)] = (j[i], b[i], f[i], *(rank[n][i] for n in ("jaccard", "bm25", "fused")))
    assert set(got) == set(want)
    for key, w in want.items():
        r = got[key]
        assert np.allclose([r["jaccard"], r["bm25"], r["fused"]], w[:3]) and (r["r_jaccard"], r["r_bm25"], r["r_fused"]) == w[3:]


def test_a_collection_with_its_own_ids(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "a/b.md", "title": "Rain", "text": "falls in spain"}\n{"_id": "MED-10", "title": "", "text": "rain and rain"}\n{"_id": "x", "title": "t", "text": null}\n')
    docs = tables.read_corpus(spark, str(tmp_path / "corpus.jsonl"))
    q = spark.createDataFrame([("PLAIN-1", "spain rain")], "query_id string, text string")
    got = retrieval.ranked(lexical.best(q, lexical.text_index(docs, q), 2), 2).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == ["a/b.md", "MED-10"]
