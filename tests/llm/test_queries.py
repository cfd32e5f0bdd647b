"""Results of registered queries that have no SQL, against plain loops over a small table."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from evidencelake.llm import language, queries, secrets
from test_pipeline import SCHEMA, small_corpus, without_repeats


@pytest.fixture
def corpus(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def test_op2_predictions(spark, corpus):
    rows = small_corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    vectors, sums = language.TripleVectors(), {}
    for i, text, lang, *_ in rows:
        keys, counts = language.triples(text)
        if lang and not held(i) and len(keys):
            sums[lang] = sums.get(lang, 0) + vectors.bundle(keys, counts * language.UNITS // counts.sum())
    want = []
    for i, text, *_ in rows:
        keys, counts = language.triples(text)
        scores = {}
        if len(keys):
            v = vectors.bundle(keys, counts)
            scores = {n: sums[n] @ v / np.linalg.norm(sums[n]) / np.linalg.norm(v) for n in sums}
        name = max(sorted(scores), key=scores.get, default="und")
        want.append((str(i), held(i), name, round(min(1.0, max(0.0, scores.get(name, 0.0))), 9)))
    got = queries.op2_language_id(spark, corpus(rows)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == sorted(want)


def test_op3_spans_and_verdicts(spark, corpus):
    live, wide, twice = "Zx81kQp02LmN55tYw7", "EXAMPLE0123456789abcdefXYZ", "abc123DEF456ghi789"
    texts = [f"tok {wide} x"] * 6 + [f"é {live} password = 'hunter22' AKIA{'A1' * 10} {'ab12' * 8}", None, "", "api-key: nothing_here secret:short", f"{twice} {twice}", "PASSWORD=" + "deadbeef" * 5]
    rows = [(i if i != 3 else None, t, "en", f"s{i % 3}" if i else None, 0) for i, t in enumerate(texts)]
    patterns = [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6, 2),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, 0), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24, 0),
    ]
    base, tokens, seen = {}, {}, defaultdict(set)
    for n, (i, text, _, source, _) in enumerate(rows):
        text = text or ""
        found = [(m.start(), k, m.end(), m[g]) for k, (_, p, fits, g) in enumerate(patterns) for m in re.finditer(p, text, re.ASCII) if fits(m)]
        base[n] = sorted(found)
        tokens[n] = [(m.start(), 3, m.end(), m[0]) for m in secrets.TOKEN.finditer(text) if re.search(r"\d", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 8 and not any(s[0] < m.end() and m.start() < s[2] for s in found)]
        for s in base[n] + tokens[n]:
            seen[s[3]].add((source, i))
    is_live = {v: len({o for o, _ in who}) <= 1 and len(who) <= 3 for v, who in seen.items()}
    want = []
    for n, (i, *_) in enumerate(rows):
        kinds = ("assign", "access", "hex", "token")
        written = lambda spans: ",".join(f"{kinds[s[1]]}:{s[0]}:{s[2]}" for s in spans)
        spans = sorted(base[n] + [t for t in tokens[n] if is_live[t[3]]])
        alive = sum(is_live[s[3]] for s in spans)
        want.append((str(i), *[sum(s[1] == k for s in base[n]) for k in range(3)], hashlib.sha256(written(base[n]).encode()).hexdigest(), written(spans), alive, len(spans) - alive))
    got = queries.op3_secret_ownership(spark, corpus(rows)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_op4_texts(spark, corpus):
    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    rows = small_corpus()
    kept = defaultdict(list)  # texts that lost every word are the empty ones
    for r in without_repeats([r for r in rows if r[1] is not None]):
        kept[r[0]].append(digest(r[1]))
    got = queries.op4_line_dedup(spark, corpus(rows)).collect()
    assert len(got) == len(rows)
    for i in {r[0] for r in rows}:
        mine = [r for r in got if r["doc_id"] == i]
        assert sorted(r["text_sha256"] for r in mine) == sorted(kept[i] + [digest("")] * (len(mine) - len(kept[i])))
