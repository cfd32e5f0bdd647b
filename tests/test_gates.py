"""Bootstrap sums against plain ones over the same weights, and router thresholds against all of them tried."""

import random

import numpy as np
import pytest
from evidencelake.operators import evaluation
from pyspark.sql import functions as F


def test_bootstrap_equals_plain_sums(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"m{i % 5}", f"q{i // 5}", rng.gauss(i % 5, 1)) for i in range(300)] + [("m0", "q0", None), ("one", "q1", 2.0)]
    frame = spark.createDataFrame(rows, "by string, q string, d double").repartition(4)
    keys = {r["q"]: r["h"] for r in frame.select("q", F.xxhash64("q").alias("h")).distinct().collect()}
    got = {r["by"]: r for r in evaluation.poisson_bootstrap(frame, by="by", value="d", key="q", resamples=300, tail=0.05).collect()}
    for name in {r[0] for r in rows}:
        mine = [(keys[q], d) for by, q, d in rows if by == name and d is not None]
        weights = np.array([evaluation.resample_weights(h, 300, 20260920) for h, _ in mine])
        total, value = weights.sum(axis=0), weights.T @ np.array([d for _, d in mine])
        low, high = np.percentile(value[total > 0] / total[total > 0], [5, 95])
        r = got[name]
        assert (r["n"], r["mean"], r["low"], r["high"]) == (len(mine), pytest.approx(np.mean([d for _, d in mine])), pytest.approx(low), pytest.approx(high))
    # of rows and resamples nothing but sums leaves a task
    assert abs(np.mean([evaluation.resample_weights(i, 1000, 7).mean() for i in range(50)]) - 1) < 0.02
    assert evaluation.poisson_bootstrap(frame.limit(0), by="by", value="d", key="q", resamples=10).count() == 0


def tried(rows):
    domains = {d for _, d, _ in rows}
    best = (None, 0)
    for t in {s for s, _, _ in rows if s is not None}:
        into = [(d, x) for s, d, x in rows if s is not None and s >= t]
        if all(sum(x for d, x in into if d == one) >= -1e-12 for one in domains) and len(into) > best[1]:
            best = (t, len(into))
    return best


def test_thresholds_equal_all_tried(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(None if rng.random() < 0.05 else rng.choice([round(rng.random(), 2), 0.5]), rng.choice("abc"), rng.choice([-2, -1, 1, 1, 1]) / 8) for _ in range(400)]
        got = evaluation.router_threshold(spark.createDataFrame(rows, "score double, domain string, delta double").repartition(3))
        assert got == tried(rows)
    losing = spark.createDataFrame([(0.9, "a", -1.0), (0.1, "b", 1.0)], "score double, domain string, delta double")
    assert evaluation.router_threshold(losing) == (None, 0) and evaluation.router_threshold(losing.limit(0)) == (None, 0)


def test_gate_of_domains(spark):
    rows = [(f"{d}{i}", 0.9 if i % 2 else 0.1, d, {"gain": 0.2, "loss": -0.2, "even": 0.0}[d] + (i % 7 - 3) / 100) for d in ("gain", "loss", "even") for i in range(120)] + [(f"few{i}", 0.9, "few", 1.0) for i in range(29)]
    frame = spark.createDataFrame(rows, "query_id string, score double, domain string, delta double")
    got = {r["domain"]: (r["n"], r["accepted"], r["approved"]) for r in evaluation.router_gate(frame, 0.5, resamples=400).collect()}
    assert got["gain"] == (120, 60, True) and got["loss"] == (120, 60, False) and got["few"] == (29, 29, False)
    assert not any(r["approved"] for r in evaluation.router_gate(frame, None, resamples=50).collect())
