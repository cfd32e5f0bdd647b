"""Ranking metrics, paired comparison and the statistics of acceptance gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lifecycle import shared


def metrics(rankings: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(method, query_id, ndcg, recall, mrr) from rankings(method, query_id, doc_id, rank) and qrels(query_id, doc_id, gain).

    Every query with a positive judgment is there for every method; graded linear gains, ideal order from the qrels.
    """
    best = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id")
    positive = qrels.where("gain > 0")
    ideal = positive.withColumn("r", F.row_number().over(best)).groupBy("query_id").agg(
        F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1))).alias("ideal"), F.count("*").alias("n_rel")
    )
    hits = rankings.where(F.col("rank") <= k).join(positive, ["query_id", "doc_id"]).groupBy("method", "query_id").agg(
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.count("*").alias("n"), F.min("rank").alias("first")
    )
    grid = rankings.select("method").distinct().crossJoin(ideal)  # a row for each method and judged query
    zero = F.lit(0.0)
    return grid.join(hits, ["method", "query_id"], "left").select(
        "method", "query_id", F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"),
        F.coalesce(F.col("n") / F.col("n_rel"), zero).alias("recall"), F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
    )


def summary(scored: DataFrame, baseline: str, metric: str = "ndcg") -> DataFrame:
    """Mean, median and p95 of a metric by method, and wins, ties and losses against a baseline method."""
    base = scored.where(F.col("method") == baseline).select("query_id", F.col(metric).alias("b"))
    gap = F.col(metric) - F.col("b")
    return scored.join(base, "query_id").groupBy("method").agg(
        F.count("*").alias("n_queries"), F.avg(metric).alias("mean"), F.percentile(metric, F.lit(0.5)).alias("median"),
        F.percentile(metric, F.lit(0.95)).alias("p95"), F.count_if(gap > 1e-12).alias("wins"),
        F.count_if(F.abs(gap) <= 1e-12).alias("ties"), F.count_if(gap < -1e-12).alias("losses"),
    )


def error_upper_bound(errors: int, count: int, delta: float = 0.05) -> float:
    """One-sided exact binomial upper bound on an error rate: the p at which so few errors have probability delta.

    Newton steps on the binomial tail T(p), whose slope is -(count - errors) times the next term over 1 - p; the root
    is kept between the observed rate and one.
    """
    if not 0 <= errors <= count or not 0 < delta < 1:
        raise ValueError("errors must lie within the count, and delta between 0 and 1")
    if errors == count:
        return 1.0
    p = (errors + 1) / (count + 2)
    low, high = 0.0, 1.0
    ratios = np.array([(count - i) / (i + 1) for i in range(errors)])
    for _ in range(200):
        odds = p / (1 - p)
        logs = count * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log(ratios * odds))])
        tail, last = float(np.exp(logs).sum()), float(math.exp(logs[-1]))
        low, high = (p, high) if tail > delta else (low, p)
        step = (tail - delta) * (1 - p) / max((count - errors) * last, 1e-300)
        fresh = p + step
        fresh = fresh if low < fresh < high else (low + high) / 2
        if abs(fresh - p) < 1e-15:
            break
        p = fresh
    return p


#: Keys whose sums a task holds at a time; a sum that far below zero is none.
HELD, EVEN = 256, 1e-12


def resample_weights(key: int, resamples: int, seed: int) -> np.ndarray:
    """How often a row counts in each resample: Poisson(1) variates that follow from the row's hashed key and the seed."""
    return np.random.Generator(np.random.Philox(key=[seed, key & (1 << 64) - 1])).poisson(1.0, resamples).astype(np.float64)


def poisson_bootstrap(deltas: DataFrame, *, by: str, value: str, key: str, resamples: int = 5000, seed: int = 20260920, tail: float = 0.025) -> DataFrame:
    """(by, mean, n, low, high): an interval of the mean by Poisson resampling, ``tail`` on either side.

    A row's weights in all resamples are one vector from its own generator, so reruns agree however rows are dealt.  A
    task adds up two vectors for each of ``by``, of weights and of weighted values; these meet in two steps.  No row is
    written for a row and a resample, and no rows are gathered.  Rows with a null value are left out.
    """
    kind = deltas.schema[by].dataType.simpleString()
    shape = f"name {kind}, w array<double>, s array<double>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        like = None

        def out() -> pa.RecordBatch:
            vectors = [pa.array([v[i] for v in held.values()], pa.list_(pa.float64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(list(held), like), *vectors], names=["name", "w", "s"])

        for batch in batches:
            like = batch.schema.field("name").type
            for name, one, x in zip(batch["name"].to_pylist(), batch["key"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if name not in held and len(held) >= HELD:
                    yield out()
                    held.clear()
                total, weighted = held.setdefault(name, (np.zeros(resamples), np.zeros(resamples)))
                w = resample_weights(one, resamples, seed)
                total += w
                weighted += w * x
        if held:
            yield out()

    def add(rows: pa.Table) -> pa.Table:
        both = [np.array(rows[c].combine_chunks().flatten().to_numpy()).reshape(rows.num_rows, resamples).sum(axis=0) for c in ("w", "s")]
        return pa.table({"name": rows["name"].slice(0, 1), **{c: pa.array([v], pa.list_(pa.float64())) for c, v in zip("ws", both)}})

    def spread(rows: pa.Table) -> pa.Table:
        done = add(rows)
        w, s = (done[c].combine_chunks().flatten().to_numpy() for c in "ws")
        low, high = np.percentile(s[w > 0] / w[w > 0], [100 * tail, 100 * (1 - tail)]) if (w > 0).any() else (None, None)
        return pa.table({"name": done["name"], "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    rows = deltas.select(F.col(by).alias("name"), F.xxhash64(key).alias("key"), F.col(value).cast("double").alias("value")).where("value is not null")
    some = rows.mapInArrow(sums, shape).withColumn("salt", F.spark_partition_id() % 64).groupBy("name", "salt").applyInArrow(add, shape)
    bounds = some.groupBy("name").applyInArrow(spread, f"name {kind}, low double, high double").withColumnRenamed("name", by)
    return rows.groupBy(F.col("name").alias(by)).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).join(bounds, by)


def router_threshold(rows: DataFrame) -> tuple[float | None, int]:
    """(threshold, accepted) of a router: of all thresholds at which no domain loses, the one that accepts most; (None, 0) if only accepting none does.

    rows(score, domain, delta): a domain's gain at a threshold is its accepted rows' deltas over all its rows; null scores
    are never accepted.  Every score is a threshold.  Rows are sorted in ranges of scores; each range's sums by domain
    give where the next begins, so a range is read once, from its own start, and tells the last threshold that holds.
    Domains are few; the driver sees their sums for each range, and one row of each range.
    """
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    kept = rows.where("score is not null").select(F.col("score").cast("double").alias("score"), "domain", F.col("delta").cast("double").alias("delta"))
    ranged = shared(kept.repartitionByRange(F.col("score").desc()).sortWithinPartitions(F.col("score").desc()).withColumn("range", F.spark_partition_id()))
    before: dict[int, dict] = {}
    running, count = dict.fromkeys(sizes, 0.0), 0
    sums = ranged.groupBy("range", "domain").agg(F.sum("delta").alias("s"), F.count("*").alias("n")).orderBy("range").collect()
    for at in sorted({r["range"] for r in sums}):
        before[at] = {"count": count, "sums": dict(running)}
        for r in sums:
            if r["range"] == at:
                running[r["domain"]] += r["s"]
                count += r["n"]
    starts = rows.sparkSession.sparkContext.broadcast(before)  # a number for each range and domain

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, count, gains, score, best = None, 0, {}, None, None
        found = []
        for batch in batches:
            for value, domain, delta, at in zip(*(batch[c].to_pylist() for c in ("score", "domain", "delta", "range")), strict=True):
                if (at, value) != (here, score) and score is not None and all(g >= -EVEN for g in gains.values()):
                    best = score, count  # all rows of this score are in
                if at != here:
                    found += [best] if best else []
                    here, count, gains, best = at, starts.value[at]["count"], dict(starts.value[at]["sums"]), None
                gains[domain] += delta
                count, score = count + 1, value
        if score is not None and all(g >= -EVEN for g in gains.values()):
            best = score, count
        found += [best] if best else []
        yield pa.RecordBatch.from_pydict({"threshold": pa.array([f[0] for f in found], pa.float64()), "accepted": pa.array([f[1] for f in found], pa.int64())})

    dealt = ranged.repartition("range").sortWithinPartitions("range", F.col("score").desc())
    best = dealt.mapInArrow(last, "threshold double, accepted long").orderBy(F.col("accepted").desc()).first()
    return (best["threshold"], best["accepted"]) if best else (None, 0)


def router_gate(rows: DataFrame, threshold: float | None, *, least: int = 30, slack: float = 0.001, resamples: int = 5000) -> DataFrame:
    """(domain, n, accepted, mean, low, approved) of calibration rows(query_id, score, domain, delta) at a threshold.

    A domain is approved if it accepts ``least`` rows, gains nothing less than zero in the mean, and the lower bound of
    its gain is at most ``slack`` below zero.
    """
    taken = F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False)) if threshold is not None else F.lit(False)
    made = shared(rows.select("query_id", "domain", taken.alias("taken"), F.when(taken, F.col("delta")).otherwise(0.0).cast("double").alias("gain")))
    bound = poisson_bootstrap(made, by="domain", value="gain", key="query_id", resamples=resamples)
    counts = made.groupBy("domain").agg(F.count_if("taken").alias("accepted"))
    passed = (F.col("accepted") >= least) & (F.col("mean") >= 0) & (F.col("low") >= -slack)
    return bound.join(counts, "domain").select("domain", "n", "accepted", "mean", "low", passed.alias("approved"))


def scope_certificate(interval: DataFrame, *, minimum_samples: int = 100, minimum_gain: float = 0.0) -> DataFrame:
    """Add ``enabled``: enough samples, and the whole interval above the least gain."""
    return interval.withColumn("enabled", (F.col("n") >= minimum_samples) & (F.col("low") > minimum_gain))


def policy_grid(cases: DataFrame, scores: list[float], margins: list[float]) -> DataFrame:
    """(minimum_score, minimum_margin, accepted, errors) over a grid of thresholds; cases(score, margin, correct)."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("minimum_score"), F.lit(float(m)).alias("minimum_margin")) for s in scores for m in margins]))
    spread = cases.select("score", "margin", "correct", grid.alias("g")).select("score", "margin", "correct", "g.*")
    accepted = (F.col("score") >= F.col("minimum_score")) & (F.col("margin") >= F.col("minimum_margin"))
    return spread.groupBy("minimum_score", "minimum_margin").agg(F.count_if(accepted).alias("accepted"), F.count_if(accepted & ~F.col("correct")).alias("errors"))


#: Thresholds that a routing policy is chosen from.
SCORES, MARGINS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95), tuple(i / 256 for i in (0, 1, 2, 4, 8, 16))


def fit_policy(training: DataFrame, validation: DataFrame, *, scope: str, limit: int = 10, max_error: float = 0.05, min_accepted: int = 30, delta: float = 0.05) -> dict:
    """Thresholds chosen on training(score, margin, correct), certified once on validation of the same columns.

    Of the pairs that accept enough training rows within the error, the one that accepts most, the lowest of equals;
    (1, 1) where there is none.  ``enabled`` if validation accepts enough too and the upper bound of its error is within
    ``max_error``.  The driver sees the grid's counts only.
    """
    grid = policy_grid(training, list(SCORES), list(MARGINS)).collect()
    fine = [r for r in grid if r["accepted"] >= min_accepted and r["errors"] <= max_error * r["accepted"]]
    best = min(fine, key=lambda r: (-r["accepted"], r["minimum_score"], r["minimum_margin"]), default=None)
    score, margin = (best["minimum_score"], best["minimum_margin"]) if best else (1.0, 1.0)
    held = policy_grid(validation, [score], [margin]).first()
    upper = error_upper_bound(held["errors"], held["accepted"], delta) if held else 1.0
    accepted, errors = (held["accepted"], held["errors"]) if held else (0, 0)
    return {
        "scope": scope, "limit": limit, "minimum_score": score, "minimum_margin": margin, "training_accepted": best["accepted"] if best else 0,
        "validation_accepted": accepted, "validation_errors": errors, "error_upper_bound": upper, "enabled": bool(best and accepted >= min_accepted and upper <= max_error),
    }


def threshold_sweep(cases: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of cases(score, positive); "at or above" is a hit."""
    spread = cases.select("score", "positive", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    told = spread.groupBy("threshold").agg(F.count_if(hit & F.col("positive")).alias("tp"), F.count_if(hit & ~F.col("positive")).alias("fp"), F.count_if(~hit & F.col("positive")).alias("fn"))
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return told.select("threshold", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def macro_average(rows: DataFrame, dataset: str, value: str, *by: str) -> DataFrame:
    """(by, macro): the mean of the data sets' means, each data set alike."""
    each = rows.groupBy(*by, dataset).agg(F.avg(value).alias("__m"))
    return each.groupBy(*by).agg(F.avg("__m").alias("macro"))


def oracle_ndcg(candidates: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, oracle_ndcg, recall): the best that any order of candidates(query_id, doc_id) can reach."""
    best = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id")
    got = qrels.where("gain > 0").join(candidates.select("query_id", "doc_id", F.lit(1).alias("__c")).distinct(), ["query_id", "doc_id"], "left")
    there = Window.partitionBy("query_id", "__c").orderBy(F.col("gain").desc(), "doc_id")
    placed = got.withColumn("__i", F.row_number().over(best)).withColumn("__g", F.when(F.col("__c").isNotNull(), F.row_number().over(there)))
    worth = lambda place: F.sum(F.when(F.col(place) <= k, F.col("gain") / F.log2(F.col(place) + 1)).otherwise(0.0))
    return placed.groupBy("query_id").agg((worth("__g") / worth("__i")).alias("oracle_ndcg"), (F.count("__c") / F.count("*")).alias("recall"))


def list_fusion(lists: DataFrame, a: str, b: str, weight: float = 0.5) -> DataFrame:
    """Add ``fused``: a weighted sum of two scores, each less its list's mean and over its population deviation (1e-9 at least)."""
    stats = lists.groupBy("query_id").agg(*[f(c).alias(f"__{k}{c}") for c in (a, b) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"__m{c}")) / F.greatest(f"__s{c}", F.lit(1e-9))
    return lists.join(stats, "query_id").withColumn("fused", weight * z(a) + (1 - weight) * z(b)).drop(*[f"__{k}{c}" for c in (a, b) for k in "ms"])


def diallel(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Add general abilities ``gca_row`` and ``gca_column`` and the specific one ``sca`` to cells(row, column, value), a value each.

    value = mean + gca_row + gca_column + sca, the means taken over the cells that are there.
    """
    mean = cells.agg(F.avg(value).alias("__all"))
    rows = cells.groupBy(row).agg(F.avg(value).alias("__r"))
    columns = cells.groupBy(column).agg(F.avg(value).alias("__c"))
    met = cells.join(rows, row).join(columns, column).crossJoin(F.broadcast(mean))  # mean is one row
    out = met.withColumn("gca_row", F.col("__r") - F.col("__all")).withColumn("gca_column", F.col("__c") - F.col("__all"))
    return out.withColumn("sca", F.col(value) - F.col("__r") - F.col("__c") + F.col("__all")).drop("__all", "__r", "__c")


def restored_facts(sets: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """(case, source, needs, restored): the facts that a case needs, and those of them that leaving out loses and the source restores.

    sets(case, source, facts, stale) may have many rows for a source; required(case, fact) are the facts that a case
    needs, all that its rows have if there is none.  The rows are shuffled once, by case.  Of a case only the different
    sets of facts of its fresh sources are held together.  A null fact is needed by none; where it is left out there is
    no background, so what has all other facts restores it.
    """
    dealt = sets.where("case is not null").repartition("case")
    first, whole = Window.partitionBy("case", "source").orderBy("source"), Window.partitionBy("case")
    one = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = lambda listed: F.array_sort(F.array_distinct(F.flatten(listed)))
    lists = [F.collect_set(c).over(one).alias(n) for c, n in ((F.col("facts"), "own"), (F.when(~F.col("stale"), F.col("facts")), "fresh"))]
    sources = dealt.select("case", "source", *lists, F.row_number().over(first).alias("__n")).where("__n = 1").drop("__n")
    if required is not None:
        sources = sources.join(required.groupBy("case").agg(merged(F.collect_list(F.array("fact"))).alias("needs")), "case")
    else:
        sources = sources.withColumn("own", merged("own")).withColumn("needs", merged(F.collect_set("own").over(whole))).drop("own")
    fresh = F.array_compact(F.array_intersect("needs", merged("fresh")))
    held = sources.select("case", "source", "needs", fresh.alias("fresh")).withColumn("others", F.collect_set("fresh").over(whole))
    # what is left out comes back with a source that has it and all facts that no fresh source without it has
    elsewhere = lambda omitted, fact: F.exists("others", lambda t: F.array_contains(t, fact) & ~F.array_contains(t, omitted))
    missing = F.array_compact(F.array_except("needs", "fresh"))
    back = F.filter("needs", lambda omitted: (omitted.isNull() | F.array_contains("fresh", omitted)) & F.forall(missing, lambda fact: elsewhere(omitted, fact)))
    return held.select("case", "source", "needs", back.alias("restored"))


def restoration_gain(rows: DataFrame, required: DataFrame) -> DataFrame:
    """(case, omitted, source, before, after, gain): what putting one source back does when a required fact is left out.

    rows(case, source, fact, stale) has a row for each fact, required(case, fact) the facts that a case needs.  The
    background is of fresh sources without the omitted fact, so before is 0; after says whether it with the source covers
    all that is required.
    """
    told = restored_facts(rows.select("case", "source", F.array("fact").alias("facts"), "stale"), required)
    after = F.array_contains(F.array_compact("restored"), F.col("omitted")).cast("int")
    listed = told.select("case", F.explode(F.array_compact("needs")).alias("omitted"), "source", "restored")
    return listed.select("case", "omitted", "source", F.lit(0).alias("before"), after.alias("after"), after.alias("gain"))


def leakage(rows: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """(key, splits): keys, such as normalised texts, that stand in more than one split."""
    each = rows.select(key.alias("key"), split).distinct()
    return each.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(split)).alias("splits")).where("n > 1").drop("n")


def without_leakage(rows: DataFrame, key: Column, *, train: str = "train", split: str = "split") -> DataFrame:
    """``rows`` less the training rows whose key stands in another split."""
    keyed = rows.withColumn("__k", key)
    held = keyed.where(F.col(split) != train).select("__k", F.lit(train).alias(split)).distinct()
    return keyed.join(held, ["__k", split], "left_anti").drop("__k")


def frozen_gate(tune: DataFrame, calibration: DataFrame, *, controls: tuple[str, ...], fallback: str, least: int = 50, resamples: int = 5000) -> DataFrame:
    """(dataset, candidate, qualified, deployed): the best tuned method of each data set, gated by paired intervals.

    tune and calibration(dataset, method, query_id, value).  The candidate qualifies on calibration with ``least``
    queries, where the lower bound of its lead over each control, at 5 % shared among the controls, is above zero.
    """
    means = tune.groupBy("dataset", "method").agg(F.avg("value").alias("m"))
    first = Window.partitionBy("dataset").orderBy(F.col("m").desc(), "method")
    chosen = means.withColumn("r", F.row_number().over(first)).where("r = 1").select("dataset", F.col("method").alias("candidate"))
    mine = calibration.join(chosen, ["dataset"]).where("method = candidate").select("dataset", "query_id", "candidate", F.col("value").alias("a"))
    others = calibration.where(F.col("method").isin(*controls)).select("dataset", "query_id", F.col("method").alias("control"), F.col("value").alias("b"))
    deltas = mine.join(others, ["dataset", "query_id"]).select(F.concat_ws("/", "dataset", "control").alias("pair"), "dataset", "candidate", "control", "query_id", (F.col("a") - F.col("b")).alias("delta"))
    bounds = poisson_bootstrap(deltas, by="pair", value="delta", key="query_id", resamples=resamples, tail=0.05 / max(1, len(controls)))
    passed = bounds.join(deltas.select("pair", "dataset", "candidate", "control").distinct(), "pair").groupBy("dataset", "candidate").agg(
        F.min("n").alias("n"), F.bool_and((F.col("control") == F.col("candidate")) | (F.col("low") > 0)).alias("ahead")
    )
    told = chosen.join(passed, ["dataset", "candidate"], "left").withColumn("qualified", F.coalesce((F.col("n") >= least) & F.col("ahead"), F.lit(False)))
    return told.select("dataset", "candidate", "qualified", F.when(F.col("qualified"), F.col("candidate")).otherwise(fallback).alias("deployed"))
