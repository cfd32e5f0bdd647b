"""Routing of queries: exact, compact or precise, with the reason, and the expert router's threshold rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoutingPolicy:
    scope: str
    limit: int
    minimum_score: float
    minimum_margin: float
    enabled: bool = False
    certified_error_upper_bound: float = 1.0
    calibration_count: int = 0


def progressive_route(cases: DataFrame, policy: RoutingPolicy | None, *, scope: str, limit: int, maximum_error: float = 0.05, compact: bool = True) -> DataFrame:
    """Add ``route`` and ``reason`` to cases(exact_key, exact_ok, n_eligible, score, margin), a row for each query.

    score and margin are the compact ranking's limit-th score and its lead over the next.  Precise scoring is needed
    only for the rows whose route is precise.
    """
    fits = policy is not None and policy.enabled and policy.scope == scope and policy.limit == limit
    within = policy is not None and policy.certified_error_upper_bound <= maximum_error and policy.calibration_count > 0
    tried = F.lit(bool(compact and fits and within)) & (F.col("n_eligible") > limit)
    passed = tried & (F.col("score") >= (policy.minimum_score if policy else 0.0)) & (F.col("margin") >= (policy.minimum_margin if policy else 0.0))
    if not compact:
        why = "compact_backend_unavailable"
    elif policy is None or not policy.enabled:
        why = "compact_policy_unqualified"
    elif not within:
        why = "compact_policy_exceeds_risk_budget"
    else:
        why = "compact_policy_scope_mismatch"
    exact = F.col("exact_key").isNotNull()
    reason = (
        F.when(exact & F.col("exact_ok"), "authorized_exact_id").when(exact, "exact_id_not_eligible")
        .when(F.col("n_eligible") == 0, "no_eligible_candidates").when(passed, "calibrated_compact_exit")
        .when(tried, "compact_threshold_rejected").otherwise(why)
    )
    route = (
        F.when(F.col("reason") == "authorized_exact_id", "exact")
        .when(F.col("reason").isin("exact_id_not_eligible", "no_eligible_candidates"), "abstain")
        .when(F.col("reason") == "calibrated_compact_exit", "compact").otherwise("precise")
    )
    return cases.withColumn("reason", reason).withColumn("route", route)


#: Whole numbers of a coefficient either way, and the scales beyond which a feature is out of range.
STEPS, FAR = 32767, 8


def choose_expert(features: list[Column], scope: Column, *, means: list[float], scales: list[float], weights: list[float], intercept: float, threshold: float, approved: tuple[str, ...]) -> Column:
    """struct<route, reason>: "hybrid" where the linear gain reaches the threshold in an approved scope, else "fusion".

    Coefficients are whole multiples of one step; where the rounding could decide, full coefficients do.  Null features
    are out of range.
    """
    z = [(f - m) / s for f, m, s in zip(features, means, scales, strict=True)]
    step = max(max(abs(w) for w in weights), 1e-12) / STEPS
    rounded = [round(w / step) * step for w in weights]
    total = lambda ws, xs, start: sum((F.lit(w) * x for w, x in zip(ws, xs, strict=True)), F.lit(start))
    quick = total(rounded, z, intercept)
    error = total([abs(w - r) for w, r in zip(weights, rounded)], [F.abs(x) for x in z], 0.0) + 1e-12 * (1 + F.abs(quick))
    close = F.abs(quick - threshold) <= error
    gain = F.when(close, total(weights, z, intercept)).otherwise(quick)
    inside = F.coalesce(F.greatest(*[F.abs(x) for x in z], F.lit(0.0)) <= FAR, F.lit(False))
    for x in z:
        inside = inside & x.isNotNull()
    reason = (
        F.when(~F.coalesce(scope.isin(*approved), F.lit(False)), "scope_unqualified").when(~inside, "out_of_training_range")
        .when(close, "boundary_fp64").otherwise("int16_coefficients")
    )
    route = F.when(F.coalesce(scope.isin(*approved), F.lit(False)) & inside & (gain >= threshold), "hybrid").otherwise("fusion")
    return F.struct(route.alias("route"), reason.alias("reason"))


def check_ranking(rows: DataFrame, eligible: DataFrame, count: int, *, bounded: bool = False) -> DataFrame:
    """(query_id, n, valid) for rankings(query_id, item, place, score) that somebody else made.

    Valid: as many as asked for or eligible, places in turn, all eligible(query_id, item) and distinct, scores finite, not rising,
    and from 0 to 1 if ``bounded``.  A query without any row is not listed.
    """
    order = Window.partitionBy("query_id").orderBy("place")
    allowed = rows.join(eligible.select("query_id", "item", F.lit(True).alias("__ok")).distinct(), ["query_id", "item"], "left")
    finite = F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))
    rising = F.coalesce(F.col("score") > F.lag("score").over(order), F.lit(False))
    inside = F.col("score").between(0, 1) if bounded else F.lit(True)
    marked = allowed.withColumn("__bad", F.col("__ok").isNull() | ~finite | rising | ~inside)
    some = eligible.groupBy("query_id").agg(F.count_distinct("item").alias("__all"))
    told = marked.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("item").alias("__d"), F.bool_or("__bad").alias("__b"), F.min("place").alias("__lo"), F.max("place").alias("__hi"))
    fine = ~F.col("__b") & (F.col("__d") == F.col("n")) & (F.col("n") == F.least(F.lit(count), F.coalesce("__all", F.lit(0)))) & (F.col("__hi") - F.col("__lo") + 1 == F.col("n"))
    return told.join(some, "query_id", "left").select("query_id", "n", fine.alias("valid"))
