"""Quality classifier as a sparse rule ensemble.

Statistics of a text are Spark expressions.  Shallow trees over them are grown on labelled rows; every path from a root
to a node is a rule, the conjunction of its conditions, and a lasso logistic regression over the rules gives most of
them weight zero.  The rules that are left are compiled into one Spark column expression: scoring runs no model code,
only comparisons of the statistics and a sum of weights.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled rows that the fit uses at most: those of the smallest hashed ids.
MAX_ROWS = 200_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 11
#: predicted is 1 from this score on.
CUT = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text by name; null counts as empty.  All are 0 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.size(words)
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / chars  # noqa: E731  what is left of the text
    distinct = F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w))))
    per_word = F.greatest(n_words, F.lit(1))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": (F.length(text) - n_words) / per_word,
        "upper_share": share(r"[^\p{Lu}]+"),
        "letter_share": share(r"[^\p{L}]+"),
        "digit_share": share(r"[^0-9]+"),
        "mark_share": share(r"[\p{L}\p{N}\s.,]+"),
        "stop_share": share(r"[^.,]+"),
        "distinct_share": distinct / per_word,
        "log_repeat": F.log1p(per_word / F.greatest(distinct, F.lit(1))),
        "break_share": share(r"[^\n]+"),
    }


def with_statistics(docs: DataFrame, *, text: str = "text", name: str = "stats") -> DataFrame:
    """Add a struct of doubles with the statistics."""
    return docs.withColumn(name, F.struct(*[c.cast("double").alias(n) for n, c in statistics(F.col(text)).items()]))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, "<=" or ">", threshold) that must all hold, and the rule's weight."""

    conditions: tuple[tuple[str, str, float], ...]
    weight: float = 0.0

    def column(self, stats: str) -> Column:
        hold = F.lit(True)
        for name, sign, bound in self.conditions:
            value = F.col(f"{stats}.{name}")
            hold = hold & (value <= F.lit(bound) if sign == "<=" else value > F.lit(bound))
        return hold

    def holds(self, stats: dict[str, float]) -> bool:
        return all(stats[n] <= b if sign == "<=" else stats[n] > b for n, sign, b in self.conditions)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: str = "stats") -> Column:
        """The compiled score, 0 to 1."""
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            total = total + F.when(rule.column(stats), F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "rules": [[list(map(list, r.conditions)), r.weight] for r in self.rules]})


def tree_rules(dump: str, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """The paths of the trees in Spark's printed form of a forest, each from its root to a node below."""
    step = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
    rules, path = [], []
    for line in dump.splitlines():
        if line.lstrip().startswith("Tree "):
            path = []
        elif m := step.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            rules.append(tuple(c for _, c in path))
    return list(dict.fromkeys(rules))


def fit(labelled: DataFrame, *, stats: str = "stats", label: str = "label", max_rows: int = MAX_ROWS, order: str = "doc_id") -> RuleEnsemble:
    """A rule ensemble for the rows of ``labelled`` with label 0 or 1 (others, and null, are left out).

    At most ``max_rows`` rows are used, chosen by hashed ``order``; the bound keeps the fit's cost the same on any
    corpus.  Without rows of both labels the ensemble has no rule and the share of label 1 as its score (0.5 of none).
    """
    # here, as the other operators' drivers have no use for it
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(labelled.schema[stats].dataType.names)
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), stats, order)
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(seen.values())
    if len(seen) < 2:
        share = {0.0: -6.0, 1.0: 6.0}.get(next(iter(seen), None), 0.0)
        return RuleEnsemble(share, ())
    part = min(1.0, max_rows / total)
    if part < 1:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64(order), 1) < F.lit(min((1 << 63) - 1, int(part * (1 << 63)))))
    flat = VectorAssembler(inputCols=names, outputCol="features").transform(rows.select("label", f"{stats}.*"))
    flat = cut(flat.select("label", "features", *names).repartition(8).sortWithinPartitions("label", *names))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(flat)
    found = tree_rules(forest.toDebugString, names)
    if not found:
        return RuleEnsemble(0.0, ())
    held = [Rule(c) for c in found]
    wide = flat.select("label", F.struct(*names).alias("s"))
    marks = wide.select("label", *[r.column("s").cast("double").alias(f"r{i}") for i, r in enumerate(held)])
    ruled = VectorAssembler(inputCols=[f"r{i}" for i in range(len(held))], outputCol="rules").transform(marks).select("label", "rules")
    lasso = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(cut(ruled))
    weighed = [Rule(r.conditions, float(w)) for r, w in zip(held, lasso.coefficients.toArray(), strict=True) if w != 0.0]
    return RuleEnsemble(float(lasso.intercept), tuple(weighed))


def score(docs: DataFrame, model: RuleEnsemble, *, text: str = "text", cut_at: float = CUT) -> DataFrame:
    """Add ``score`` and ``predicted`` to ``docs``.  Null and empty texts get the score of an empty text.

    Other columns and repeated rows pass through; columns of these two names are replaced.
    """
    rows = with_statistics(docs.drop("score", "predicted"), text=text, name="__stats")
    scored = rows.withColumn("score", model.score("__stats")).drop("__stats")
    return scored.withColumn("predicted", F.when(F.col("score") >= cut_at, 1).otherwise(0).cast("int"))
