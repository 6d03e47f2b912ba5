"""Operator 10: a sparse rule ensemble for text quality.

Statistics of each text are Spark expressions.  Shallow trees are grown on them, each path from a root to a node is
a rule (a conjunction of comparisons), and a logistic regression with a lasso penalty keeps the useful rules.  The
rules that are left are compiled into one column expression, so scoring is a projection.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store
from fathom.llm.language_id import held_out
from fathom.llm.quality_rules import words_in

TREES, DEPTH, SEED = 12, 3, 11
#: Strength of the lasso penalty.
PENALTY = 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; of an empty one, zeros."""
    words, chars = words_in(text), F.length(text)
    n = F.size(words)
    per_word = lambda x: x / F.greatest(n, F.lit(1))
    per_char = lambda x: x / F.greatest(chars, F.lit(1))
    lines = F.split(text, "\n")
    without = lambda part: (chars - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
    return {
        "log_words": F.log1p(n.cast("double")),
        "word_length": per_word(F.length(F.array_join(words, ""))),
        "distinct_words": per_word(F.size(F.array_distinct(words))),
        "symbols": per_char(F.regexp_count(text, F.lit(r"[#*$%&|<>{}\[\]\\^~=+@]"))),
        "shouts": per_word(without("!!")),
        "bars": per_word(without(" | ")),
        "capitals": per_char(F.regexp_count(text, F.lit(r"\p{Lu}"))),
        "digits": per_char(F.regexp_count(text, F.lit("[0-9]"))),
        "stops": per_word(F.regexp_count(text, F.lit(r"[.!?](\s|$)"))),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


NAMES = ("log_words", "word_length", "distinct_words", "symbols", "shouts", "bars", "capitals", "digits", "stops", "distinct_lines")


def paths(tree) -> set[tuple[tuple[int, float, float], ...]]:
    """Rules of a tree: for each node below the root, the interval (above, up to) of each feature on the way there."""
    found = set()

    def walk(node, bounds: dict[int, tuple[float, float]]) -> None:
        if bounds:
            found.add(tuple(sorted((f, low, high) for f, (low, high) in bounds.items())))
        if node.numDescendants():
            split = node.split()
            f, at = split.featureIndex(), split.threshold()
            low, high = bounds.get(f, (-math.inf, math.inf))
            walk(node.leftChild(), bounds | {f: (low, min(high, at))})
            walk(node.rightChild(), bounds | {f: (max(low, at), high)})

    walk(tree.rootNode(), {})
    return found


def holds(rule: tuple[tuple[int, float, float], ...]) -> Column:
    """1.0 where a rule holds, else 0.0."""
    test = F.lit(True)
    for f, low, high in rule:
        x = F.col(NAMES[f])
        if low > -math.inf:
            test = test & (x > low)
        if high < math.inf:
            test = test & (x <= high)
    return test.cast("double")


def fit(train: DataFrame) -> tuple[float, list[tuple[float, tuple]]]:
    """Intercept and weighted rules from train (the statistics, and label 0.0 or 1.0)."""
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(counts) < 2:
        only = next(iter(counts), None)
        return (0.0 if only is None else 20.0 if only == 1.0 else -20.0), []
    vectors = train.select("label", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", maxBins=64, subsamplingRate=0.8).fit(vectors)
    rules = sorted(set().union(*(paths(t._java_obj) for t in forest.trees)))
    if not rules:
        share = counts[1.0] / sum(counts.values())
        return math.log(share / (1 - share)), []
    data = train.select("label", array_to_vector(F.array(*map(holds, rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, tol=1e-5, standardization=False).fit(data)
    return lasso.intercept, [(w, r) for w, r in zip(lasso.coefficients.toArray().tolist(), rules) if w]


def quality_scores(docs: DataFrame, labels: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text); row, all its columns, with whole_rows.

    labels: doc_id, quality.  Learned from rows that aren't held out; every row of a repeated doc_id counts.  Null
    texts are empty and are scored like any, texts of any length whole.  Without labels the score is 0.5; with those of
    one class only, near 0 or 1.  Further columns of either table are ignored; no documents give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole_rows else []
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *row, *(c.alias(n) for n, c in statistics(text).items()))
    table = store.written(base, "statistics")
    known = labels.filter("quality IN (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label"))
    train = table.filter("NOT held_out").join(known, "doc_id").select("label", *NAMES)
    intercept, rules = fit(store.written(train, "train"))
    total = F.lit(float(intercept))
    for weight, rule in rules:
        total = total + F.lit(float(weight)) * holds(rule)
    score = 1 / (1 + F.exp(-total))
    return table.select("doc_id", "held_out", *(["row"] if whole_rows else []), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: all documents."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
