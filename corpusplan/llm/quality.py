"""Quality by a sparse rule ensemble.

Trees over text statistics are fitted on a bounded sample of labelled rows; every path in
them is a rule; a logistic model with an absolute-value penalty weighs the rules; those left
are compiled into one column expression, so scoring is a projection in the JVM.
"""

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from corpusplan.llm.common import free_names, labelled_sample, store_of
from corpusplan.llm.trees import nested, paths

TRAIN_DOCS = 12_000  # expected labelled documents at most
TREES = 24
DEPTH = 3
PENALTY = 0.002
THRESHOLD = 0.3
SEED = 7


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text that is not null; all 0 for the empty text but `empty`."""
    chars = F.length(text)
    words = F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "chars": chars.cast("double"),
        "empty": (chars == 0).cast("double"),
        "words": n.cast("double"),
        "mean_word": _share(chars, n),
        "distinct_words": _share(F.size(F.array_distinct(words)), n),
        "upper": _share(F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")), chars),
        "digits": _share(F.length(F.regexp_replace(text, "[^0-9]+", "")), chars),
        "word_chars": _share(F.length(F.regexp_replace(text, "[^\\p{L}]+", "")), chars),
        "lines": _share(_count(text, "\n"), n),
        **{name: _share(_count(text, letter), n) for name, letter in (
            ("stops", "."), ("commas", ","), ("shouts", "!"), ("asks", "?"), ("bars", "|"), ("hashes", "#"),
            ("dollars", "$"), ("percents", "%"), ("ands", "&"), ("stars", "*"), ("ats", "@"), ("brackets", "["),
            ("braces", "{"), ("slashes", "/"), ("angles", "<"), ("equals", "="))},
    }


@dataclass(frozen=True)
class Rules:
    """score = logistic(base + sum of the weights of the rules that hold)."""
    names: tuple[str, ...]
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]
    base: float

    def score(self) -> Column:
        z = F.lit(self.base)
        for path, weight in self.rules:
            z = z + F.when(_holds(path, self.names), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _holds(path, names) -> Column:
    tests = [F.col(names[f]) > t if above else F.col(names[f]) <= t for f, above, t in path]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _with_statistics(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    stats = statistics(F.col("_text"))
    named = {f"_stat_{k}": v for k, v in stats.items()}
    return docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumns(named), list(named)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text",
          id_col: str = "doc_id", limit: int = TRAIN_DOCS) -> Rules:
    """Fit on a bounded sample of the labelled documents that are not held out.

    With no label of one of the two kinds, every text scores the (smoothed) share of label 1.
    """
    store = store_of(docs.sparkSession, "quality")
    sample, names = _with_statistics(labelled_sample(docs, labels, label, text, id_col, limit), "text")
    sample = store(sample.select(F.col("label").cast("double").alias("label"), *names), "sample",
                   rows=F.count(F.lit(1)), ones=F.sum("label"))
    rows, ones = store.measured["sample"]["rows"], store.measured["sample"]["ones"] or 0
    share = (ones + 1) / (rows + 2)
    if not 0 < ones < rows:
        return Rules(tuple(names), (), _logit(share))
    table = sample.withColumn("features", array_to_vector(F.array(*names))).select("label", "features", *names).coalesce(1).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=10, seed=SEED,
                                    featureSubsetStrategy="onethird").fit(table)
    found = list(dict.fromkeys(p for tree in forest.trees for p in paths(nested(tree.toDebugString))))
    if not found:
        return Rules(tuple(names), (), _logit(share))
    held = F.array(*[F.when(_holds(p, names), 1.0).otherwise(0.0) for p in found])
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(
        table.select("label", array_to_vector(held).alias("features")))
    table.unpersist()
    kept = tuple((p, float(w)) for p, w in zip(found, fitted.coefficients.toArray()) if w)
    return Rules(tuple(names), kept, float(fitted.intercept))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def score(docs: DataFrame, rules: Rules, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 from `threshold` on).

    All in column expressions over the whole text. Null text counts as empty. Columns of
    these names are replaced.
    """
    # columns named like what is worked out here step aside meanwhile
    aside = {c: new for c, new in zip(docs.columns, free_names(docs, *(f"aside_{c}" for c in docs.columns)))
             if c.lower() == "_text" or c.lower().startswith("_stat_")}
    table, names = _with_statistics(docs.withColumnsRenamed(aside), aside.get(text, text))
    scored = (table.withColumn("score", rules.score())
              .withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("_text", *names))
    return scored.withColumnsRenamed({new: c for c, new in aside.items()})
