"""Whether scores of consistency help to predict: three sets of features, held-out users, lift with its interval, importance of groups.

Predictions are judged on histograms of bounded size (label, bin of one model, bin of the
other), so that the bootstrap draws counts and no prediction is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of predictions; rows of a bucket in which values are shuffled, about.
BINS, SHUFFLE_ROWS = 200, 100_000


def _fold(seed: int) -> Column:
    return F.pmod(F.xxhash64("user_id", F.lit(seed)), F.lit(5))


def area(positive: np.ndarray, negative: np.ndarray) -> float:
    """Area under the ROC curve from counts by ascending bin; ties count half."""
    below = np.cumsum(negative) - negative
    pairs = positive.sum() * negative.sum()
    return float((positive * (below + negative / 2)).sum() / pairs) if pairs else 0.5


def average_precision(positive: np.ndarray, negative: np.ndarray) -> float:
    """Mean precision over the positives, bins from the top."""
    hits, seen = np.cumsum(positive[::-1]), np.cumsum((positive + negative)[::-1])
    total = positive.sum()
    return float((positive[::-1] * hits / np.maximum(seen, 1)).sum() / total) if total else 0.0


def _counts(cells: list[tuple[int, int, int, float]], axis: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, BINS))
    for label, a, b, n in cells:
        out[label, (a, b)[axis]] += n
    return out[1], out[0]


def lift(predictions: DataFrame, *, first: str = "base", second: str = "combined", label: str = "label", draws: int = 1000, seed: int = 42) -> dict[str, float]:
    """By how many percent the second prediction's average precision exceeds the first's, with the interval of Poisson bootstraps and the share of draws at or below 0."""
    bin_ = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col(c) * BINS))).cast("int")
    # at most 2 * BINS^2 rows
    rows = predictions.groupBy(F.col(label).cast("int").alias("label"), bin_(first).alias("a"), bin_(second).alias("b")).count().collect()
    label_, a, b, n = (np.array([r[c] for r in rows]) for c in ("label", "a", "b", "count")) if rows else (np.zeros(0, int),) * 4

    def gain(weight: np.ndarray) -> float:
        side = lambda x, y: np.bincount(x[label_ == y], weights=weight[label_ == y], minlength=BINS)
        old, new = (average_precision(side(x, 1), side(x, 0)) for x in (a, b))
        return (new - old) / old * 100 if old > 0 else 0.0

    chance = np.random.default_rng(seed)
    found = np.array([gain(chance.poisson(n)) for _ in range(draws)]) if len(n) else np.zeros(1)
    low, high = np.percentile(found, [2.5, 97.5])
    return {"lift_pct": gain(n.astype(float)) if len(n) else 0.0, "low": float(low), "high": float(high), "p_value": float((found <= 0).mean())}


def shuffled(rows: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """``rows`` with the values of some columns dealt to other rows at random, together, within buckets of bounded size."""
    buckets = max(1, rows.count() // SHUFFLE_ROWS)
    keyed = rows.withColumn("__bucket", F.pmod(F.xxhash64("user_id", F.lit(seed)), F.lit(buckets)))
    place = lambda s: F.row_number().over(Window.partitionBy("__bucket").orderBy(F.xxhash64("user_id", F.lit(s)), "user_id"))
    own = keyed.drop(*columns).withColumn("__place", place(seed + 1))
    other = keyed.select("__bucket", place(seed + 2).alias("__place"), *columns)
    return own.join(other, ["__bucket", "__place"]).drop("__bucket", "__place").select(*rows.columns)


def three_way(base: DataFrame, scores: DataFrame, labels: DataFrame, *, rounds: int = 20, depth: int = 3, repeats: int = 5, draws: int = 1000, seed: int = 42) -> dict[str, object]:
    """Boosted trees on features (user_id and numbers), on scores, and on both: area and average precision on held-out users and on the others, lift of both over features, loss by shuffling either group."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    groups = {"base": [c for c in base.columns if c != "user_id"], "scores": [c for c in scores.columns if c != "user_id" and c not in base.columns]}
    groups["combined"] = groups["base"] + groups["scores"]
    rows = labels.select("user_id", F.col("label").cast("double").alias("label")).join(base, "user_id").join(scores.select("user_id", *groups["scores"]), "user_id")
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = rows.select("user_id", "label", (_fold(seed) == 0).alias("held_out"), *[finite(c).alias(c) for c in groups["combined"]])
    middle = rows.filter(~F.col("held_out")).agg(*[F.percentile_approx(c, 0.5).alias(c) for c in groups["combined"]]).first().asDict()
    rows = rows.fillna({c: float(v or 0.0) for c, v in middle.items()}).cache()
    models, predicted = {}, rows
    for name, columns in groups.items():
        assembler = VectorAssembler(inputCols=columns, outputCol="features")
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed).fit(assembler.transform(rows.filter(~F.col("held_out"))))
        models[name] = (assembler, model)
        predicted = model.transform(assembler.transform(predicted)).withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def judge(found: DataFrame, column: str) -> tuple[float, float]:
        bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col(column) * BINS))).cast("int")
        cells = [(int(r["label"]), r["b"], 0, r["count"]) for r in found.groupBy("label", bin_.alias("b")).count().collect()]
        positive, negative = _counts(cells, 0)
        return area(positive, negative), average_precision(positive, negative)

    test, train = predicted.filter("held_out"), predicted.filter(~F.col("held_out"))
    out: dict[str, object] = {"n_test": test.count(), "n_train": train.count()}
    for name in groups:
        for part, found in (("test", test), ("train", train)):
            out[f"auc_{name}_{part}"], out[f"ap_{name}_{part}"] = judge(found, f"p_{name}")
    out |= lift(test.select("label", F.col("p_base").alias("base"), F.col("p_combined").alias("combined")), draws=draws, seed=seed)
    assembler, model = models["combined"]
    for name in ("base", "scores"):
        drops = []
        for k in range(repeats):
            mixed = shuffled(test.select("user_id", "label", *groups["combined"]), groups[name], seed + 10 * k)
            found = model.transform(assembler.transform(mixed)).withColumn("p", vector_to_array("probability")[1])
            drops.append(out["auc_combined_test"] - judge(found, "p")[0])
        out[f"importance_{name}"] = float(np.mean(drops))
    out["feature_importance"] = {c: float(x) for c, x in zip(groups["combined"], model.featureImportances.toArray(), strict=True) if x > 1e-6}
    rows.unpersist()
    return out
